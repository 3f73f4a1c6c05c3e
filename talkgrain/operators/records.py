"""Records of calls: claim views, escalations, field paths, verdict rules, repairs of quotes, prompts, training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators.validators import RUBRIC

# Fixed values.
NO_ANALYSIS = "No analysis: extraction failed. See the escalation reason."
EDITABLE = {"commitment": ("description", "promised_by", "deadline"), "compliance_flag": ("rule_id", "severity", "description"), "rubric_score": ("score", "justification")}
GUIDANCE = "GUIDANCE FROM PAST QA CORRECTIONS — apply whichever of these are relevant to this call; ignore any that are not:"
MAX_TOKENS = 16_384
COLLAPSED = 0.2


def reconciled(scores: DataFrame) -> DataFrame:
    """scores (call_id, pos, criterion, score): the first score of each of the seven criteria in their order, what is missing, and how many were of no known criterion."""
    rubric = F.array(*map(F.lit, RUBRIC))
    first = scores.groupBy("call_id", "criterion").agg(F.min(F.struct("pos", "score"))["score"].alias("score"), F.count(F.lit(1)).alias("n"))
    place = F.array_position(rubric, F.col("criterion"))
    known = F.transform(F.array_sort(F.collect_list(F.when(place > 0, F.struct(place.alias("ord"), "criterion", "score")))), lambda x: F.struct(x["criterion"].alias("criterion"), x["score"].alias("score")))
    out = first.groupBy("call_id").agg(known.alias("scores"), F.coalesce(F.sum(F.when(place == 0, F.col("n"))), F.lit(0)).alias("unexpected"))
    return out.withColumn("missing", F.array_except(rubric, F.transform("scores", lambda x: x["criterion"])))


def claim_views(lists: dict[str, DataFrame]) -> DataFrame:
    """Per list name a table (call_id, pos, and columns of its kind): a row per claim, named list[i]; columns of other kinds are null."""
    out = None
    for name, rows in lists.items():
        index = F.row_number().over(Window.partitionBy("call_id").orderBy("pos")) - 1
        rows = rows.withColumn("claim_id", F.concat(F.lit(f"{name}["), index.cast("string"), F.lit("]"))).drop("pos")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def shown_text(justification: Column, description: Column) -> Column:
    """What a rejected claim says: its justification, else its description, else nothing."""
    return F.coalesce(F.nullif(justification, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100).cast("long").cast("string"), F.lit("%"))


def escalation(error: Column, needs_review: Column, rejected: Column, kept: Column, coverage: Column, threshold: float) -> Column:
    """Why a call is in front of a reviewer; null if it passed. An unknown review flag counts as set."""
    weak = F.concat(rejected.cast("string"), F.lit(" of "), (rejected + kept).cast("string"), F.lit(" claims had no verbatim evidence (grounding coverage "), percent(F.coalesce(coverage, F.lit(0.0))), F.lit(f", threshold {threshold:.0%})"))
    return F.when(error.isNotNull() & (error != ""), F.concat(F.lit("Analysis error: "), error)).when(F.coalesce(needs_review, F.lit(True)), weak)


def relevant(analysis: dict[str, Column], path: Column) -> Column:
    """How many claims a path names; null for an unknown shape. analysis: the arrays commitments, flags, rubric."""
    index = F.regexp_extract(path, r"^commitments\[(\d+)\]\.deadline$", 1)
    criterion = F.regexp_extract(path, r"^rubric_scores\[(\w+)\]$", 1)
    one = F.when(F.try_to_number(index, F.lit("999999")).cast("int") < F.size(analysis["commitments"]), 1).otherwise(0)
    return (
        F.when(path == "commitments", F.size(analysis["commitments"])).when(path == "compliance_flags", F.size(analysis["flags"]))
        .when(index != "", one).when(criterion != "", F.size(F.filter(analysis["rubric"], lambda x: x["criterion"] == criterion)))
    )


def described(analysis: dict[str, Column], path: Column) -> Column:
    """The one field that a path names, in words; null for a path of another shape, for which the whole analysis is shown."""
    at = lambda pattern: F.regexp_extract(path, pattern, 1)
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    item = lambda name, pattern: F.get(analysis[name], F.try_to_number(at(pattern), F.lit("999999")).cast("int"))
    deadline, commitment, flag = r"^commitments\[(\d+)\]\.deadline$", r"^commitments\[(\d+)\]$", r"^compliance_flags\[(\d+)\]$"
    justified, score = r"^rubric_scores\[(\w+)\]\.justification$", r"^rubric_scores\[(\w+)\]$"
    scored = lambda pattern: F.get(F.filter(analysis["rubric"], lambda x: x["criterion"] == at(pattern)), 0)
    named = F.array_join(F.transform(analysis["flags"], lambda x: x["rule_id"]), ", ")
    c, f, j, s = item("commitments", commitment), item("flags", flag), scored(justified), scored(score)
    day = F.coalesce(F.date_format(c["deadline"], "yyyy-MM-dd"), F.lit("none"))
    return (
        F.when(path == "commitments", F.concat(F.size(analysis["commitments"]).cast("string"), F.lit(" commitment(s)")))
        .when(at(deadline) != "", F.when(item("commitments", deadline)["deadline"].isNotNull(), "deadline=given").otherwise("deadline=none"))
        .when(path == "compliance_flags", F.concat(F.lit("flags=["), F.when(named == "", "none").otherwise(named), F.lit("]")))
        .when(at(commitment) != "", F.when(c.isNull(), "commitment absent").otherwise(F.concat(F.lit("description="), quoted(c["description"]), F.lit("; promised_by="), c["promised_by"], F.lit("; deadline="), day)))
        .when(at(flag) != "", F.when(f.isNull(), "flag absent").otherwise(F.concat(F.lit("rule_id="), f["rule_id"], F.lit("; severity="), f["severity"], F.lit("; description="), quoted(f["description"]))))
        .when(at(justified) != "", F.when(j.isNull(), F.concat(at(justified), F.lit("=not scored"))).otherwise(F.concat(at(justified), F.lit("="), F.format_string("%.2f", j["score"]), F.lit("; justification="), quoted(j["justification"]))))
        .when(at(score) != "", F.concat(at(score), F.lit("="), F.when(s.isNull(), "not scored").otherwise(F.format_string("%.2f", s["score"]))))
    )


def verdict_faults(verdicts: DataFrame) -> DataFrame:
    """verdicts (call_id, claim_id, kind, verdict, changes: map, absent keys are unchanged): the rules that each breaks, in words."""
    given = F.coalesce(F.map_keys("changes"), F.array().cast("array<string>"))
    fields = F.create_map(*[x for kind, names in EDITABLE.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    empty = F.exists(given, lambda k: (k != "deadline") & F.element_at("changes", k).isNull())
    repeated = F.count(F.lit(1)).over(Window.partitionBy("call_id", "claim_id")) > 1
    faults = F.array(
        F.when(repeated, "repeated"), F.when((F.col("verdict") == "correct") & F.col("changes").isNull(), "no changes"), F.when((F.col("verdict") != "correct") & F.col("changes").isNotNull(), "changes not allowed"),
        F.when(F.col("changes").isNotNull() & (F.size(given) == 0), "empty changes"), F.when(empty, "null field"), F.when(F.size(F.array_except(given, F.try_element_at(fields, F.col("kind")))) > 0, "not editable"),
    )
    return verdicts.withColumn("faults", F.filter(faults, lambda x: x.isNotNull()))


def repaired(text: Column, start: Column) -> Column:
    """Struct start, end: a bad start becomes 0, the end follows from the text; an empty text is left to validation."""
    at = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    return F.when(F.length(text) > 0, F.struct(at.alias("start"), (at + F.length(text)).alias("end")))


def as_returned(transcript: Column, quote: Column, speaker: Column) -> Column:
    """Struct text, speaker, start, end: a quote that is not in the transcript is kept with places of its own; an empty one is a space."""
    at = T.first_offset(transcript, quote)
    found = F.struct(quote.alias("text"), F.coalesce(speaker, F.lit("Unknown")).alias("speaker"), at.cast("long").alias("start"), (at + F.length(quote)).cast("long").alias("end"))
    lost = F.struct(quote.alias("text"), F.lit("Unknown").alias("speaker"), F.lit(0).cast("long").alias("start"), F.length(quote).cast("long").alias("end"))
    blank = F.struct(F.lit(" ").alias("text"), F.lit("Unknown").alias("speaker"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))
    return F.when(F.coalesce(quote, F.lit("")) == "", blank).when(at.isNotNull(), found).otherwise(lost)


def prompt(system: str, rules: Column) -> Column:
    """The system prompt, with a block of the rules (best first) if there are any."""
    block = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.when(F.size(rules) > 0, F.concat(F.lit(f"{system}\n\n{GUIDANCE}\n"), block)).otherwise(F.lit(system))


def failure_reason(kind: Column, message: Column) -> Column:
    """Why recognition failed, without a word of the transcript."""
    plain = kind.isin("NoSpeechError", "FileNotFoundError", "DiarizationUnavailableError")
    return F.when(kind == "UnattributableLineError", "asr: the transcript has a line without a speaker prefix").when(plain, F.left(F.concat(F.lit("asr: "), kind, F.lit(": "), message), F.lit(1000))).otherwise(F.concat(F.lit("asr: "), kind))


def finish_reason(reasons: Column, tokens: Column) -> Column:
    """Why generation stopped: what was recorded, else inferred from the number of tokens."""
    inferred = F.concat(F.lit("length (inferred: "), tokens.cast("string"), F.lit(" output tokens = max_tokens; not recorded)"))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).when(tokens >= MAX_TOKENS, inferred).otherwise("not recorded")


def broke_at(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"line (\d+) column", 1), F.lit("")).cast("int")


def collapsed(base: Column, tuned: Column) -> Column:
    """Whether an answer shrank to nothing or to less than a fifth."""
    return (T.strip(tuned) == "") | (F.length(tuned) < COLLAPSED * F.length(base))


def timeline(turns: DataFrame, gap_sec: float) -> DataFrame:
    """turns (call_id, pos, seconds): start and end of each, with a fixed gap between them, to four places."""
    w = Window.partitionBy("call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("seconds") + gap_sec).over(w), F.lit(0.0))
    return turns.select("call_id", "pos", F.round(start, 4).alias("start_sec"), F.round(start + F.col("seconds"), 4).alias("end_sec"))


def lineage(rules: DataFrame) -> DataFrame:
    """rules (rule_id, source_ids, retired): active rules with the rules of one source that went into them."""
    one = rules.filter(F.size("source_ids") == 1).select(F.col("rule_id").alias("ancestor"), F.get("source_ids", 0).alias("source"))
    each = rules.filter("not retired").select("rule_id", F.explode("source_ids").alias("source"))
    return each.join(one, "source").filter("rule_id <> ancestor").select("rule_id", "ancestor").distinct()


def snapshot(rules: DataFrame, calls: DataFrame) -> DataFrame:
    """rules (rule_id, source_ids, retired), calls (source, call_id): active rules with the sorted set of their calls; without any it is empty."""
    each = rules.filter("not retired").select("rule_id", F.explode_outer("source_ids").alias("source"))
    return each.join(calls, "source", "left").groupBy("rule_id").agg(F.array_sort(F.collect_set("call_id")).alias("call_ids"))


def resumed(suspended: DataFrame, submissions: DataFrame) -> DataFrame:
    """suspended (call_id), submissions (call_id, at, submission_id): each suspended call goes on with its first submission, once."""
    first = submissions.groupBy("call_id").agg(F.min(F.struct("at", "submission_id"))["submission_id"].alias("submission_id"), F.count(F.lit(1)).alias("submissions"))
    return suspended.join(first, "call_id", "left").withColumn("status", F.when(F.col("submission_id").isNotNull(), "completed").otherwise("awaiting_review"))


def consolidated(before: DataFrame, after: DataFrame, held: DataFrame) -> DataFrame:
    """Rule ids before, after, and held by open conflicts: what becomes of each. Held rules take no part, so they stay."""
    a, b, h = (df.select("rule_id", F.lit(True).alias(n)) for df, n in ((before, "_a"), (after, "_b"), (held.distinct(), "_h")))
    out = a.join(b, "rule_id", "full").join(h, "rule_id", "left")
    fate = F.when(F.col("_h") & F.col("_a"), "held").when(F.col("_a") & F.col("_b"), "kept").when(F.col("_a"), "retired").otherwise("inserted")
    return out.select("rule_id", fate.alias("fate"))


def comparison(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(call_id, language, score; null if the call failed) on each side: means over the calls where both succeeded, and who failed where."""
    both = base.select("call_id", "language", F.col("score").alias("b")).join(tuned.select("call_id", F.col("score").alias("t")), "call_id")
    shared = F.col("b").isNotNull() & F.col("t").isNotNull()
    mean = lambda c: F.avg(F.when(shared, F.col(c)))
    return both.groupBy("language").agg(
        F.count_if(shared).alias("shared"), F.round(mean("b"), 6).alias("base"), F.round(mean("t"), 6).alias("tuned"), F.round(mean("t") - mean("b"), 6).alias("delta"),
        F.count_if(F.col("b").isNull()).alias("base_failed"), F.count_if(F.col("t").isNull()).alias("tuned_failed"),
    )
