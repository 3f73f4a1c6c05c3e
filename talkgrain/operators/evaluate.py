"""Whole evaluation runs: failures by name beside the four metrics, grounding under two views of a text, verdicts to corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import redact as R
from talkgrain.functions import text as T


def run(calls: DataFrame, accuracy: DataFrame, rubric: DataFrame, quotes: DataFrame) -> DataFrame:
    """calls (call_id, language, error), accuracy and rubric (call_id, value), quotes (call_id, kind, supported): per language the calls, those scored, those failed, and four metrics over the scored ones.

    Accuracy and rubric agreement are means of calls (a call without shared criteria counts 0), grounding precision and the
    unsupported rate pool quotes; sentiment is no claim. What has nothing to count is null.
    """
    ok = calls.filter("error is null").select("call_id", "language")
    totals = calls.groupBy("language").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNull()).alias("scored"), F.count("error").alias("failed"))
    scored = ok.join(accuracy.withColumnRenamed("value", "_a"), "call_id", "left").join(rubric.withColumnRenamed("value", "_r"), "call_id", "left")
    means = scored.groupBy("language").agg(F.round(F.avg("_a"), 6).alias("accuracy"), F.round(F.avg(F.coalesce("_r", F.lit(0.0))), 6).alias("rubric_agreement"))
    claim = F.when(F.col("kind") != "sentiment", F.col("supported").cast("double"))
    pooled = quotes.join(ok, "call_id").groupBy("language").agg(F.round(F.avg(F.col("supported").cast("double")), 6).alias("grounding_precision"), F.round(1 - F.avg(claim), 6).alias("unsupported_rate"))
    return totals.join(means, "language", "left").join(pooled, "language", "left")


def failures(calls: DataFrame) -> DataFrame:
    """The failed calls of calls (call_id, language, error), each with its reason; never the transcript."""
    return calls.filter("error is not null").select("call_id", "language", F.substring("error", 1, 1000).alias("reason"))


def grounding_views(quotes: DataFrame) -> DataFrame:
    """quotes (language, kind, transcript, quote): precision and unsupported rate under the raw and the redacted transcript, one row per language and view."""
    views = F.array(F.struct(F.lit("raw").alias("view"), F.col("transcript").alias("t")), F.struct(F.lit("redacted").alias("view"), R.redacted(F.col("transcript"))["text"].alias("t")))
    rows = quotes.select("language", "kind", "quote", F.explode(views).alias("v")).select("language", "kind", "v.view", T.is_verbatim(F.col("v.t"), F.col("quote")).cast("double").alias("ok"))
    claim = F.when(F.col("kind") != "sentiment", F.col("ok"))
    return rows.groupBy("language", "view").agg(F.count(F.lit(1)).alias("quotes"), F.round(F.avg("ok"), 6).alias("grounding_precision"), F.round(1 - F.avg(claim), 6).alias("unsupported_rate"))


def planned_corrections(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """verdicts (call_id, claim_id `list[i]`, verdict, patch, note), claims (call_id, list, items: array): per call and list the items after all verdicts on them, how many were corrected and rejected, and the notes joined by blank lines.

    Indexes are those of the list before any verdict: rejected items go, corrected ones are patched, all at once. A verdict on
    an item that is not there is listed in `unknown`.
    """
    at = F.regexp_extract("claim_id", "^(\\w+)\\[(\\d+)\\]$", 2)
    v = verdicts.select("call_id", "claim_id", F.regexp_extract("claim_id", "^(\\w+)\\[(\\d+)\\]$", 1).alias("list"), at.cast("int").alias("i"), "verdict", "patch", "note").filter("list <> ''")
    per = v.groupBy("call_id", "list").agg(F.array_sort(F.collect_list(F.struct("i", "verdict", "patch", "note", "claim_id"))).alias("_v"))
    both = claims.join(per, ["call_id", "list"], "left").withColumn("_v", F.coalesce("_v", F.array()))

    def after(x: Column, i: Column) -> Column:
        mine = F.get(F.filter("_v", lambda w: w["i"] == i), 0)
        return F.struct(F.coalesce(mine["verdict"], F.lit("confirm")).alias("verdict"), F.when(mine["verdict"] == "correct", mine["patch"]).otherwise(x).alias("x"))

    both = both.withColumn("_after", F.transform("items", after))
    n = lambda verdict: F.size(F.filter("_after", lambda a: a["verdict"] == verdict))
    notes = F.array_compact(F.transform("_v", lambda w: F.nullif(F.trim(w["note"]), F.lit(""))))
    both = both.withColumn("_n", F.size("items"))  # of the list before any verdict
    unknown = F.transform(F.filter("_v", lambda w: w["i"] >= F.col("_n")), lambda w: w["claim_id"])
    left = F.transform(F.filter("_after", lambda a: a["verdict"] != "reject"), lambda a: a["x"])
    return both.select("call_id", "list", left.alias("items"), n("correct").alias("corrected"), n("reject").alias("rejected"), F.array_join(notes, "\n\n").alias("notes"), unknown.alias("unknown"))


def compared(base: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """base and other (call_id, language, error, and the named metrics): per language and metric the means over the calls that neither arm failed, and their difference; calls of one arm alone do not count."""
    both = base.select("call_id", "language", F.col("error").alias("_e"), *[F.col(n).alias(f"_b_{n}") for n in names]).join(other.select("call_id", F.col("error").alias("_f"), *[F.col(n).alias(f"_o_{n}") for n in names]), "call_id")
    fine = both.filter("_e is null and _f is null")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_b_{n}").alias("b"), F.col(f"_o_{n}").alias("o")) for n in names]))
    rows = fine.select("language", each.alias("m")).select("language", "m.*")
    return rows.groupBy("language", "metric").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("b"), 6).alias("base"), F.round(F.avg("o"), 6).alias("other"), F.round(F.avg("o") - F.avg("b"), 6).alias("delta"))


def outcomes(base: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """Per call of either arm: both_failed, base_failed, other_failed, better, worse or same by the metric, and the difference where both succeeded."""
    both = base.select("call_id", F.lit(True).alias("_b"), F.col("error").alias("_e"), F.col(metric).alias("_x")).join(other.select("call_id", F.lit(True).alias("_o"), F.col("error").alias("_f"), F.col(metric).alias("_y")), "call_id", "full")
    no_b, no_o = F.col("_b").isNull() | F.col("_e").isNotNull(), F.col("_o").isNull() | F.col("_f").isNotNull()
    delta = F.when(~no_b & ~no_o, F.round(F.col("_y") - F.col("_x"), 6))
    outcome = F.when(no_b & no_o, "both_failed").when(no_b, "base_failed").when(no_o, "other_failed").when(delta > 0, "better").when(delta < 0, "worse").otherwise("same")
    return both.select("call_id", outcome.alias("outcome"), delta.alias("delta"))


def captured(differences: DataFrame, predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """differences (call_id, difference: an error location or null), predicted and reference (call_id, location, value): a correction per call that differs: location, topic, original, corrected (null where a side has nothing there)."""
    found = differences.filter("difference is not null").select("call_id", F.col("difference").alias("location"))
    out = found.join(predicted.select("call_id", "location", F.col("value").alias("original")), ["call_id", "location"], "left")
    out = out.join(reference.select("call_id", "location", F.col("value").alias("corrected")), ["call_id", "location"], "left")
    return out.select("call_id", "location", T.topic(F.col("location")).alias("topic"), "original", "corrected")


def forcing(pairs: DataFrame) -> DataFrame:
    """pairs (call_id, language, reference, forced, detected: two hypotheses): per call both word error rates, and which hypothesis is better."""
    from talkgrain.operators import metrics

    rate = lambda side: metrics.word_errors(pairs.select("call_id", "language", "reference", F.col(side).alias("hypothesis"))).select("call_id", "language", F.round("wer", 6).alias(f"{side}_wer"))
    both = rate("forced").join(rate("detected").drop("language"), "call_id")
    return both.withColumn("better", F.when(F.col("forced_wer") < F.col("detected_wer"), "forced").when(F.col("forced_wer") > F.col("detected_wer"), "detected").otherwise("same"))
