"""Transcripts made usable, selections, and training sets with reasons, a manifest and a guard that refuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators import datasets, evidence, ordered
from talkgrain.sources import files

#: Why an example does not train, in the order in which it is asked.
REASONS = ("held_out", "not_in_corpus", "no_target", "repeated")


def parsed(lines: DataFrame, repairs: DataFrame) -> DataFrame:
    """lines (call_id, pos, line), repairs (call_id, source_line, speaker, strip): call_id, source_line, speaker, text, fault.

    A line with a speaker's prefix is a turn; one without needs a repair, whose speaker it gets once the wrong prefix `strip` is
    gone, or which drops it (no speaker). Blank lines and empty turns are dropped. A line without prefix and repair is a row
    with its fault, so that nothing is guessed.
    """
    turns = evidence.split_turns(lines).select("call_id", "source_line", T.strip(F.col("line")).alias("_line"))
    turns = turns.withColumn("speaker", T.speaker_of(F.col("_line"))).withColumn("said", T.said(F.col("_line")))
    known = repairs.select("call_id", F.col("source_line").cast("long").alias("source_line"), F.col("speaker").alias("_speaker"), F.coalesce("strip", F.lit("")).alias("_strip"), F.lit(True).alias("_known"))
    both = turns.filter("_line <> ''").join(known, ["call_id", "source_line"], "left")
    cut = F.when(F.startswith("_line", F.col("_strip")), F.substring(F.col("_line"), F.length("_strip") + 1, F.length("_line"))).otherwise(F.col("_line"))
    own = F.col("speaker").isNotNull()
    both = both.withColumn("text", F.when(own, F.col("said")).when(F.col("_known"), T.strip(cut)))
    both = both.withColumn("fault", F.when(~own & F.col("_known").isNull(), F.concat(F.lit("no speaker: "), F.left("_line", F.lit(80)))))
    both = both.filter("fault is not null or (text <> '' and (speaker is not null or _speaker is not null))")
    return both.select("call_id", "source_line", F.coalesce("speaker", "_speaker").alias("speaker"), "text", "fault")


def usable(turns: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """parsed turns, calls (call_id, language): the first n calls of each language that have turns and no fault: call_id, language, place."""
    fine = turns.groupBy("call_id").agg(F.count("fault").alias("_f")).filter("_f = 0").select("call_id")
    return first_n(calls.join(fine, "call_id", "left_semi"), n, "language", "call_id")


def first_n(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The first n rows of each group, with their place."""
    return ordered.ranked(rows, [group], [order], "place", "_size").filter(F.col("place") <= n).drop("_size")


def selected(calls: DataFrame, ids: DataFrame | None = None, languages: list[str] | None = None, per_language: int | None = None, limit: int | None = None) -> DataFrame:
    """calls (call_id, language): those of ids, of the languages, the first per language, and the first of what is left, in that order; what is not given selects all. Ids that are no call are an error."""
    out = calls
    if ids is not None:
        unknown = ids.select("call_id").distinct().join(calls, "call_id", "left_anti").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(ids.select("call_id").distinct(), "call_id", "left_semi").join(F.broadcast(unknown))  # one row
        out = out.withColumn("call_id", F.when(F.col("_n") > 0, F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" ids are no call"))).cast(calls.schema["call_id"].dataType)).otherwise(F.col("call_id"))).drop("_n")
    if languages is not None:
        out = out.filter(F.col("language").isin(languages))
    if per_language is not None:
        out = first_n(out, per_language, "language", "call_id").drop("place")
    return out if limit is None else out.orderBy("call_id").limit(limit)


def training_examples(examples: DataFrame, corpus: DataFrame, held_out: DataFrame, fraction: float, seed: int) -> DataFrame:
    """examples (call_id, location, target, source, topic, pos), corpus and held_out (call_id): each with the reason that drops it (null: none) and the part it trains in.

    Reasons are asked in the order of REASONS; of repeated (call, location, target) the first by pos stays. A held-out call
    among what trains stops the job.
    """
    mark = lambda df, name: df.select("call_id").distinct().withColumn(name, F.lit(True))
    rows = examples.join(mark(held_out, "_held"), "call_id", "left").join(mark(corpus, "_known"), "call_id", "left")
    reason = F.when(F.col("_held"), "held_out").when(F.col("_known").isNull(), "not_in_corpus").when(F.col("target").isNull(), "no_target")
    rows = rows.withColumn("dropped", reason).drop("_held", "_known")
    first = F.min("pos").over(Window.partitionBy("call_id", "location", "target", "dropped"))
    rows = rows.withColumn("dropped", F.when(F.col("dropped").isNull() & (F.col("pos") != first), "repeated").otherwise(F.col("dropped")))
    rows = files.kept(guarded(rows, held_out, "dropped"))
    fresh = datasets.split(rows.filter("dropped is null"), fraction, seed, "topic", "pos")
    return fresh.unionByName(rows.filter("dropped is not null"), allowMissingColumns=True)


def guarded(train: DataFrame, held_out: DataFrame, column: str = "part") -> DataFrame:
    """train as it is; a row of a held-out call stops the job with its name. With column `dropped`, rows that have a reason there don't train."""
    held = held_out.select(F.col("call_id").alias("_held")).distinct()
    checked = train.join(held, F.col("call_id") == F.col("_held"), "left")
    stop = F.raise_error(F.concat(F.lit("held-out call in training data: "), F.col("_held").cast("string"))).cast("string")
    trains = F.col("dropped").isNull() if column == "dropped" else F.lit(True)
    return checked.withColumn(column, F.when(trains & F.col("_held").isNotNull(), stop).otherwise(F.col(column))).drop("_held")


def manifest(examples: DataFrame) -> DataFrame:
    """Per source of training_examples: examples, train, val, and how many each reason dropped."""
    return examples.groupBy("source").agg(F.count(F.lit(1)).alias("examples"), *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val")], *[F.count_if(F.col("dropped") == r).alias(r) for r in REASONS])
