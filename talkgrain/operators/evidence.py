"""From lines to grounded claims: turns with offsets, deterministic extraction, grounding, confidence, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T

SUPPORT_THRESHOLD = 0.7


def split_turns(lines: DataFrame) -> DataFrame:
    """lines (call_id, pos, line) and: source_line, line_start (offset in the transcript), speaker, said, script, start_char, end_char."""
    w = Window.partitionBy("call_id").orderBy("pos")
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lines.select("*", F.row_number().over(w).cast("long").alias("source_line"), before.alias("line_start"), T.speaker_of(F.col("line")).alias("speaker"), T.said(F.col("line")).alias("said"))
    start = F.col("line_start") + F.length("line") - F.length(F.regexp_replace("line", "^(?:Agent|Customer):\\s*", ""))
    return out.select("*", T.script_class(F.col("said")).alias("script"), start.alias("start_char"), (start + F.length("said")).alias("end_char"))


def transcript(lines: DataFrame) -> DataFrame:
    """call_id, transcript: the lines in order, one per row of text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy("call_id").agg(F.array_join(parts, "\n").alias("transcript"))


def extract(turns: DataFrame, unsupported: Column) -> DataFrame:
    """Claims without a model: the first two lines of agents as commitments, the first three of customers as sentiment, and `unsupported` more."""
    w = Window.partitionBy("call_id", "speaker").orderBy("pos")
    spoken = turns.filter(F.col("speaker").isNotNull() & (F.col("said") != "")).withColumn("nth", F.row_number().over(w))
    kept = spoken.filter(((F.col("speaker") == "Agent") & (F.col("nth") <= 2)) | ((F.col("speaker") == "Customer") & (F.col("nth") <= 3)))
    kind = F.when(F.col("speaker") == "Agent", "commitment").otherwise("sentiment")
    real = kept.select("call_id", "language", kind.alias("kind"), (F.col("nth") - 1).alias("claim_pos"), F.col("said").alias("quote"))
    calls = turns.select("call_id", "language").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(unsupported, F.lit(1))))).filter(F.col("k") <= unsupported)
    made = calls.select("call_id", "language", F.lit("commitment").alias("kind"), (F.col("k") + 1).alias("claim_pos"), F.concat(F.lit("(unsupported claim "), F.col("k").cast("string"), F.lit(")")).alias("quote"))
    return real.unionByName(made)


def ground(claims: DataFrame, transcripts: DataFrame) -> DataFrame:
    """claims and: kept, start_char (first occurrence), end_char."""
    both = claims.join(transcripts, "call_id", "left")
    at = T.first_offset(F.coalesce("transcript", F.lit("")), F.col("quote"))
    return both.withColumn("start_char", at).withColumn("kept", F.col("start_char").isNotNull()).withColumn("end_char", F.col("start_char") + F.length("quote")).drop("transcript")


def confidence(grounded: DataFrame, calls: DataFrame, threshold: float = SUPPORT_THRESHOLD) -> DataFrame:
    """Per call: proposed, kept, coverage (1 without claims; sentiment does not count), needs_review below the threshold."""
    counts = grounded.filter("kind <> 'sentiment'").groupBy("call_id").agg(F.count(F.lit(1)).alias("proposed"), F.count_if("kept").alias("kept"))
    out = calls.select("call_id", "language").distinct().join(counts, "call_id", "left").fillna(0, ["proposed", "kept"])
    coverage = F.coalesce(F.try_divide(F.col("kept"), F.col("proposed")), F.lit(1.0))
    return out.withColumn("coverage", coverage).withColumn("needs_review", F.col("coverage") < threshold)


def route(error: Column, needs_review: Column) -> Column:
    """escalate on an error or when review is needed or unknown."""
    return F.when(error.isNotNull() | F.coalesce(needs_review, F.lit(True)), "escalate").otherwise("end")


def summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("language").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("proposed").alias("proposed"), F.sum("kept").alias("kept"), F.round(F.avg("coverage"), 6).alias("coverage"), F.count_if("needs_review").alias("escalated")
    )
