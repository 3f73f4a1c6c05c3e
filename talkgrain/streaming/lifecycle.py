"""The call log as a stream: file source, deduplicated transitions, micro-batches through the grounding pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from talkgrain.operators import evidence


def source(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """At-least-once delivery made idempotent: an event counts once while it may still be repeated."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def claimed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per call and hour: attempts, first and last time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "call_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def analyse(lines: DataFrame, unsupported: int = 1) -> DataFrame:
    """A batch of lines (call_id, language, pos, line) through extraction, grounding and confidence."""
    turns = evidence.split_turns(lines)
    grounded = evidence.ground(evidence.extract(turns, F.lit(unsupported)), evidence.transcript(lines))
    return evidence.confidence(grounded, lines)


def pipeline(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """One micro-batch at a time through analyse; the sink gets each batch with its number, so a repeated batch can be told."""
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(analyse(df), n))
