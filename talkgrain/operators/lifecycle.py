"""Calls as a state machine: claiming, legal transitions, the reaper, latest state by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEGAL = (
    ("transcribing", "queued"), ("transcribing", "failed"), ("queued", "processing"), ("processing", "awaiting_review"), ("processing", "completed"),
    ("processing", "queued"), ("processing", "failed"), ("awaiting_review", "completed"),
)
STALE_SECONDS, MAX_RETRIES = 900, 3
TRANSIENT = (408, 429, 500, 502, 503, 504)


def claims(attempts: DataFrame) -> DataFrame:
    """attempts (call_id, worker, at, event_id): the first claim of a call wins, any other finds it taken."""
    n = F.row_number().over(Window.partitionBy("call_id").orderBy("at", "event_id"))
    return attempts.withColumn("attempt", n).withColumn("won", n == 1)


def transitions(log: DataFrame) -> DataFrame:
    """log (call_id, at, event_id, status) and: previous, legal (null for the first)."""
    w = Window.partitionBy("call_id").orderBy("at", "event_id")
    out = log.withColumn("previous", F.lag("status").over(w))
    ok = F.concat_ws(">", "previous", "status").isin([f"{a}>{b}" for a, b in LEGAL])
    return out.withColumn("legal", F.when(F.col("previous").isNotNull(), ok))


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return log.withColumn("_n", n).filter("_n = 1").drop("_n")


def reap(calls: DataFrame, now: Column) -> DataFrame:
    """calls (status, attempts, queued, enqueued, started in seconds) and action: requeue, fail, release or none. Failing is decided before releasing."""
    old = now - STALE_SECONDS
    stale = (F.col("status") == "processing") & (F.col("started") < old)
    action = F.when((F.col("status") == "queued") & (F.coalesce("enqueued", "queued") < old), "requeue").when(stale & (F.col("attempts") >= MAX_RETRIES + 1), "fail").when(stale, "release").otherwise("none")
    return calls.withColumn("action", action)


def backoff(n: Column, base: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), n), F.lit(most))


def error_class(status: Column, message: Column) -> Column:
    return F.when(message.contains("PerDay"), "daily_quota").when(status.isin(*TRANSIENT), "transient").when(message.contains("ValidationError"), "schema").otherwise("permanent")


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Inserts the keys that are not there yet, once each."""
    return current.unionByName(new.dropDuplicates([key]).join(current.select(key), key, "left_anti"))
