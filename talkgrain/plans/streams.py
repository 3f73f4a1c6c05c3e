"""Registered queries that run as streams with state and end with the rows of their batch forms. Importing this registers them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.operators import lifecycle
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import STATUS_SQL, _status, query
from talkgrain.sources import files
from talkgrain.streaming import states

#: Pieces of a log, in the order of time, and the least files of each; a micro-batch reads one piece.
PIECES, FILES = 4, 4


def files_of_piece(spark: SparkSession) -> int:
    """As many as can be written at once, so that more machines write and read a piece sooner."""
    return max(FILES, spark.sparkContext.defaultParallelism)


def in_pieces(rows: DataFrame, at: str, folder: str) -> None:
    """A log as files that arrive piece by piece in the order of time."""
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    for k in range(PIECES if lo is not None else 0):
        a, z = lo + (hi - lo) * k / PIECES, lo + (hi - lo) * (k + 1) / PIECES
        piece = rows.filter((F.col(at) >= a) & ((F.col(at) <= z) if k + 1 == PIECES else (F.col(at) < z)))
        piece.repartition(files_of_piece(rows.sparkSession)).write.mode("append").parquet(folder)


def _log(spark: SparkSession, sf_dir: str, home: str) -> DataFrame:
    """The events as a stream: event_id, call_id, at, status, attempts."""
    e = fx.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("call_id"), F.col("ts").cast("timestamp").alias("at"), _status().alias("status"), F.pmod("event_id", F.lit(6)).alias("attempts"))
    in_pieces(e, "at", f"{home}/in")
    return states.session(spark).readStream.schema(e.schema).option("maxFilesPerTrigger", files_of_piece(spark)).parquet(f"{home}/in")


@query(f"""WITH s AS (SELECT event_id, user_id AS call_id, ts, {STATUS_SQL} AS status FROM events), l AS (SELECT *, row_number() OVER w AS attempt, lag(status) OVER w AS previous FROM s WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id))
    SELECT event_id, call_id, attempt, attempt = 1 AS won, status, previous, CASE WHEN previous IS NOT NULL THEN previous || '>' || status IN ({", ".join(f"'{a}>{b}'" for a, b in lifecycle.LEGAL)}) END AS legal FROM l""")
def streamed_transitions(spark, sf_dir):
    """STR-02, STR-03, STR-08: claims and guarded transitions from the state of each call, as its events come in."""
    home = files.shared_folder(spark, "transitions")
    states.run(states.transitions(_log(spark, sf_dir, home)), f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out")


@query(f"""WITH c AS (SELECT event_id, {STATUS_SQL} AS status, event_id % 6 AS attempts, epoch_us(ts) / 1e6 AS t FROM events), n AS (SELECT max(t) - 100000 AS now FROM c)
    SELECT event_id AS call_id, status, CASE WHEN status = 'queued' THEN 'requeue' WHEN attempts >= 4 THEN 'fail' ELSE 'release' END AS action FROM c, n WHERE status IN ('queued', 'processing') AND t < now - 900""")
def streamed_reaping(spark, sf_dir):
    """STR-07, DAT-04: timers of event time requeue, release or fail the calls that the watermark, 100000 seconds behind, has left waiting; each event is a call here."""
    home = files.shared_folder(spark, "reaper")
    log = _log(spark, sf_dir, home).select(F.col("event_id").alias("call_id"), "at", "status", "attempts")
    states.run(states.reaped(log, "100000 seconds"), f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out")


@query("""WITH s AS (SELECT o_orderkey AS call_id FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT l_orderkey AS call_id, arg_min(l_suppkey, l_shipdate::VARCHAR || lpad(l_suppkey::VARCHAR, 9, '0')) AS submission_id, count(*) AS submissions FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
    SELECT call_id, submission_id, submissions, CASE WHEN submission_id IS NULL THEN 'awaiting_review' ELSE 'completed' END AS status FROM s LEFT JOIN f USING (call_id)""")
def streamed_resumption(spark, sf_dir):
    """STR-06: suspended calls and submissions as two streams that meet by call within a bound of time; every submission is delivered twice, out of order inside a piece, and counts once."""
    home = files.shared_folder(spark, "resumption")
    o, li = fx.read(spark, sf_dir, "orders"), fx.read(spark, sf_dir, "lineitem")
    s = o.select("o_orderkey", "o_orderstatus").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("call_id"), F.timestamp_seconds(F.lit(788832000) + F.col("o_orderkey") % 86400).alias("at"))  # the day before the first submission
    place = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    delivery = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in place])  # numbers, so no text is that of two deliveries
    r = li.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_suppkey").alias("submission_id"), delivery.alias("delivery_id"))
    twice = r.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    for rows, name in ((s, "suspended"), (twice, "submissions")):
        in_pieces(rows, "at", f"{home}/{name}")
        end = rows.agg((F.max("at") + F.expr("interval 9000 days")).alias("at")).select(*[F.col("at") if c == "at" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        end.write.mode("append").parquet(f"{home}/{name}")  # the end of the log moves the watermark past all of it
    own = states.session(spark)
    stream = lambda rows, name: own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_of_piece(spark)).parquet(f"{home}/{name}")
    states.run(states.reviews(stream(s, "suspended"), stream(r, "submissions"), dt.timedelta(days=700), dt.timedelta(days=3000)), f"{home}/out", f"{home}/checkpoint")
    return states.resumed(spark.read.parquet(f"{home}/out").filter("call_id is not null"))
