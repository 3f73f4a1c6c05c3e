"""The domain's tables, derived from the driver's in one deterministic way; SQL has the same rules for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("ar", "en", "mixed")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category(column: str):
    return F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.pmod(F.col(column), F.lit(3)) + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, language, pos, line: one line per turn, prefixed unless it is the system's."""
    t = F.regexp_replace("text", "[\\r\\n]+", " ")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Customer: "), t)).when(F.col("role") == "assistant", F.concat(F.lit("Agent: "), t)).otherwise(t)
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), category("conv_id").alias("language"), F.col("turn").alias("pos"), line.alias("line"))


TURNS_SQL = r"""turns AS (
    SELECT conv_id AS call_id, ['ar', 'en', 'mixed'][(conv_id % 3 + 1)::INT] AS language, turn AS pos,
           CASE role WHEN 'user' THEN 'Customer: ' WHEN 'assistant' THEN 'Agent: ' ELSE '' END || regexp_replace(text, '[\r\n]+', ' ', 'g') AS line
    FROM conversations)"""


def scores(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """call_id, language, criterion, score: rubric scores of a prediction or a reference."""
    score = F.col("l_discount") * 10 if side == "reference" else F.least(F.lit(1.0), F.col("l_discount") * 10 + F.col("l_tax"))
    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 7")
    rows = rows if side == "reference" else rows.filter("l_orderkey % 5 <> 0 or l_linenumber > 2")
    return rows.select(F.col("l_orderkey").alias("call_id"), category("l_orderkey").alias("language"), F.col("l_linenumber").alias("criterion"), score.alias("score"), F.col("l_suppkey").alias("pos"))


SCORES_SQL = """refs AS (SELECT l_orderkey AS call_id, ['ar', 'en', 'mixed'][(l_orderkey % 3 + 1)::INT] AS language, l_linenumber AS criterion, l_discount * 10 AS score, l_suppkey AS pos FROM lineitem WHERE l_linenumber <= 7),
preds AS (SELECT l_orderkey AS call_id, ['ar', 'en', 'mixed'][(l_orderkey % 3 + 1)::INT] AS language, l_linenumber AS criterion, least(1.0, l_discount * 10 + l_tax) AS score, l_suppkey AS pos
          FROM lineitem WHERE l_linenumber <= 7 AND (l_orderkey % 5 <> 0 OR l_linenumber > 2))"""


def segments(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """call_id, pos, speaker or text, start_sec, end_sec: intervals of a user's events, of two interleaved kinds."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "events").filter("event_type in ('click', 'view')" if kind == "asr" else "event_type in ('purchase', 'signup', 'error')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    out = rows.select(F.col("user_id").alias("call_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("event_type").alias("name"), start.alias("start_sec"), F.lead(start).over(w).alias("end_sec"))
    return out.filter("end_sec is not null")


def segments_sql(kind: str, name: str) -> str:
    types = "('click', 'view')" if kind == "asr" else "('purchase', 'signup', 'error')"
    return f"""{name} AS (SELECT * FROM (
        SELECT user_id AS call_id, row_number() OVER w - 1 AS pos, event_type AS name, epoch_us(ts) / 1e6 AS start_sec, lead(epoch_us(ts) / 1e6) OVER w AS end_sec
        FROM events WHERE event_type IN {types} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE end_sec IS NOT NULL)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's rows as the claims of a call, numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("call_id", F.col("l_orderkey")).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


CLAIMS_SQL = "c AS (SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, * FROM lineitem)"
