"""Shared plumbing of the training-data operators: scratch tables, size-checked joins, hot-group joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract of this subpackage defines it.
SPACE = "[\\x20\\x09-\\x0D]"

#: Bytes that a side may have to be sent to every executor; beyond them the join shuffles.
BROADCAST_BYTES = 64 << 20

#: What a row costs in the hash table of a broadcast besides its strings and arrays.
ROW_COST = 96

#: A group is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests on one machine, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Scopes that are open, innermost last; each holds the scratch folders made inside.
_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes the scratch tables that operators make inside. What is kept of their results must have been written before the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            made.drop("")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what is run inside: for rows that hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage, survive executors and can be dropped when used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/talkgrain/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Deletes tables; the empty name is all of them."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_of(column: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it; inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """A scratch table, marked for broadcast if it takes at most `limit` bytes; and whether it does."""
    size = F.lit(ROW_COST).cast("long")
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind.startswith("array<"):
            size += 8 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0))
    small = (df.agg(F.sum(size)).first()[0] or 0) <= limit
    return (F.broadcast(df) if small else df), small


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, where a few groups may hold most rows.

    groups: columns key, size (rows in that group) and more. Groups above total / HOT_SHARE are fewer than HOT_SHARE, a
    proven bound, and are broadcast; their rows then get salted keys that match nothing, so the shuffle join of the
    others is even. `spread` is a column of rows that spreads them, such as an id. Rows of no group get nulls;
    rows without a key are spread as well.
    """
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > max(1, total // HOT_SHARE))
    hot = F.broadcast(hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values], F.lit(True).alias("_hot")))
    cold = groups.filter(F.col(size) <= max(1, total // HOT_SHARE))
    zero = F.pmod(F.col(size), F.lit(1)).cast("int")  # not a literal, or the optimizer would take the salt out of the join keys
    cold = cold.select(F.col(key).alias("_ck"), zero.alias("_cs"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = rows.join(hot, F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(65_536)).cast("int") + 1).otherwise(0))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])
