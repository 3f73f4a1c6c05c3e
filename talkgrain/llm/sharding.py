"""Sharding by jump consistent hashing (built-in functions only): no ring table, and one more shard takes rows only into itself.

The key of a row is the first 64 bits of md5 of its id as text, so nothing but the id and the number of shards decides.
Slots count from 0 in each shard without gaps; they come from a prefix sum over (shard, chunk), so no task ever holds a shard.

Defined results: null text has no bytes; a null id is hashed as the empty string; repeated rows get slots of their own;
an empty table gives an empty result; other columns are ignored, whatever their names; texts of any length are read whole, and not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the rows of a shard are divided for numbering.
CHUNKS = 1024

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def hash_key(id_col: str | Column) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """The shard of an unsigned 64-bit key. Each jump goes forward by one at least, so `shards` steps always suffice; those after the last jump do nothing."""
    start = F.struct(key.cast("decimal(20,0)").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, _: Column) -> Column:
        key = F.expr("cast(2862933555777941757 as decimal(19,0))") * s["key"] + F.lit(1)
        key = (key % F.expr("cast(18446744073709551616 as decimal(20,0))")).cast("decimal(20,0)")
        top = F.floor(key / F.expr("cast(8589934592 as decimal(10,0))")).cast("double") + F.lit(1.0)
        to = F.floor((s["to"] + 1).cast("double") * (F.lit(2147483648.0) / top)).cast("long")
        jumped = F.struct(key.alias("key"), s["to"].alias("at"), to.alias("to"))
        return F.when(s["to"] < shards, jumped).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot, grown_shard (with one shard more)."""
    key, text = hash_key(id_col), F.coalesce(text_col, F.lit(""))
    chunk = F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), chunk.alias("_chunk"), key.alias("_key"))
    rows = rows.select("*", jump(F.col("_key"), shards).alias("shard")).select("*", F.when(F.col("shard").isNotNull(), jump(F.col("_key"), shards + 1)).alias("grown_shard"))
    counts = docs.select(chunk.alias("_ochunk"), jump(key, shards).alias("_oshard")).groupBy("_oshard", "_ochunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_oshard").orderBy("_ochunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_oshard", "_ochunk", before.alias("_before")))  # shards x chunks rows at most
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(id_col, "text_crc32")) - 1
    out = rows.withColumn("_place", place).join(offsets, (F.col("shard") == F.col("_oshard")) & (F.col("_chunk") == F.col("_ochunk")))
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
