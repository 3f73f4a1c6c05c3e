"""Order inside groups of any size without a window per group: range partitions, a count per partition, prefix sums, local row numbers.

Rows are range partitioned by (group, order), so a group that holds a third of all rows is as many partitions as it needs.
The partitioned rows are written once to the shared folder: their partition numbers must not change between the two reads.
What crosses partitions is one small row per (partition, group), at most partitions + groups of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.sources import files


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows and _part: range partitions by keys and order, as a table in the shared folder."""
    spark = rows.sparkSession
    path = files.shared_folder(spark, "ordered")
    out = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of one row per (partition, group); groups may be null."""
    renamed = small.select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in ("_part", *keys)])
    same = renamed["_part"] == rows["_part"]
    for k in keys:
        same = same & rows[k].eqNullSafe(renamed[f"_k_{k}"])
    return rows.join(renamed, same).drop(renamed["_part"]).drop(*[f"_k_{k}" for k in keys])


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """rows, their rank (from 1) in the group by `order`, and the group's size. `order` should name rows uniquely; ties are numbered in any order."""
    rows = placed(rows, keys, order)
    counts = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", *keys, before.alias("_before"), F.sum("_n").over(over).alias(size))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    out = _beside(rows.withColumn("_local", local), counts, keys)
    return out.withColumn(rank, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, back: bool = False) -> DataFrame:
    """rows and the last known value at or before each row in the group's order; with back the first one at or after it."""
    rows = placed(rows.withColumn("_v", value), keys, order)
    one = F.struct(*[F.col(c) for c in order], F.col("_v").alias("_v"))
    ends = rows.filter("_v is not null").groupBy("_part", *keys).agg((F.min(one) if back else F.max(one))["_v"].alias("_end"))
    parts = rows.select("_part", *keys).distinct()
    ends = _all_parts(parts, ends, keys)
    across = Window.partitionBy(*keys).orderBy(F.desc("_part") if back else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.last("_end", ignorenulls=True).over(across)).drop("_end")
    sort = [F.desc(c) if back else F.asc(c) for c in order]
    local = F.last("_v", ignorenulls=True).over(Window.partitionBy("_part", *keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    out = _beside(rows.withColumn("_local", local), ends, keys)
    return out.withColumn(name, F.coalesce("_local", "_from")).drop("_part", "_v", "_local", "_from")


def _all_parts(parts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (partition, group), also of those without a known value."""
    filled = ends.unionByName(parts.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    return filled.groupBy("_part", *keys).agg(F.first("_end", ignorenulls=True).alias("_end"))


def tile(rank: Column, size: Column, n: int) -> Column:
    """ntile(n) of a rank in a group: the first size % n tiles have one row more."""
    q, r = F.floor(size / n), size % n
    wide = r * (q + 1)
    return F.when(rank <= wide, F.floor((rank - 1) / (q + 1)) + 1).otherwise(r + F.floor((rank - 1 - wide) / F.greatest(q, F.lit(1))) + 1)
