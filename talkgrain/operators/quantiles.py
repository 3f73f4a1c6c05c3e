"""Exact quantiles without a group's values in one reducer.

A mergeable sketch per group brackets each wanted order statistic; one more pass counts, per group and quantile, the rows
below the bracket and the distinct values inside it, both combined before the shuffle. Only a bracket's values are ranked.
The sketch errs by at most n / ACCURACY ranks and brackets are MARGIN times as wide; should a bracket miss all the same, the
job stops instead of giving another number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of at most SMALL values are ranked whole, as brackets would hold too few of them.
ACCURACY, MARGIN, SMALL = 2000, 4, 10_000


def exact_quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], at: tuple[float, ...] = (0.5, 0.95), digits: int = 6) -> DataFrame:
    """keys, and per name of values an array: its quantiles at `at`, interpolated between neighbours; nulls do not count; null for none. Groups without any row are absent."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])
    long = rows.select(*keys, F.explode(named).alias("x")).select(*keys, "x.name", "x.v")
    some = long.filter("v is not null")
    group = [*keys, "name"]
    ends = [min(1.0, max(0.0, q + s * MARGIN / ACCURACY)) for q in at for s in (-1, 1)]
    sketch = some.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e"))
    large = F.col("n") > SMALL
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("p"), F.when(large, F.get("e", 2 * i)).otherwise(F.lit(float("-inf"))).alias("lo"), F.when(large, F.get("e", 2 * i + 1)).otherwise(F.lit(float("inf"))).alias("hi")) for i, q in enumerate(at)])
    sketch = sketch.select(*group, F.explode(wanted).alias("w")).select(*group, "w.*")
    met = _join(some, sketch, group).filter("v <= hi")
    counts = met.groupBy(*group, "i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("p").alias("p"))
    until = F.sum("c").over(Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("v")))
    counts = counts.withColumn("until", until).withColumn("k0", F.floor("p")).withColumn("k1", F.ceil("p"))
    value = lambda k: F.min(F.when(F.col("until") > F.col(k), F.struct(F.col("until").alias("u"), "v")))["v"]
    picked = counts.groupBy(*group, "i").agg(F.first("p").alias("p"), F.first("k0").alias("k0"), F.first("k1").alias("k1"), value("k0").alias("v0"), value("k1").alias("v1"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    number = F.when(F.col("k0") == F.col("k1"), F.col("v0")).otherwise((F.col("k1") - F.col("p")) * F.col("v0") + (F.col("p") - F.col("k0")) * F.col("v1"))
    picked = picked.withColumn("q", F.round(F.when(F.col("v0").isNull() | F.col("v1").isNull(), missed).otherwise(number), digits))
    found = picked.groupBy(*keys).agg(*[F.array(*[F.max(F.when((F.col("name") == n) & (F.col("i") == i), F.col("q"))) for i in range(len(at))]).alias(n) for n in values])
    groups = rows.select(*keys).distinct()
    return _join(groups, found, keys, "left")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By keys that may be null. right has few rows per group; whether it is small enough to broadcast is left to its measured size, and a skewed key to adaptive splitting."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def with_quantiles(figures: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column], names: dict[str, tuple[str, str]]) -> DataFrame:
    """figures (one row per group of rows) with p50 and p95 of each value under the given names."""
    found = exact_quantiles(rows, keys, values)
    out = _join(figures, found, keys, "left")
    for value, (p50, p95) in names.items():
        out = out.withColumn(p50, F.get(value, 0)).withColumn(p95, F.get(value, 1)).drop(value)
    return out
