"""Batches, samples, splits and orders of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.operators import ordered


def batches(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """n consecutive slices of each group, larger ones first."""
    out = ordered.ranked(rows, [group], [order], "_rank", "_size")
    return out.withColumn("batch", ordered.tile(F.col("_rank"), F.col("_size"), n).cast("int")).drop("_rank", "_size")


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """weights (name, ord, weight): shares of total by largest remainder; ties go to the earlier."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("weight") * total / F.sum("weight").over(everything)
    out = weights.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    left = F.lit(total) - F.sum("_f").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc(F.col("_x") - F.col("_f")), "ord"))
    return out.withColumn("_left", left).withColumn("share", (F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_left")


def _draw(seed: int, key: str) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))  # bytes sort as their hex digits do


def _drawn(rows: DataFrame, seed: int, group: str, key: str) -> DataFrame:
    """rows with their place _rank in the group's order by keyed hash, and the group's _size."""
    return ordered.ranked(rows.withColumn("_draw", _draw(seed, key)), [group], ["_draw", key], "_rank", "_size").drop("_draw")


def sample(rows: DataFrame, fraction: float, seed: int, group: str, key: str) -> DataFrame:
    """A fixed share of each group, half-even rounded, drawn by keyed hash."""
    return _drawn(rows, seed, group, key).filter(F.col("_rank") <= F.bround(F.col("_size") * fraction)).drop("_rank", "_size")


def split(rows: DataFrame, fraction: float, seed: int, group: str, key: str) -> DataFrame:
    """rows and part: groups of one are training data; else at least one row of each part."""
    n = F.col("_size")
    val = F.least(F.greatest(F.lit(1), F.bround(n * fraction)), n - 1)
    return _drawn(rows, seed, group, key).withColumn("part", F.when((n >= 2) & (F.col("_rank") <= val), "val").otherwise("train")).drop("_rank", "_size")


def interleave(rows: DataFrame, group: str, order: str, even: bool = False) -> DataFrame:
    """Round robin over groups: turn, then group; with even, only as many turns as the smallest group has."""
    out = ordered.ranked(rows, [group], [order], "turn", "_size")
    if even:
        out = out.join(F.broadcast(out.agg(F.min("_size").alias("_least")))).filter("turn <= _least").drop("_least")  # one row
    return out.drop("_size")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def leaks(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Held-out keys that training data holds; must be empty."""
    return train.join(held_out, key, "left_semi").select(key).distinct()
