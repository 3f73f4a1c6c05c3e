"""Exact similarity search that meets by shuffle: vectors in cells around pivots, cells skipped by the triangle inequality on angles.

Pivots are at most PIVOTS vectors of the searched set, chosen by hash; the result does not depend on them. Every searched
vector lies in the cell of its nearest pivot. A cell's figures (how many vectors, smallest and largest angle to the pivot)
are PIVOTS rows and known to all. A query at angle f to a pivot has no vector of the cell nearer than max(0, f - largest,
smallest - f), so a cell is skipped if the cosine of that is below the threshold or below the k-th best found already.

Neighbouring cells share a block of bounded rows, and a large cell is dealt in several; the queries of a block come in chunks
of bounded rows. One task group is a chunk against a block, whatever the cell's or the query set's size, and is worked off some
pairs at a time. Blocks are about PARTS until they have their most rows, so that what is shuffled grows with the rows and not with
their square until then. Nothing but pivots and cell figures reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.sources import files

#: Pivots at most, vectors that are worth a pivot, numbers in a block of vectors, and how far products in another order of summing may be off.
PIVOTS, PER_PIVOT, BLOCK_NUMBERS, ROUNDING = 256, 64, 1 << 15, 1e-9
#: Blocks that are aimed at, and how many times larger than BLOCK_NUMBERS one may get for that.
PARTS, LARGER = 8, 128
#: Numbers of vectors that are copied at a time, pairs that are looked at a time, visits and found rows that are sent at a time.
COPIED, TILE, SENT = 1 << 20, 1 << 20, 1 << 12
#: Slack of angle bounds: acos near 1 turns a rounding of 1e-16 into 1e-8.
SLACK = 1e-6


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order as Spark's fold does, so equal vectors have equal products."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float)


class Block:
    """Some vectors, with what their cosines need."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = np.sqrt(products(vectors, vectors))
        self.unit = vectors / np.maximum(self.norms, 1e-300)[:, None]

    def cosines(self, at: np.ndarray, other: Block, there: np.ndarray) -> np.ndarray:
        """Of the pairs (at, there), some at a time: their vectors are copied for it."""
        out, step = np.zeros(len(at)), max(1, COPIED // max(1, self.vectors.shape[1]))
        for s in range(0, len(at), step):
            i, j = at[s : s + step], there[s : s + step]
            norm = self.norms[i] * other.norms[j]
            out[s : s + step] = np.where(norm == 0, 0.0, products(self.vectors[i], other.vectors[j]) / np.where(norm == 0, 1.0, norm))
        return out


def whole_rows(mine: Block, block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cosines but for rounding of some of mine with all of the block, and where these start in both."""
    step = max(1, TILE // len(block.norms))
    for s in range(0, len(mine.norms), step):
        yield s, 0, mine.unit[s : s + step] @ block.unit.T


def tiles(mine: Block, block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """As whole_rows, of some of mine with some of the block, in single precision; they are off by single_error at most."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = mine.unit.astype("float32"), block.unit.astype("float32")
        side = max(1, isqrt(TILE // 16))  # a tile that is 16 times as long as high is quickest
        for s in range(0, len(a), side):
            for t in range(0, len(b), max(1, TILE // side)):
                yield s, t, a[s : s + side] @ b[t : t + max(1, TILE // side)].T


def single_error(numbers: int) -> float:
    return (numbers + 8) * 2.0**-23


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bounds(pivots: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The largest cosine that each unit vector may have in each cell; below -1 for an empty one."""
    angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    least = np.maximum(0.0, np.maximum(angle - high, low - angle) - SLACK)
    return np.where(sizes > 0, np.cos(np.minimum(least, np.pi)), -2.0)


def chain(pivots: np.ndarray) -> list[int]:
    """The pivots, each followed by the nearest of those left."""
    left, out = list(range(len(pivots))), []
    while left:
        out.append(left.pop(int(np.argmax(pivots[left] @ pivots[out[-1]])) if out else 0))
    return out


class Cells:
    """rules (rule_id, pos, vec) in blocks of cells; vectors without a direction and null vectors are in none."""

    def __init__(self, rules: DataFrame):
        rows = rules.select("rule_id", "pos", "vec").filter("vec is not null and exists(vec, x -> x <> 0)")
        each = rows.groupBy(F.xxhash64("vec").alias("_h")).agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("_n"))  # a vector that many rows have is one pivot
        total = each.agg(F.sum("_n")).first()[0] or 0
        some = each.orderBy("_h").limit(min(PIVOTS, 1 + total // PER_PIVOT)).select("vec").toPandas()  # bounded
        self.pivots = Block(matrix(some["vec"])).unit if len(some) else np.zeros((0, 1))
        least = max(16, BLOCK_NUMBERS // max(1, self.pivots.shape[1]))
        self.block_rows = min(max(least, total // PARTS), least * LARGER)
        sent, schema = self.pivots, f"rule_id {kind(rules, 'rule_id')}, pos {kind(rules, 'pos')}, vec array<double>, cell int, angle double"

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), SENT):
                    part = f.iloc[at : at + SENT]
                    near = Block(matrix(part["vec"])).unit @ sent.T
                    cell = near.argmax(axis=1)
                    yield part.assign(cell=cell.astype("int32"), angle=np.arccos(np.clip(near[np.arange(len(part)), cell], -1, 1)))

        self.rows = files.kept(rows.mapInPandas(deal, schema)) if len(some) else rows.mapInPandas(deal, schema)
        figures = {r.cell: r for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()} if len(some) else {}
        get = lambda name, other: np.array([getattr(figures[c], name) if c in figures else other for c in range(len(self.pivots))], float)
        self.sizes, self.low, self.high = get("n", 0).astype(int), get("low", 9.0), get("high", -9.0)
        bins: list[list[int]] = []
        for c in chain(self.pivots):
            if not bins or self.sizes[[*bins[-1], c]].sum() > self.block_rows:
                bins.append([])
            bins[-1].append(c)
        self.holds = np.zeros((len(self.pivots), len(bins)), "float32")  # (cell, bin)
        for k, inside in enumerate(bins):
            self.holds[inside, k] = 1
        self.blocks = np.ceil(self.sizes @ self.holds / self.block_rows).astype(int)
        self.first = np.cumsum(self.blocks) - self.blocks
        of_cell = lambda x: F.element_at(F.array(*[F.lit(int(n)) for n in self.holds @ x]), F.col("cell") + 1) if len(self.pivots) else F.lit(1)
        self.dealt = self.rows.select("rule_id", "pos", "vec", (of_cell(self.first) + F.pmod(F.xxhash64("rule_id"), of_cell(np.maximum(1, self.blocks)))).cast("int").alias("block"))

    def visits(self, queries: DataFrame, choose: Callable[..., np.ndarray], but: Callable[..., np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
        """queries (query_id, vec and more) once per block of a bin with a chosen cell: query_id, vec, block; and how many visits blocks have: block, n. choose gives a mask over (query, cell) from the bounds; bins with a cell that `but` gives are left out. Queries with a column `own`, their block, visit it and those after it only."""
        blocks, starts, holds, figures = self.blocks, self.first, self.holds, (self.pivots, self.sizes, self.low, self.high)
        onwards = "own" in queries.columns

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
            for f in frames:
                for at in range(0, len(f), 1024):
                    part = f.iloc[at : at + 1024].reset_index(drop=True)
                    most = bounds(*figures, Block(matrix(part["vec"])).unit)
                    mask = choose(part, most).astype("float32") @ holds > 0
                    if but is not None:
                        mask &= ~(but(part, most).astype("float32") @ holds > 0)
                    yield part, *np.nonzero(mask)

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
            for part, i, k in each(frames):
                for at in range(int(blocks.max(initial=0))):  # the first block of each bin, then the second ones
                    more = blocks[k] > at
                    mine, block = i[more], starts[k[more]] + at
                    if onwards:
                        later = block >= part["own"].to_numpy()[mine]
                        mine, block = mine[later], block[later]
                    yield part, mine, block

        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, mine, block in spread(frames):
                for s in range(0, len(mine), SENT):
                    yield part[columns].iloc[mine[s : s + SENT]].assign(block=block[s : s + SENT].astype("int32"))

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(int(blocks.sum()), int)
            for _, _, block in spread(frames):
                n += np.bincount(block, minlength=len(n))
            yield pd.DataFrame({"block": np.nonzero(n)[0].astype("int32"), "n": n[n > 0]})

        columns = ["query_id", "vec", *(["own"] if onwards else [])]
        load = queries.mapInPandas(count, "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))
        return queries.mapInPandas(visit, f"query_id {kind(queries, 'query_id')}, vec array<double>, {'own int, ' if onwards else ''}block int"), load

    def meet(self, visits: tuple[DataFrame, DataFrame], pick: Callable[..., pd.DataFrame | None], schema: str, look: Callable[..., Iterator[tuple[int, int, np.ndarray]]] = whole_rows) -> DataFrame:
        """Chunks of visits against blocks: pick gets both sides, where a tile that look gives starts in both, the tile's cosines, both sides' ids, the second's pos, and of which of the first this is the own block; it gives the tile's rows, if any."""
        asked, load = visits
        own = F.col("own") if "own" in asked.columns else F.lit(-1)
        load = files.kept(load.select("block", F.ceil(F.col("n") / self.block_rows).cast("int").alias("chunks")))
        with_load = lambda rows: rows.join(F.broadcast(load), "block") if int(self.blocks.sum()) <= 100_000 else rows.join(load, "block")
        asked = with_load(asked).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        held = with_load(self.dealt).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        none = lambda rows, c: F.lit("0").cast(kind(rows, c)).alias(c)  # noqa: E731 null would turn whole numbers of pandas into doubles
        asked = asked.select("block", "chunk", F.lit(True).alias("asks"), (own == F.col("block")).alias("own"), "query_id", none(held, "rule_id"), none(held, "pos"), "vec")
        held = held.select("block", "chunk", F.lit(False).alias("asks"), F.lit(False).alias("own"), none(asked, "query_id"), "rule_id", "pos", "vec")

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sides: dict[bool, list] = {True: [], False: []}
            for f in frames:
                for asks, parts in sides.items():
                    some = f[f["asks"] == asks]
                    if len(some):
                        parts.append((matrix(some["vec"]), some["query_id"].to_numpy(), some["rule_id"].to_numpy(), some["pos"].to_numpy(), some["own"].to_numpy(bool)))
            if not sides[True] or not sides[False]:
                return
            (vectors, ids, _, _, own), (others, _, rules, pos, _) = (list(map(np.concatenate, zip(*sides[asks]))) for asks in (True, False))
            sides.clear()
            mine, block, found, n = Block(vectors), Block(others), [], 0
            for s, t, near in look(mine, block):
                some = pick(mine, block, s, t, near, ids, rules, pos, own)
                if some is None:
                    continue
                found.append(some)
                n += len(some)
                if n >= 16 * SENT:
                    yield pd.concat(found)
                    found, n = [], 0
            if n:
                yield pd.concat(found)

        return asked.unionByName(held).groupBy("block", "chunk").applyInPandas(solve, schema)


def nearest(queries: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """queries (query_id, vec), rules (rule_id, pos, vec): query_id, rule_id, pos, similarity, rank: the k most similar, ties by pos.

    First each query visits its most promising cells until they hold k vectors; then every cell that may beat the k-th best
    of those. Vectors without a direction have similarity 0 to everything, and are added as the first k of them by pos.
    """
    queries = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    rules = rules.filter("vec is not null")
    schema = f"query_id {kind(queries, 'query_id')}, rule_id {kind(rules, 'rule_id')}, pos {kind(rules, 'pos')}, similarity double"
    cells = Cells(rules)
    direct = queries.filter("exists(vec, x -> x <> 0)")
    sizes = cells.sizes

    def promising(most: np.ndarray) -> np.ndarray:
        order = np.argsort(-most, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(most.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (sizes > 0)

    def best(mine: Block, block: Block, start: int, _: int, near: np.ndarray, ids: np.ndarray, rules: np.ndarray, pos: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        n = near.shape[1]
        least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
        i, j = np.nonzero(near >= least[:, None] - ROUNDING)
        c = mine.cosines(i + start, block, j)
        order = np.lexsort((pos[j], -c, i))
        i, j, c = i[order], j[order], c[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, c = i[first], j[first], c[first]
        return pd.DataFrame({"query_id": ids[i + start], "rule_id": rules[j], "pos": pos[j], "similarity": c})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "pos"))
    found = None
    if len(cells.pivots):
        first = files.kept(cells.meet(cells.visits(direct, lambda _, b: promising(b)), best, schema))
        kth = first.withColumn("_r", rank).filter(F.col("_r") == k).select("query_id", F.col("similarity").alias("_kth"))
        again = direct.join(kth, "query_id", "left").withColumn("_kth", F.coalesce("_kth", F.lit(-3.0)))

        def beats(part: pd.DataFrame, most: np.ndarray) -> np.ndarray:
            return (most >= part["_kth"].to_numpy()[:, None] - ROUNDING) & (sizes > 0)

        found = first.unionByName(cells.meet(cells.visits(again, beats, lambda _, b: promising(b)), best, schema))
    zero = rules.filter("not exists(vec, x -> x <> 0)").select("rule_id", "pos").orderBy("pos").limit(k)
    still = rules.select("rule_id", "pos").orderBy("pos").limit(k)
    flat = direct.select("query_id").join(F.broadcast(zero)).unionByName(queries.filter("not exists(vec, x -> x <> 0)").select("query_id").join(F.broadcast(still)))  # k rows each
    flat = flat.withColumn("similarity", F.lit(0.0)).select("query_id", "rule_id", "pos", "similarity")
    found = found.unionByName(flat) if found is not None else flat
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _alike(cells: Cells, asked: DataFrame, threshold: float) -> DataFrame:
    """asked (query_id, vec, and own where they are the searched ones): query_id, rule_id, similarity. Those with their own block meet each other vector once: of their own block those with a higher id, else all."""
    once = "own" in asked.columns

    def alike(mine: Block, block: Block, start: int, first: int, near: np.ndarray, ids: np.ndarray, rules: np.ndarray, pos: np.ndarray, own: np.ndarray) -> pd.DataFrame | None:
        right = near >= threshold - single_error(mine.unit.shape[1])
        if not right.any():
            return None
        i, j = np.nonzero(right)
        i, j = i + start, j + first
        if once:
            right = np.where(own[i], ids[i] < rules[j], ids[i] != rules[j])
            i, j = i[right], j[right]
        c = mine.cosines(i, block, j)
        return pd.DataFrame({"query_id": ids[i], "rule_id": rules[j], "similarity": c})[c >= threshold]

    schema = f"query_id {kind(asked, 'query_id')}, rule_id {kind(cells.rows, 'rule_id')}, similarity double"
    return cells.meet(cells.visits(asked, lambda _, b: b >= threshold - ROUNDING), alike, schema, tiles)


def _cells(rules: DataFrame, threshold: float) -> Cells:
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    return Cells(rules.select("rule_id", F.lit(0).alias("pos"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null"))


def within(queries: DataFrame, rules: DataFrame, threshold: float) -> DataFrame:
    """queries (query_id, vec), rules (rule_id, vec): query_id, rule_id, similarity: all with a cosine of at least the threshold, which must be positive."""
    cells = _cells(rules, threshold)
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and exists(vec, x -> x <> 0)")
    if not len(cells.pivots):
        return asked.filter("false").select("query_id", F.lit(None).cast(kind(rules, "rule_id")).alias("rule_id"), F.lit(0.0).alias("similarity"))
    return _alike(cells, asked, threshold)


def pairs(rules: DataFrame, threshold: float) -> DataFrame:
    """a < b, similarity: all pairs with a cosine of at least the threshold, which must be positive. Each is looked at once."""
    cells = _cells(rules, threshold)
    a, b = F.least("query_id", "rule_id").alias("a"), F.greatest("query_id", "rule_id").alias("b")
    if not len(cells.pivots):
        nothing = rules.filter("false").select(F.col("rule_id").alias("query_id"), "rule_id")
        return nothing.select(a, b, F.lit(0.0).alias("similarity"))
    asked = cells.dealt.select(F.col("rule_id").alias("query_id"), "vec", F.col("block").alias("own"))
    return _alike(cells, asked, threshold).select(a, b, "similarity")


def skipped(queries: DataFrame, rules: DataFrame, threshold: float) -> DataFrame:
    """One row: visited and all (query, cell) pairs of a threshold search, and the share that is skipped."""
    cells = Cells(rules)
    asked = queries.select("query_id", "vec").filter("vec is not null and exists(vec, x -> x <> 0)")
    figures = (cells.pivots, cells.sizes, cells.low, cells.high)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1024):
                yield pd.DataFrame({"n": [int((bounds(*figures, Block(matrix(f["vec"].iloc[at : at + 1024])).unit) >= threshold - ROUNDING).sum())]})

    visits = asked.mapInPandas(visit, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visited"))
    both = visits.join(F.broadcast(asked.agg((F.count(F.lit(1)) * int((cells.sizes > 0).sum())).alias("cells"))))  # one row
    return both.withColumn("skipped", 1 - F.try_divide("visited", "cells"))
