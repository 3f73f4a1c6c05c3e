"""Complete linkage without a matrix: mutual nearest neighbours merge, and distances are sparse pairs at or above the threshold.

Complete linkage is reducible: after a merge no cluster is nearer to the merged one than to the nearer of its parts. So the
merge of two clusters that are each other's nearest can happen at once with all other such merges of a round, and the result
is that of merging the globally nearest pair first. Ties follow one order of all pairs: similarity, then the lower number,
then the higher one. A pair that is absent lies below the threshold and can never merge; two clusters stay a pair only if
all pairs of their parts are there, with the least of their similarities.

Equal vectors are one cluster from the start (they are as similar as can be, and equally similar to all others). Components of
the graph of pairs with at most SMALL nodes are solved inside one task by the same rule; larger ones go round by round until
they have fallen apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.operators import ordered, search
from talkgrain.operators.analytics import linked
from talkgrain.sources import files

#: Clusters that one task merges by itself, and rounds between two looks at the components.
SMALL, ROUNDS = 500, 4


def _solve(rows: pd.DataFrame) -> dict[int, int]:
    """node -> the first node of its cluster, from the pairs (a, b, s) of one component."""
    near = {(int(a), int(b)): float(s) for a, b, s in zip(rows["a"], rows["b"], rows["s"])}
    of = {n: n for pair in near for n in pair}
    while near:
        a, b = min(near, key=lambda p: (-near[p], p))
        of = {n: a if c == b else c for n, c in of.items()}
        kept: dict[tuple[int, int], float] = {}
        mine = {(x if y in (a, b) else y): {} for x, y in near if (x in (a, b)) != (y in (a, b))}
        for (x, y), s in near.items():
            inside = (x in (a, b)) + (y in (a, b))
            if inside == 0:
                kept[x, y] = s
            elif inside == 1:
                mine[x if y in (a, b) else y][x if x in (a, b) else y] = s
        for other, s in mine.items():
            if len(s) == 2:
                kept[min(a, other), max(a, other)] = min(s.values())
        near = kept
    return of


def _merged(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of edges (a < b, s): the edges that are left between the merged clusters, and what went (first) into which (keep)."""
    rank = F.struct(F.col("s"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), rank.alias("r")).groupBy("node").agg(F.max("r").alias("r"))
    mutual = files.kept(ends.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select((-F.col("r.x")).alias("keep"), (-F.col("r.y")).alias("gone")))
    moved = mutual.select(F.explode(F.array("keep", "gone")).alias("node"), "keep")
    for end in ("a", "b"):
        edges = edges.join(moved.select(F.col("node").alias(end), F.col("keep").alias(f"_{end}")), end, "left")
    size = lambda c: F.when(F.col(c).isNotNull(), 2).otherwise(1)
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "s", (size("_a") * size("_b")).alias("m")).filter("a <> b")
    edges = files.kept(edges.groupBy("a", "b").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).filter("n = m").select("a", "b", "s"))
    return edges, mutual.select(F.col("gone").alias("first"), "keep")


def link(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """edges (a < b, s: pairs at or above the threshold), nodes (node): node, first (of its cluster).

    Components of at most `small` clusters are finished inside tasks; the others take ROUNDS rounds, in which they shrink and
    fall apart, and are looked at again.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    of = nodes.select("node", F.col("node").alias("first"))

    def follow(moved: DataFrame) -> DataFrame:
        return files.kept(of.join(moved, "first", "left").select("node", F.coalesce("keep", "first").alias("first")))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = _solve(rows)
        return pd.DataFrame({"first": list(found), "keep": list(found.values())})

    edges = files.kept(edges.select("a", "b", "s"))
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        part = linked(edges.select("a", "b"), ends)
        part = part.join(part.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
        inside = files.kept(edges.join(part.select(F.col("node").alias("a"), "cluster", "n"), "a"))
        of = follow(inside.filter(F.col("n") <= small).groupBy("cluster").applyInPandas(solve, f"first {kind}, keep {kind}"))
        edges = files.kept(inside.filter(F.col("n") > small).select("a", "b", "s"))
        for _ in range(ROUNDS):
            if edges.isEmpty():
                break
            edges, moved = _merged(edges)
            of = follow(moved)
    return of


def _numbered(rows: DataFrame, heads: DataFrame, found: DataFrame, small: int) -> DataFrame:
    """rows (rule_id, _same), heads (_same, head), found (a < b, similarity: pairs of heads): rule_id, cluster."""
    of = link(found.select("a", "b", F.col("similarity").alias("s")), heads.select(F.col("head").alias("node")), small)
    firsts = ordered.ranked(of.select("first").distinct(), [], ["first"], "_n", "_size").select("first", (F.col("_n") - 1).cast("int").alias("cluster"))
    heads = heads.join(of.join(firsts, "first").select(F.col("node").alias("head"), "cluster"), "head").select(F.col("_same").alias("_s"), "cluster")
    return rows.join(heads, F.col("_same").eqNullSafe(F.col("_s"))).select("rule_id", "cluster")


def _same(rules: DataFrame, label: Column) -> DataFrame:
    """The rules, pos as a long, and what equal ones have in common; those without a direction are alike nothing."""
    rows = rules.withColumn("pos", F.col("pos").cast("long")).withColumn("_w", label)
    zero = ~F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    alone = F.struct(F.lit(None).cast("array<double>").alias("v"), F.col("pos").alias("p"), F.col("_w").alias("w"))
    return rows.withColumn("_same", F.when(zero, alone).otherwise(F.struct(F.col("vec").cast("array<double>").alias("v"), F.lit(None).cast("long").alias("p"), F.col("_w").alias("w"))))


def clusters(rules: DataFrame, threshold: float, small: int = SMALL, within: str | None = None) -> DataFrame:
    """rules (rule_id, pos, vec): rule_id, cluster, numbered from 0 by their first rules in the order of pos, which must be unique numbers. Rules that differ in the column `within` share no cluster."""
    rows = _same(rules, F.col(within) if within else F.lit(0))
    heads = files.kept(rows.groupBy("_same").agg(F.min("pos").alias("head")))
    found = search.pairs(heads.select(F.col("head").alias("rule_id"), F.col("_same.v").alias("vec")), threshold)
    if within:
        of_head = heads.select("head", F.col("_same.w").alias("w"))
        for end in ("a", "b"):
            found = found.join(of_head.select(F.col("head").alias(end), F.col("w").alias(f"_{end}")), end)
        found = found.filter(F.col("_a").eqNullSafe(F.col("_b")))
    return _numbered(rows, heads, found, small)


def clusters_onwards(rules: DataFrame, threshold: float, known: DataFrame | None = None, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """As clusters, of rules (rule_id, pos, vec, fresh), and the pairs (a < b, similarity) of the first rules of equal vectors, by pos.

    known are such pairs of all rules that are not fresh, whose vectors differ: only the fresh ones are searched then.
    """
    rows = _same(rules, F.lit(0))
    heads = files.kept(rows.groupBy("_same").agg(F.min("pos").alias("head"), F.min(F.when(~F.col("fresh"), F.col("pos"))).alias("old")))
    every = heads.select(F.col("head").alias("rule_id"), F.col("_same.v").alias("vec"))
    if known is None:
        found = search.pairs(every, threshold)
    else:
        pair = (F.least("query_id", "rule_id").alias("a"), F.greatest("query_id", "rule_id").alias("b"), "similarity")
        fresh = heads.filter("old is null").select(F.col("head").alias("query_id"), F.col("_same.v").alias("vec"))
        found = search.within(fresh, every, threshold).filter("query_id <> rule_id").select(*pair).dropDuplicates(["a", "b"])  # two fresh ones find each other
        moved = heads.filter("old is not null")  # a fresh rule with the same vector may come before
        known = known.join(moved.select(F.col("old").alias("a"), F.col("head").alias("query_id")), "a").join(moved.select(F.col("old").alias("b"), F.col("head").alias("rule_id")), "b")
        found = found.unionByName(known.select(*pair))
    found = files.kept(found)
    return _numbered(rows, heads, found, small), found


# --- how alike the members of clusters are ------------------------------------------------------------------------------

#: Numbers in a full block of members, the blocks that a cluster gets before they are full, and the members that are worth one.
BLOCK_NUMBERS, BLOCKS, BLOCK = 1 << 19, 8, 1024
#: Bins of the first count and of an interval, a cluster's pairs that are told at once, and its values that are ranked at last.
FIRST_BINS, BINS, FEW, RANKED = 1 << 17, 4096, 1 << 15, 1 << 19


def _blocks(members: DataFrame) -> DataFrame:
    """members (cluster, vec) and block, blocks (of the cluster), total (pairs of the cluster)."""
    n = F.count(F.lit(1))
    blocks = F.ceil(F.greatest(n * F.max(F.size("vec")) / BLOCK_NUMBERS, F.least(F.lit(float(BLOCKS)), n / BLOCK)))
    sizes = members.groupBy("cluster").agg(blocks.cast("int").alias("blocks"), F.expr("count(1) * (count(1) - 1) div 2").alias("total"))
    return members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rule_id"), F.col("blocks")).cast("int")).drop("rule_id")


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Rows with block and blocks, dealt so that every two members of a cluster meet in one group (cluster, p, q), p <= q."""
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("block", "_o")).withColumn("q", F.greatest("block", "_o")).drop("_o", "blocks")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "p", "q")  # a number, as few bytes are much work


class _Pairs:
    """The pairs that the group of blocks p and q owns, each once, a tile at a time."""

    def __init__(self, rows: pd.DataFrame):
        p, q = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
        sides = [search.matrix(rows.loc[rows["block"] == k, "vec"]) if (rows["block"] == k).any() else np.zeros((0, 1)) for k in (p, q)]
        self.one, self.two = map(search.Block, sides)
        self.same, self.off = p == q, (sides[0].shape[1] + 8) * 2.0**-23  # of sums and bins in single precision

    def tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        """Where a tile starts in the first block, and its cosines with the second in single precision; infinity for what is no pair."""
        if not len(self.one.norms) or not len(self.two.norms):
            return
        a, b = (np.where(x.norms[:, None] > 0, x.unit, 0).astype("float32") for x in (self.one, self.two))
        step = max(1, search.TILE // len(b))
        for s in range(0, len(a), step):
            near = a[s : s + step] @ b.T
            if self.same:
                near[np.arange(len(b)) <= np.arange(s, s + len(near))[:, None]] = np.inf
            yield s, near

    def exact(self, start: int, chosen: np.ndarray) -> np.ndarray:
        i, j = np.nonzero(chosen)
        return self.one.cosines(i + start, self.two, j)

    def inside(self, lo: float, hi: float) -> Iterator[tuple[int, np.ndarray]]:
        """Per tile how many cosines are below lo, and those from lo to hi; only what is near the interval is computed exactly."""
        for s, near in self.tiles():
            under = near < lo - self.off
            c = self.exact(s, ~under & (near <= hi + self.off))
            yield int(under.sum()) + int((c < lo).sum()), c[(c >= lo) & (c <= hi)]


def statistics(members: DataFrame) -> DataFrame:
    """members (cluster, rule_id, vec): cluster, size, least and median of the cosines of all pairs, exactly; null for a single member.

    All pairs are counted in bins, block against block, by products in single precision whose error is bounded. The bins that
    hold the median, widened by that error, are an interval; exact cosines are computed of what may lie in it, and the interval
    shrinks until few values are left, which are told with their counts. No pair leaves its task.
    """
    members = members.select("cluster", "rule_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    finite = members.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))  # others have no cosine
    rows = files.kept(_blocks(finite))
    kind, over = rows.schema["cluster"].dataType.simpleString(), Window.partitionBy("cluster")
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def rough(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, n, least = _Pairs(rows), np.zeros(FIRST_BINS, np.int64), np.inf
        for s, near in pairs.tiles():
            values = near[near < np.inf] if pairs.same else near.ravel()
            if not len(values):
                continue
            n += np.bincount(((values + np.float32(1)) * np.float32(FIRST_BINS / 2)).astype(np.int32).clip(0, FIRST_BINS - 1), minlength=FIRST_BINS)
            first = float(values.min())
            if first - pairs.off < least:
                least = min(least, pairs.exact(s, near <= first + 2 * pairs.off).min())
        bins = np.nonzero(n)[0]
        return pd.DataFrame({"cluster": [rows["cluster"].iloc[0]] * len(bins), "bin": bins, "n": n[bins], "least": least, "off": pairs.off})

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi, below = rows["lo"].iloc[0], rows["hi"].iloc[0], 0
        n, least, most = np.zeros(BINS, np.int64), np.full(BINS, np.inf), np.full(BINS, -np.inf)
        for under, c in _Pairs(rows).inside(lo, hi):
            below += under
            at = np.minimum((c - lo) / (hi - lo) * BINS, BINS - 1).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            np.minimum.at(least, at, c)
            np.maximum.at(most, at, c)
        bins = np.nonzero(n)[0]
        found = {"bin": [-1, *bins], "n": [below, *n[bins]], "low": [lo, *least[bins]], "high": [lo, *most[bins]]}
        return pd.DataFrame({"cluster": [rows["cluster"].iloc[0]] * (len(bins) + 1), **found})

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        below, values, n = 0, np.zeros(0), np.zeros(0, np.int64)
        for under, c in _Pairs(rows).inside(rows["lo"].iloc[0], rows["hi"].iloc[0]):
            below += under
            values, at = np.unique(np.concatenate([values, c]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, np.ones(len(c))]), minlength=len(values)).astype(np.int64)
        return pd.DataFrame({"cluster": [rows["cluster"].iloc[0]] * (len(values) + 1), "value": [-9.0, *values], "n": [below, *n]})

    def each(rows: DataFrame, what: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return _in_pairs(rows.drop("total")).groupBy("cluster", "p", "q").applyInPandas(what, f"cluster {kind}, {schema}")

    def holding(counts: DataFrame) -> DataFrame:
        """The bins with one of the two middle values."""
        counts = counts.withColumn("until", F.sum("n").over(over.orderBy("bin")))
        return counts.filter(F.greatest(low, F.col("until") - F.col("n")) < F.least(high + 1, F.col("until")))

    totals, nothing = rows.select("cluster", "total").distinct(), F.lit(None).cast("double")
    told = totals.filter(F.col("total") <= FEW).select("cluster", "total", F.lit(-2.0).alias("lo"), F.lit(2.0).alias("hi"), nothing.alias("least"))
    counts = files.kept(each(rows.filter(F.col("total") > FEW), rough, "bin long, n long, least double, off double").groupBy("cluster", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("off").alias("off")))
    all_of = counts.groupBy("cluster").agg(F.min("least").alias("least"), F.max("off").alias("off"))
    middle = holding(counts.join(totals, "cluster")).groupBy("cluster").agg(F.min("bin").alias("_p"), F.max("bin").alias("_q"), F.first("total").alias("total")).join(all_of, "cluster")
    more = F.ceil(F.col("off") * FIRST_BINS / 2)
    reach = counts.select("cluster", "bin", "n").join(middle.select("cluster", (F.col("_p") - more).alias("_p"), (F.col("_q") + more).alias("_q")), "cluster").filter("bin between _p and _q").groupBy("cluster").agg(F.sum("n").alias("n"))
    edge = lambda k: F.col(k) * (2 / FIRST_BINS) - 1
    spans = files.kept(middle.join(reach, "cluster").select("cluster", "total", (edge("_p") - F.col("off")).alias("lo"), (edge("_q") + 2 / FIRST_BINS + F.col("off")).alias("hi"), "least", (F.col("n") <= RANKED).alias("done")))
    while True:
        told = told.unionByName(spans.filter("done").drop("done"))
        left = spans.filter("not done")
        if left.isEmpty():
            break
        counts = each(rows.join(left.select("cluster", "lo", "hi"), "cluster"), count, "bin long, n long, low double, high double")
        counts = counts.groupBy("cluster", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        bins = holding(counts.join(left.select("cluster", "total", "least"), "cluster")).groupBy("cluster", "total", "least")
        apart = F.count(F.lit(1)) > 1  # the middle values are the last of one bin and the first of the next
        spans = bins.agg(F.when(apart, F.min("high")).otherwise(F.min("low")).alias("lo"), F.when(apart, F.max("low")).otherwise(F.max("high")).alias("hi"), (apart | (F.sum("n") <= RANKED)).alias("done"))
        spans = files.kept(spans.withColumn("done", F.col("done") | (F.col("lo") == F.col("hi"))))
    told = files.kept(told)
    values = each(rows.join(told.select("cluster", "lo", "hi"), "cluster"), tell, "value double, n long").groupBy("cluster", "value").agg(F.sum("n").alias("n"))
    values = values.join(told.select("cluster", "total", "least"), "cluster").withColumn("until", F.sum("n").over(over.orderBy("value")))
    value = F.when(F.col("value") > -9, F.col("value"))  # the first row counts what is below
    at = lambda k: F.min(F.when(F.col("until") > k, value))
    medians = values.groupBy("cluster").agg(((at(low) + at(high)) / 2).alias("median"), F.coalesce(F.first("least"), F.min(value)).alias("least"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(medians, "cluster", "left").select("cluster", "size", "least", "median")
