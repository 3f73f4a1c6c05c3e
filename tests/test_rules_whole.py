"""Rules and links over whole tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import analytics, linkage, rules, search
from talkgrain.plans import registry, views  # noqa: F401


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Vectors in tight and loose groups with copies and zeros, with ids beyond every former bound; orders that link in chains."""
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + rng.normal(size=(400, 8)) * rng.choice([0.0, 0.3, 0.8], size=(400, 1))
    v[7] = 0.0
    ids = [5 * k for k in range(400)]
    home = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, i // 5 % 7, [float(x) for x in np.float32(r)]) for i, r in zip(ids, v)], "vec_id long, label long, embedding array<float>").write.parquet(f"{home}/embeddings.parquet")
    orders = [(1000 + k, k * k % 1201) for k in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{home}/orders.parquet")
    return str(home), ids, np.float32(v).astype(float), orders


def cosines(v):
    dots = np.zeros((len(v), len(v)))
    for d in range(v.shape[1]):
        dots += np.outer(v[:, d], v[:, d])
    norm = np.sqrt(np.diag(dots))
    both = np.outer(norm, norm)
    return np.where(both == 0, 0.0, dots / np.where(both == 0, 1.0, both))


@pytest.mark.parametrize("pivots, numbers", [(256, 1 << 18), (7, 200)])
def test_searches(spark, table, monkeypatch, pivots, numbers):
    home, ids, v, _ = table
    monkeypatch.setattr(search, "PIVOTS", pivots)
    monkeypatch.setattr(search, "PER_PIVOT", 4)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", numbers)  # the second deals cells in many blocks and chunks
    c = cosines(v)
    want = set()
    for q, i in enumerate(ids):
        if i % 20 == 0:
            near = sorted((-c[q, r], j) for r, j in enumerate(ids) if j // 5 % 7 % 5)[:5]
            want |= {(i, j, n + 1, round(-s, 6)) for n, (s, j) in enumerate(near)}
    got = registry.queries()["retrieved_rules"](spark, home).collect()
    assert {(r.query_id, r.rule_id, r["rank"]) for r in got} == {w[:3] for w in want} and max(r.rule_id for r in got) >= 1000
    c = cosines(grouped(ids, v))
    got = {(r.a, r.b) for r in registry.queries()["similar_rules"](spark, home).collect()}
    assert got and got == {(i, j) for a, i in enumerate(ids) for b, j in enumerate(ids) if i < j and c[a, b] >= 0.7}


def grouped(ids, v):
    """Each vector leans towards the first of its eight, where that is there."""
    at = {i: k for k, i in enumerate(ids)}
    return np.array([x + 1.6 * v[at[i - i % 8]] if i - i % 8 in at else x for i, x in zip(ids, v)])


def test_cells_are_skipped(spark, table, monkeypatch):
    monkeypatch.setattr(search, "PER_PIVOT", 4)
    home, ids, v, _ = table
    rows = spark.read.parquet(f"{home}/embeddings.parquet").select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))
    one = search.skipped(rows.select(F.col("rule_id").alias("query_id"), "vec"), rows, 0.9).first()
    assert one.visited < one.cells and one.skipped > 0.5


def test_ties_come_in_insertion_order(spark):
    v = [[1.0, 0.0]] * 30 + [[0.0, 0.0]] * 5 + [[-1.0, 0.0], None]
    rows = spark.createDataFrame([(100 + k, (k * 17) % 37, x) for k, x in enumerate(v)], "rule_id long, pos long, vec array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "query_id long, vec array<double>")
    got = {}
    for r in search.nearest(asked, rows, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.pos, round(r.similarity, 9)))
    pos = lambda part: sorted((k * 17) % 37 for k in part)[:4]
    assert got[1] == [(p, 1.0) for p in pos(range(30))] and got[2] == [(p, 0.0) for p in pos(range(36))]
    assert got[3] == [((35 * 17) % 37, 1.0)] + [(p, 0.0) for p in pos(range(30, 35))[:3]] and 4 not in got


def plain_linkage(v, threshold=0.7):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    c, groups = unit @ unit.T, [[i] for i in range(len(v))]
    while True:
        least = {(a, b): c[np.ix_(x, y)].min() for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b}
        at = max(least, key=lambda p: (least[p], -p[0], -p[1]))
        if least[at] < threshold:
            return groups
        groups[at[0]] = sorted(groups[at[0]] + groups.pop(at[1]))


def test_clusters(spark, table):
    v = np.random.default_rng(5).normal(size=(60, 4))
    rows = spark.createDataFrame([(k, k, [float(x) for x in r]) for k, r in enumerate(v)], "rule_id long, pos long, vec array<double>")
    want = {i: n for n, g in enumerate(plain_linkage(v)) for i in g}
    assert {r.rule_id: r.cluster for r in rules.clusters(rows).collect()} == want
    home, ids, whole, _ = table
    c, of = cosines(grouped(ids, whole)), {r.rule_id: r.cluster for r in registry.queries()["rule_clusters"](spark, home).collect()}
    assert sorted(of) == ids
    groups = [[k for k, i in enumerate(ids) if of[i] == n] for n in range(max(of.values()) + 1)]
    assert [g[0] for g in groups] == sorted(g[0] for g in groups)
    assert all(c[np.ix_(g, g)].min() >= 0.7 - 1e-9 for g in groups if len(g) > 1)
    assert all(c[np.ix_(x, y)].min() < 0.7 + 1e-9 for a, x in enumerate(groups) for y in groups[a + 1 :])


def matrix_linkage(c, threshold=0.7):
    """Merges the most similar pair first, ties by the lowest numbers, on the full matrix of similarities."""
    least, groups = np.where(np.triu(np.ones(c.shape, bool), 1), c, -np.inf), {i: [i] for i in range(len(c))}
    while least.max() >= threshold:
        a, b = np.unravel_index(least.argmax(), least.shape)
        groups[a] = sorted(groups[a] + groups.pop(b))
        both = np.minimum(np.maximum(least[a], least[:, a]), np.maximum(least[b], least[:, b]))
        least[b] = least[:, b] = least[a] = least[:, a] = -np.inf
        for k in groups:
            if k != a:
                least[min(a, k), max(a, k)] = both[k]
    return [groups[k] for k in sorted(groups)]


@pytest.mark.parametrize("small", [500, 1])
def test_linkage_equals_plain_linkage_with_ties(spark, table, small):
    """All 400 vectors, copies and one without a direction among them, solved inside tasks and round by round."""
    _, ids, whole, _ = table
    rows = spark.createDataFrame([(i, k, [float(x) for x in r]) for k, (i, r) in enumerate(zip(ids, whole))], "rule_id long, pos long, vec array<double>")
    want = {ids[i]: n for n, g in enumerate(matrix_linkage(cosines(whole))) for i in g}
    assert {r.rule_id: r.cluster for r in linkage.clusters(rows, 0.7, small).collect()} == want


@pytest.mark.parametrize("small", [500, 20])
def test_linkage_on_graphs_with_equal_similarities(spark, small):
    rng = np.random.default_rng(2)
    n = 60
    edges = {(a, b): float(rng.choice([0.7, 0.8, 0.9])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25} | {(k, k + 1): 0.95 for k in range(100, 112)}
    groups = {k: [k] for pair in edges for k in pair}
    near = dict(edges)
    while near:
        a, b = min(near, key=lambda p: (-near[p], p))
        groups[a] = sorted(groups[a] + groups.pop(b))
        near = {(x, y): min(s) for x in groups for y in groups if x < y and len(s := [edges[min(i, j), max(i, j)] for i in groups[x] for j in groups[y] if (min(i, j), max(i, j)) in edges]) == len(groups[x]) * len(groups[y])}
    found = linkage.link(spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, s double"), spark.createDataFrame([(k,) for k in [*range(n), *range(100, 113), 500]], "node long"), small)
    assert {r.node: r["first"] for r in found.collect()} == {k: g[0] for g in groups.values() for k in g} | {500: 500} | {k: k for k in range(n) if not any(k in p for p in edges)}


def test_statistics_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    monkeypatch.setattr(linkage, "RANKED", 3)  # bins shrink more than once
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 5))
    v[20:40] = v[20]
    of = np.array([0] * 50 + [1] * 20 + [2] * 17 + [3] * 2 + [4])
    rows = spark.createDataFrame([(int(c), k, [float(x) for x in r]) for k, (c, r) in enumerate(zip(of, v))], "cluster long, rule_id long, vec array<double>")
    c = cosines(v)
    got = {r.cluster: r for r in linkage.statistics(rows).collect()}
    for k in range(5):
        m = np.flatnonzero(of == k)
        pairs = [c[i, j] for i in m for j in m if i < j]
        assert got[k].size == len(m) and (got[k].least, got[k].median) == ((None, None) if not pairs else (pytest.approx(min(pairs), abs=1e-12), pytest.approx(float(np.median(pairs)), abs=1e-12)))


def roots(pairs):
    label = {i: i for p in pairs for i in p}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in label}


def test_links_of_all_orders_and_long_chains(spark, table):
    home, _, _, orders = table
    got = {r.node: r.cluster for r in registry.queries()["single_linkage"](spark, home).collect()}
    assert got == roots([(a, b % 400) for a, b in orders])
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.cluster for r in analytics.linked(chain, spark.range(250).select(F.col("id").alias("node"))).collect()}
    assert got == {i: 0 if i <= 200 else i for i in range(250)}
