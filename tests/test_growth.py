"""What must not grow with the input: plans of small copies, and results on hand-made rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from talkgrain.operators import induction, linkage, search, service
from talkgrain.plans import evaluation, records

SMALL = "/root/testdata/sf0.001"


def explained(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_rules_and_their_lines_meet_without_a_join(spark, tmp_path, capsys):
    assert "Join" not in explained(records._rules(spark, SMALL).filter(F.size("source_ids") == 1), capsys)  # of exploded parts, which would be broadcast
    spark.createDataFrame([(1,), (2,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, 1, 1), (5, 1, 1), (5, 1, 1), (5, 2, 3), (5, 3, 1), (None, 2, 4)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.rule_id: (r.retired, r.source_ids) for r in records._rules(spark, str(tmp_path)).collect()}
    assert got == {p * 10 + n: ((p + n) % 3 == 0, {(1, 1): [5, 7], (2, 3): [5]}.get((p, n), [])) for p in (1, 2) for n in range(1, 8)}


def test_frames_and_cells_are_not_broadcast(spark, capsys):
    assert "BroadcastHashJoin" not in explained(evaluation.speaker_attribution(spark, SMALL), capsys)  # its tables explode, which Spark's estimate leaves out


def test_small_cells_share_a_block_and_searches_are_whole(spark, monkeypatch):
    monkeypatch.setattr(search, "PER_PIVOT", 4)
    v = np.random.default_rng(3).normal(size=(600, 6))
    v[300:] = v[:300] + np.random.default_rng(4).normal(size=(300, 6)) / 9
    rows = spark.createDataFrame([(k, k, x.tolist()) for k, x in enumerate(v)], "rule_id long, pos long, vec array<double>")
    cells = search.Cells(rows)
    assert len(cells.pivots) > 100 and cells.blocks.sum() <= 2  # a query is sent once to each block, not to each cell
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(search, "TILE", 100)
    monkeypatch.setattr(search, "SENT", 7)
    got = {(r.query_id, r.rule_id) for r in search.within(rows.filter("rule_id % 3 = 0").selectExpr("rule_id as query_id", "vec"), rows, 0.9).collect()}
    assert got == {(i, j) for i in range(0, 600, 3) for j in range(600) if unit[i] @ unit[j] >= 0.9}


def test_the_loop_looks_for_pairs_of_new_ones_and_rules_only(spark, monkeypatch):
    asked, plain = [], search.pairs
    monkeypatch.setattr(search, "pairs", lambda rows, threshold: asked.append(rows.columns and rows.filter("rule_id < 0").count()) or plain(rows, threshold))
    calls = spark.createDataFrame([(k, 0, [1.0, k / 9], "ab"[k % 2], "?") for k in range(6)], "call_id long, batch int, vec array<double>, wants string, plain string")
    figures, _ = induction.batches(calls, 1)
    assert figures.first().inserted == 3 and figures.first().conflicts == 3 and not any(asked)  # the others were all compared with each other as well


def test_few_exact_cosines_give_an_exact_median():
    v = np.random.default_rng(5).normal(size=(700, 24))
    rows = pd.DataFrame({"vec": list(v), "block": np.arange(700) % 2, "p": 0, "q": 1})
    pairs, asked = linkage._Pairs(rows), []
    plain = pairs.exact
    pairs.exact = lambda start, chosen: asked.append(chosen.sum()) or plain(start, chosen)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.sort((unit[::2] @ unit[1::2].T).ravel())
    lo, hi = want[61_000] + 1e-12, want[61_500] + 1e-12
    below, found = map(list, zip(*pairs.inside(lo, hi)))
    assert sum(below) == 61_001 and np.allclose(np.sort(np.concatenate(found)), want[61_001:61_501], atol=1e-12)
    assert sum(asked) < 600  # of 122,500, all of which were computed before


def test_medians_between_modes_of_copies_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "FEW", 3)
    monkeypatch.setattr(linkage, "RANKED", 5)
    monkeypatch.setattr(linkage, "BLOCK", 16)
    rng = np.random.default_rng(6)
    modes = np.repeat([[1.0, 0, 0], [0, 1, 0]], 10, axis=0) + rng.normal(size=(20, 3)) / 1e3  # 90 pairs near 1 and 100 near 0
    sets = {1: modes, 2: np.ones((40, 3)), 3: rng.normal(size=(70, 3)), 4: np.array([[1.0, 2, 3], [np.nan, 1, 1], [0, 0, 0], [3, 2, 1], [1, 2, 3.5]]), 5: np.ones((1, 3))}
    rows = spark.createDataFrame([(c, k, x.tolist()) for c, v in sets.items() for k, x in enumerate(v)], "cluster long, rule_id long, vec array<double>")
    got = {r.cluster: r for r in linkage.statistics(rows).collect()}
    for c, v in sets.items():
        v = v[np.isfinite(v).all(axis=1)]
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        want = (unit @ unit.T)[np.triu_indices(len(v), 1)]
        assert got[c].size == len(sets[c])
        assert (got[c]["least"], got[c]["median"]) == (None, None) if not len(want) else np.allclose([got[c]["least"], got[c]["median"]], [want.min(), np.median(want)], atol=1e-12)


def test_blocks_stay_few_from_small_tables_to_large_ones(spark):
    for n in (4_000, 40_000):  # what is dealt grows with the rows; there were 2 and 20 blocks before
        rows = spark.range(n).selectExpr("id as rule_id", "id as pos", "transform(sequence(0, 63), d -> double(pmod(xxhash64(id, d), 2001) - 1000)) as vec")
        assert 7 <= search.Cells(rows).blocks.sum() <= 12


def test_replay_searches_new_rules_only_and_each_pair_once(spark, monkeypatch):
    asked, pairs, within = [], search.pairs, search.within
    monkeypatch.setattr(search, "pairs", lambda rows, threshold: asked.append(rows.count()) or pairs(rows, threshold))
    monkeypatch.setattr(search, "within", lambda queries, rows, threshold: asked.append(queries.count()) or within(queries, rows, threshold))
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(5, 6)), 12, axis=0) + rng.normal(size=(60, 6)) / 2.5
    v[[3, 30, 50]] = v[[10, 11, 9]]  # equal vectors, some first in a later batch
    v[[7, 20]] = 0
    batch = [2 if i in (3, 7, 50) else i % 3 for i in range(60)]
    rows = spark.createDataFrame([(i, i, x.tolist(), b) for i, (x, b) in enumerate(zip(v, batch))], "rule_id long, pos long, vec array<double>, batch int")
    got = [tuple(r) for r in service.replayed(rows, "batch", 3).sort("batch").collect()]
    assert len(asked) == 3 and sum(asked) <= 60  # survivors were searched again with each batch
    want, active = [], rows.filter("false")
    for b in range(3):
        active = active.unionByName(rows.filter(f"batch = {b}"))
        found = service.medoids(active, linkage.clusters(active, 0.7)).toPandas()
        want.append((b, int(found["size"].sum()), int(found["size"].max()), len(found)))
        active = rows.filter(F.col("rule_id").isin(found["rule_id"].tolist()))
    assert got == want and want[2][3] > 5


def test_pairs_meet_once_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "PER_PIVOT", 8)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 64)
    monkeypatch.setattr(search, "LARGER", 2)
    v = np.random.default_rng(9).normal(size=(300, 4))
    rows = spark.createDataFrame([(k * 7919 % 1009, k, x.tolist()) for k, x in enumerate(v)], "rule_id long, pos long, vec array<double>")
    cells = search.Cells(rows)
    assert cells.blocks.sum() > 5
    asked = cells.dealt.select(F.col("rule_id").alias("query_id"), "vec", F.col("block").alias("own"))
    visits, load = cells.visits(asked, lambda _, b: b > -2)
    sizes = np.array([r.n for r in cells.dealt.groupBy("block").agg(F.count("*").alias("n")).collect()])
    assert visits.count() == load.agg(F.sum("n")).first()[0] < 300 * len(sizes) * 0.7  # all met all blocks
    unit, ids = v / np.linalg.norm(v, axis=1, keepdims=True), [k * 7919 % 1009 for k in range(300)]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(300) for j in range(i) if unit[i] @ unit[j] >= 0.7}
    got = [(r.a, r.b) for r in search.pairs(rows, 0.7).collect()]
    assert len(got) == len(want) and set(got) == want
