"""Near duplicates with repeated, null and string ids, long texts and open buckets, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import near_dedup
from tests.llm.test_llm_operators import brute_components, words


def brute(rows, percent=85):
    """Components over rows that may repeat ids: per row the smallest id that its text reaches."""
    label, sets = brute_components([(k, t) for k, (_, t) in enumerate(rows)], percent)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[label[k]] = min(i, least.get(label[k], i))
    return [(i, len(sets[k]), i if not sets[k] or i is None else least[label[k]]) for k, (i, _) in enumerate(rows)]


def test_classes_have_numbers_of_their_own(spark):
    rng = random.Random(8)
    t = words(rng, 60)
    rows = [(1, words(rng, 60)), (1, t), (6, t), (2, t + " more"), (5, t + " more"), (5, t + " more"), (7, "x y"), (7, words(rng, 30)), (3, None), (3, t + " again"), (3, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert {r.component_id for r in got if r.doc_id in (2, 6)} == {1}


def test_string_ids_nulls_and_clashing_columns(spark):
    rng = random.Random(9)
    t = words(rng, 50)
    rows = [("b", t), ("a", t + " z"), ("c", t), (None, t), (None, None), ("d", " "), ("e", "alone here")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id or "", r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert [g[:3] for g in got if g[0]] == [("a", 47, "a"), ("b", 46, "a"), ("c", 46, "a"), ("d", 0, "d"), ("e", 1, "e")]
    assert all(g[2] is None and g[3] for g in got if not g[0])
    for c in ("_lid", "_lh", "_h", "_id", "_text", "n", "c"):
        df = df.withColumn(c, F.lit(1))
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or "" for r in kept.collect()) == ["", "", "a", "d", "e"]


@pytest.mark.parametrize("block", [512, 7])
def test_open_buckets_lose_no_link(spark, monkeypatch, block):
    """Many texts that share most of their words, so buckets hold several components."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(10)
    common = words(rng, 120).split()
    rows = []
    for i in range(160):
        w = list(common)
        for _ in range(rng.choice((1, 2, 3, 4, 6, 9))):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_shared_counts():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (40, 900), (500, 500)):
        x, y = np.unique(rng.integers(0, 1000, n).astype(np.uint64)), np.unique(rng.integers(0, 1000, m).astype(np.uint64))
        assert near_dedup.shared(x, y) == len(np.intersect1d(x, y))
