"""Order inside groups and exact quantiles on hot groups, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import datasets, ordered, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    """A group with two thirds of all rows, one without a name, ones of a single row; values with ties and nulls."""
    rng = random.Random(6)
    out = []
    for k in range(3000):
        g = "hot" if k % 3 else rng.choice(["a", "b", None, f"one{k}"])
        out.append((k, g, None if rng.random() < 0.1 else float(rng.choice([rng.randrange(50), rng.gauss(0, 1000)]))))
    return out, spark.createDataFrame(out, "k long, g string, v double").repartition(7)


def groups(rows):
    by = {}
    for k, g, v in rows:
        by.setdefault(g, []).append((k, v))
    return by


def test_ranks(rows):
    plain, df = rows
    got = {r.k: (r["rank"], r["size"]) for r in ordered.ranked(df, ["g"], ["k"]).collect()}
    assert got == {k: (n + 1, len(m)) for m in groups(plain).values() for n, (k, _) in enumerate(sorted(m))}


@pytest.mark.parametrize("back", [False, True])
def test_carried_values(rows, back):
    plain, df = rows
    value = F.when(F.col("k") % 400 == 7, F.col("k"))
    got = {r.k: r.last for r in ordered.carried(df, ["g"], ["k"], value, "last", back).collect()}
    want = {}
    for m in groups(plain).values():
        last = None
        for k, _ in sorted(m, reverse=back):
            last = k if k % 400 == 7 else last
            want[k] = last
    assert got == want


@pytest.mark.parametrize("n", [1, 5, 4000])
def test_batches(rows, n):
    plain, df = rows
    got = {r.k: r.batch for r in datasets.batches(df, n, "g", "k").collect()}
    for m in groups(plain).values():
        parts = [len(p) for p in np.array_split(np.arange(len(m)), n)]
        assert [got[k] for k, _ in sorted(m)] == [b + 1 for b, size in enumerate(parts) for _ in range(size)]


@pytest.mark.parametrize("small", [10_000, 50])
def test_quantiles(rows, monkeypatch, small):
    plain, df = rows
    monkeypatch.setattr(quantiles, "SMALL", small)  # the second brackets the larger groups, whose margin is wide enough
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    got = {r.g: (r.x, r.y) for r in quantiles.exact_quantiles(df, ["g"], {"x": F.col("v"), "y": -F.col("v")}, (0.0, 0.5, 0.95, 1.0), 9).collect()}
    by = groups(plain)
    assert set(got) == set(by)
    for g, m in by.items():
        values = [v for _, v in m if v is not None]
        for sign, found in zip((1, -1), got[g]):
            if not values:
                assert found is None or found == [None] * 4
            else:
                assert found == pytest.approx(list(np.quantile([sign * v for v in values], [0.0, 0.5, 0.95, 1.0])), abs=1e-6)
