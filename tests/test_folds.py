"""The induction fold, consolidation, the loop of batches and places of quotes, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import induction, places
from talkgrain.plans import folds, registry  # noqa: F401
from tests.test_rules_whole import cosines, matrix_linkage


def plain_fold(order, edges, against=()):
    inserted, out = [], {}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for c in order:
        stand = [x for x in inserted if x in near.get(c, ())]
        out[c] = not stand and c not in against
        if out[c]:
            inserted.append(c)
    return out, {c: [x for x in order if out[x] and x in near.get(c, ()) and order.index(x) < order.index(c)] for c in order if not out[c]}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_a_plain_loop(spark, seed):
    """Random graphs with a chain, a clique and candidates that an active rule stands against."""
    rng = random.Random(seed)
    ids = list(range(60))
    order = ids[:]
    rng.shuffle(order)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(k, k + 1) for k in range(10, 22)} | {(a, b) for a in range(40, 48) for b in range(40, a)}
    edges = {(a, b) for a, b in edges if a != b}
    against = set(rng.sample(ids, 5)) if seed else set()
    rules = spark.createDataFrame([(c, 7) for c in against], "candidate long, rule_id long")
    found, rounds = induction.fold(spark.createDataFrame([(c, p) for p, c in enumerate(order)], "candidate long, pos long"), spark.createDataFrame(sorted(edges), "a long, b long"), rules if seed else None)
    want, why = plain_fold(order, edges, against)
    got = found.collect()
    assert {r.candidate: r.inserted for r in got} == want and 1 <= rounds <= 20
    assert {r.candidate: r.conflicts for r in got if not r.inserted} == why
    assert max(r["round"] for r in got) == rounds


def test_fold_of_nothing(spark):
    none = spark.createDataFrame([], "candidate long, pos long")
    found, rounds = induction.fold(none, spark.createDataFrame([], "a long, b long"))
    assert found.count() == 0 and rounds == 0


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(n // 4, 6)), 4, axis=0) + rng.normal(size=(n, 6)) * 0.3
    return v


def plain_consolidate(rows, held, threshold, within=lambda r: 0):
    """rows: id -> [vec, sources, ok, no, retired]; merges inside each `within`."""
    eligible = [i for i in sorted(rows) if not rows[i][4] and i not in held]
    fate = {i: "retired" if rows[i][4] else "held" if i in held else "kept" for i in rows}
    if eligible:
        c = cosines(np.array([rows[i][0] for i in eligible]))
        same = np.array([[within(i) == within(j) for j in eligible] for i in eligible])
        for g in matrix_linkage(np.where(same, c, -2.0), threshold):
            if len(g) > 1:
                m = [eligible[k] for k in g]
                sources = list(dict.fromkeys(s for i in m for s in rows[i][1]))
                rows[m[0]] = [rows[m[0]][0], sources, sum(rows[i][2] for i in m), sum(rows[i][3] for i in m), False]
                fate[m[0]] = "survivor"
                for i in m[1:]:
                    rows[i][4], fate[i] = True, "merged"
    return fate


def test_consolidation(spark):
    v = vectors(80)
    rows = {i: [x, [i % 9, i % 4], i % 5, i % 3, i % 13 == 0] for i, x in enumerate(v)}
    held = {3, 20, 37}
    df = spark.createDataFrame([(i, i, x.tolist(), s, ok, no, gone) for i, (x, s, ok, no, gone) in rows.items()], "rule_id long, pos long, vec array<double>, sources array<long>, success_count long, failure_count long, retired boolean")
    names = spark.createDataFrame([(h,) for h in held], "rule_id long")
    got = induction.consolidate(df, names, 0.8)
    again = induction.consolidate(got.drop("fate"), names, 0.8)
    fate = plain_consolidate(rows, held, 0.8)
    assert {r.rule_id: (r.fate, r.retired, r.sources, r.success_count, r.failure_count) for r in got.collect()} == {i: (fate[i], rows[i][4], rows[i][1], rows[i][2], rows[i][3]) for i in rows}
    assert sum(f == "merged" for f in fate.values()) > 10
    assert all(r.fate in ("kept", "held", "retired") for r in again.filter("fate <> 'survivor' and fate <> 'merged'").collect())


def plain_batches(calls, n, retrieve_at, merge_at, conflict_at):
    rules, says, out = {}, {}, []
    for b in range(n):
        now = [c for c in calls if c[1] == b]
        active = [i for i in sorted(rules) if not rules[i][4]]
        failed, memory, guided, counts = [], 0, 0, {}
        for i, _, x, wants, plain in now:
            near = max(((cosines(np.array([x, rules[r][0]]))[0, 1], -r) for r in active), default=(-2, 0))
            said = plain
            if near[0] >= retrieve_at:
                said, guided = says[-near[1]], guided + 1
                counts.setdefault(-near[1], []).append(said == wants)
            memory += said == wants
            if said != wants:
                failed.append(i)
        for r, oks in counts.items():
            rules[r][2] += sum(oks)
            rules[r][3] += len(oks) - sum(oks)
        of = {c[0]: c for c in now}
        alike = lambda x, y: cosines(np.array([x, y]))[0, 1] >= conflict_at
        edges = [(i, j) for i in failed for j in failed if i < j and of[i][3] != of[j][3] and alike(of[i][2], of[j][2])]
        cross = {(i, r) for i in failed for r in active if says[r] != of[i][3] and alike(of[i][2], rules[r][0])}
        inserted, why = plain_fold(failed, edges, {i for i, _ in cross})
        held = {r for _, r in cross} | {x for c in why.values() for x in c}
        for i in failed:
            if inserted[i]:
                rules[i], says[i] = [of[i][2], [i], 0, 0, False], of[i][3]
        fate = plain_consolidate(rules, held, merge_at, lambda r: says[r])
        for r in rules.values():
            r[4] = r[4] or (r[2] + r[3] >= 10 and r[2] / (r[2] + r[3]) < 0.5)
        out.append((b, len(now), sum(c[3] == c[4] for c in now), memory, guided, sum(inserted.values()), len(failed) - sum(inserted.values()), sum(f == "merged" for f in fate.values()), sum(not r[4] for r in rules.values()), sum(r[4] for r in rules.values())))
    return out, {i: (says[i], r[1], r[2], r[3], r[4]) for i, r in rules.items()}


def test_batches_decide_by_retrieval_and_conflicts(spark):
    v = vectors(120, 8)
    rng = random.Random(2)
    calls = [(i, i % 3, x, f"s{i // 4 % 3}" if rng.random() < 0.8 else "other", f"s{i // 4 % 3}" if i % 4 == 0 else "?") for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, b, x.tolist(), w, p) for i, b, x, w, p in calls], "call_id long, batch int, vec array<double>, wants string, plain string")
    figures, state = induction.batches(df, 3, 1, 0.5, 0.85, 0.8)
    want, rules = plain_batches(calls, 3, 0.5, 0.85, 0.8)
    assert [tuple(r) for r in figures.sort("batch").collect()] == want
    assert {r.rule_id: (r.says, r.sources, r.success_count, r.failure_count, r.retired) for r in state.collect()} == rules
    assert all(sum(w[k] for w in want) > 0 for k in range(1, 9))


def test_overlapping_places(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for _ in range(300)] + [("aaaa", "aa"), ("a.a.a", "a.a"), ("x\ny", "\n"), ("", ""), ("(((", "(("), ("日本日本日", "日本日")]
    df = spark.createDataFrame([(k, t, q) for k, (t, q) in enumerate(rows)], "k int, t string, q string")
    got = {r.k: r.at for r in df.select("k", places.overlapping(F.col("t"), F.col("q")).alias("at")).collect()}
    assert got == {k: [i for i in range(len(t)) if q and t.startswith(q, i)] for k, (t, q) in enumerate(rows)}


def test_evidence_must_start_in_a_turn(spark):
    asked = spark.createDataFrame([(1, "a", "Agent: ha ha ha", "ha ha"), (1, "b", "Agent: ha ha ha", "Agent"), (1, "c", "Agent: ha ha ha", ""), (1, "d", "Agent: ha ha ha", "zz")], "call_id long, ask_id string, transcript string, quote string")
    turns = spark.createDataFrame([(1, 0, 7, 15)], "call_id long, pos long, start_char long, end_char long")
    assert [tuple(r) for r in places.evidence(asked, turns).select("ask_id", "start", "end", "turn", "occurrences").collect()] == [("a", 7, 12, 0, 2)]


def test_matches_with_lines(spark):
    df = spark.createDataFrame([(1, "Agent: aa aaa\nnobody aa\n\nCustomer: aa"), (2, "none")], "k int, t string")
    got = [tuple(r) for r in places.matches(df, "k", "t", F.lit("aa")).sort("match").collect()]
    assert got == [(1, 0, 1, "Agent", 7, 9, "Agent: aa aaa"), (1, 1, 1, "Agent", 10, 12, "Agent: aa aaa"), (1, 2, 2, None, 21, 23, "nobody aa"), (1, 3, 4, "Customer", 35, 37, "Customer: aa")]
    with pytest.raises(Exception, match="empty"):
        places.matches(df, "k", "t", F.lit("")).collect()
