"""Repairs, selections, the refusing guard, views of a text and verdicts, on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from talkgrain.operators import evaluate, training


def test_repairs(spark):
    lines = [(1, 0, "Agent: hi"), (1, 1, "  "), (1, 2, "Component: we looked"), (1, 3, "[system leak]"), (1, 4, "Customer:  "), (1, 5, "lost words"), (2, 0, "Cousin: "), (2, 1, " Customer: yes ")]
    repairs = [(1, 3, "Agent", "Component: "), (1, 4, None, None), (2, 1, "Agent", "Cousin:"), (9, 9, "Agent", "")]
    got = training.parsed(spark.createDataFrame(lines, "call_id long, pos long, line string"), spark.createDataFrame(repairs, "call_id long, source_line int, speaker string, strip string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, "Agent", "hi", None), (1, 3, "Agent", "we looked", None), (1, 6, None, None, "no speaker: lost words"), (2, 2, "Customer", "yes", None)], key=repr)


def test_selection_refuses_unknown_ids(spark):
    calls = spark.createDataFrame([(k, "ar" if k % 2 else "en") for k in range(10)], "call_id long, language string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "call_id long")
    assert sorted(r.call_id for r in training.selected(calls, ids(3, 4, 4), ["ar"]).collect()) == [3]
    assert sorted(r.call_id for r in training.selected(calls, per_language=2, limit=3).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="1 ids are no call"):
        training.selected(calls, ids(3, 77)).collect()


def test_the_guard_refuses(spark):
    train = spark.createDataFrame([(1, "train"), (2, "val")], "call_id long, part string")
    held = spark.createDataFrame([(5,), (None,)], "call_id long")
    assert training.guarded(train, held).count() == 2 and {r.part for r in training.guarded(train, held).collect()} == {"train", "val"}
    with pytest.raises(Exception, match="held-out call in training data: 2"):
        training.guarded(train, spark.createDataFrame([(2,)], "call_id long")).collect()


def test_reasons_in_their_order(spark):
    rows = [(1, "a", "x", "s", 0, 1), (1, "a", "x", "s", 0, 2), (1, "b", None, "s", 0, 3), (2, "a", "x", "t", 0, 4), (3, "a", None, "t", 0, 5), (4, "a", "x", "t", 1, 6)]
    e = spark.createDataFrame(rows, "call_id long, location string, target string, source string, topic int, pos long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "call_id long")
    got = training.training_examples(e, ids(1, 2, 4), ids(2), 0.5, 1)
    assert {r.pos: r.dropped for r in got.collect()} == {1: None, 2: "repeated", 3: "no_target", 4: "held_out", 5: "not_in_corpus", 6: None}
    assert sorted(map(tuple, training.manifest(got).collect())) == [("s", 3, 1, 0, 0, 0, 1, 1), ("t", 3, 1, 0, 1, 1, 0, 0)]


def test_views_use_the_real_redaction(spark):
    q = spark.createDataFrame([("en", "commitment", "call 0551234567 now", "0551234567"), ("en", "commitment", "call 0551234567 now", "[NATIONAL_ID]"), ("en", "sentiment", "call 0551234567 now", "now"), ("en", "commitment", "x", "")], "language string, kind string, transcript string, quote string")
    assert sorted(map(tuple, evaluate.grounding_views(q).collect())) == [("en", "raw", 4, 0.5, 0.666667), ("en", "redacted", 4, 0.5, 0.666667)]


def test_verdicts_at_any_index(spark):
    items = spark.createDataFrame([(1, "claims", ["a", "b", "c", "d"]), (1, "flags", ["f"]), (2, "claims", [])], "call_id long, list string, items array<string>")
    v = [(1, "claims[1]", "reject", None, "wrong"), (1, "claims[3]", "correct", "D", " "), (1, "claims[0]", "confirm", None, "fine"), (1, "claims[7]", "reject", None, None), (2, "claims[0]", "correct", "x", None), (1, "junk", "reject", None, "lost")]
    got = {(r.call_id, r.list): r for r in evaluate.planned_corrections(spark.createDataFrame(v, "call_id long, claim_id string, verdict string, patch string, note string"), items).collect()}
    r = got[1, "claims"]
    assert (r["items"], r.corrected, r.rejected, r.notes, r.unknown) == (["a", "c", "D"], 1, 1, "fine\n\nwrong", ["claims[7]"])
    assert got[1, "flags"]["items"] == ["f"] and got[2, "claims"].unknown == ["claims[0]"]


def test_a_run_without_successes(spark):
    calls = spark.createDataFrame([(1, "en", "boom"), (2, "ar", None)], "call_id long, language string, error string")
    one = spark.createDataFrame([(2, 0.5)], "call_id long, value double")
    quotes = spark.createDataFrame([(2, "sentiment", True)], "call_id long, kind string, supported boolean")
    got = {r.language: r for r in evaluate.run(calls, one, one.filter(F.lit(False)), quotes).collect()}
    assert tuple(got["en"]) == ("en", 1, 0, 1, None, None, None, None) and tuple(got["ar"]) == ("ar", 1, 1, 0, 0.5, 0.0, 1.0, None)
    assert [tuple(r) for r in evaluate.failures(calls).collect()] == [(1, "en", "boom")]


def test_forced_against_detected(spark):
    rows = [(1, "en", "one two three four", "one two three four", "one three four"), (2, "en", "a b", "x y", "a b"), (3, "ar", "", "", "")]
    got = evaluate.forcing(spark.createDataFrame(rows, "call_id long, language string, reference string, forced string, detected string")).sort("call_id").collect()
    assert [(r.forced_wer, r.detected_wer, r.better) for r in got] == [(0.0, 0.25, "forced"), (1.0, 0.0, "detected"), (0.0, 0.0, "same")]


def test_signs_and_dashes(spark):
    from talkgrain.functions import text as T

    rows = spark.createDataFrame([(1.25,), (-0.5,), (0.001,), (-0.001,), (None,)], "x double")
    assert [r.s for r in rows.select(T.signed(F.col("x"), 2).alias("s")).collect()] == ["+1.25", "−0.50", "0.00", "0.00", "—"]


def test_examples_are_looked_at_once(spark, tmp_path):
    rows = [(1, "a", 5, "s", 0, 10), (1, "a", 5, "s", 0, 11), (1, "a", None, "s", 0, 12), (1, None, 5, "s", 0, 13), (1, None, 5, "s", 0, 14), (2, "a", 5, "s", 0, 15), (3, "a", 5, "s", 0, 16)]
    spark.createDataFrame(rows, "call_id long, location string, target long, source string, topic long, pos long").write.parquet(f"{tmp_path}/e")
    calls = lambda *n: spark.createDataFrame([(i,) for i in n], "call_id long")
    got = training.training_examples(spark.read.parquet(f"{tmp_path}/e"), calls(1, 2), calls(2), 0.5, 1)
    assert not [f for f in got.inputFiles() if f"{tmp_path}/e" in f]
    assert sorted((r.pos, r.dropped) for r in got.collect()) == [(10, None), (11, "repeated"), (12, "no_target"), (13, None), (14, "repeated"), (15, "held_out"), (16, "not_in_corpus")]
    held = training.guarded(spark.createDataFrame([(2, "no_target"), (1, None)], "call_id long, dropped string"), calls(2), "dropped")
    assert sorted(map(tuple, held.collect())) == [(1, None), (2, "no_target")]
    with pytest.raises(Exception, match="held-out call in training data: 1"):
        training.guarded(spark.createDataFrame([(1, None)], "call_id long, dropped string"), calls(1), "dropped").collect()
