"""The library's operators on small hand-made cases, and every registered query against its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkgrain.functions import redact as R
from talkgrain.functions import text as T
from talkgrain.operators import datasets, evidence, lifecycle, metrics, rules, timelines, validators
from talkgrain.plans import evaluation, folds, quality, records, registry, service, streams, views  # noqa: F401
from talkgrain.sources import tables

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("mail a.b+c@x-y.org now", "mail [EMAIL] now", 1),
        ("call +44 7 7123 9981 or 0033 61 223 8811", "call [PHONE] or [PHONE]", 2),
        ("card 4716 2258 9913 6402", "card [CARD]", 1),
        ("id 4820193756.", "id [NATIONAL_ID].", 1),
        ("064 380 1172", "[PHONE]", 1),
        ("٠٦٨٢٢٤١٩٥", "[PHONE]", 1),
        ("(303) 772-6190 and 772-6190", "[PHONE] and [PHONE]", 2),
        ("account 7302215", "account [NUMBER]", 1),
        ("about 8,310,042 at 07:45", "about 8,310,042 at 07:45", 0),
        ("on 2031-04-27", "on [NUMBER]", 1),
        ("7b1c90de-51aa-4c0d-8e22-6f3a9d0b4c17 at 2030-02-03T04:05:06Z by q@r.org", "7b1c90de-51aa-4c0d-8e22-6f3a9d0b4c17 at 2030-02-03T04:05:06Z by [EMAIL]", 1),
        ("JO17ABCD0040000000000777000123", "JO17ABCD[PHONE]", 1),
        ("1+2345678", "1+2345678", 0),
        ("ext 12+345 6789", "ext 12+345 6789", 0),
        ("C++0791234567", "C++[NATIONAL_ID]", 1),
        ("a++1234567", "a++1234567", 0),
        ("no digits here", "no digits here", 0),
        ("", "", 0),
    ],
)
def test_redaction(spark, text, want, n):
    r = one(spark, R.redacted(F.lit(text)))
    assert (r.text, r["count"], r.original_length) == (want, n, len(text))
    assert one(spark, R.redacted(F.lit(want))).text == want  # nothing more on its own output


def test_quotes(spark):
    assert one(spark, T.all_offsets(F.lit("aXbXXc"), F.lit("X"))) == [1, 3, 4]
    assert one(spark, T.all_offsets(F.lit("aaaa"), F.lit("aa"))) == [0, 2]
    assert one(spark, T.overlapping_offsets(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, T.is_verbatim(F.lit("abc"), F.lit(""))) is False
    assert one(spark, T.first_offset(F.lit("abc"), F.lit("d"))) is None


def test_scripts_and_words(spark):
    for text, want in (("مرحبا", "ar"), ("hello", "en"), ("مرحبا hello", "mixed"), ("مرحبا [PHONE]", "ar"), ("", "en")):
        assert one(spark, T.script_class(F.lit(text))) == want
    assert one(spark, T.direction(F.lit("مرحبا ok"))) == "rtl"
    assert one(spark, T.normalised(F.lit("أَهْلًا، Let’s  GO! ٣"))) == "اهلا lets go 3"
    assert one(spark, T.jaccard(T.tokens(F.lit("The cat")), T.tokens(F.lit("the dog")))) == pytest.approx(1 / 3)


def test_word_errors(spark):
    def distance(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (a[i] != b[j]))
        return d[-1, -1]

    pairs = [("ar", "one two three", "one three three four"), ("ar", "a b", "a b"), ("en", "", "x"), ("en", "", ""), ("en", "a", "b c d")]
    rows = metrics.word_errors(spark.createDataFrame(pairs, "language string, reference string, hypothesis string")).collect()
    for r in rows:
        assert r.errors == distance(r.reference.split(), r.hypothesis.split())
    assert sorted(r.wer for r in rows) == pytest.approx(sorted([2 / 3, 0, 1, 0, 3]))


def test_confidence_at_the_threshold(spark):
    calls = spark.createDataFrame([(1, "ar"), (2, "ar"), (3, "en")], "call_id int, language string")
    claims = spark.createDataFrame([(1, "commitment", k < 7) for k in range(10)] + [(2, "commitment", False), (2, "sentiment", False)], "call_id int, kind string, kept boolean")
    got = {r.call_id: (r.coverage, r.needs_review) for r in evidence.confidence(claims, calls).collect()}
    assert got == {1: (0.7, False), 2: (0.0, True), 3: (1.0, False)}
    assert one(spark, evidence.route(F.lit(None).cast("string"), F.lit(None).cast("boolean"))) == "escalate"


def test_alignment(spark):
    asr = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (1, 2, 9.0, 10.0)], "call_id int, pos int, start_sec double, end_sec double")
    who = spark.createDataFrame([(1, 0, "A", 0.0, 1.0), (1, 1, "B", 1.0, 3.0), (1, 2, "C", 3.0, 5.0)], "call_id int, pos int, name string, start_sec double, end_sec double")
    assert [r.speaker for r in sorted(timelines.align(asr, who).collect())] == ["A", "B", "C"]


def test_labelled_transcript(spark):
    rows = [(1, 0, "S1", "hello"), (1, 1, "S1", " there "), (1, 2, "S2", ""), (1, 3, "S1", "you"), (1, 4, "S2", "hi")]
    got = timelines.labelled_transcript(spark.createDataFrame(rows, "call_id int, pos int, speaker string, text string")).first()
    assert got.transcript == "Agent: hello there you\nCustomer: hi"


def test_cutting_turns(spark):
    turns = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 20)], "call_id int, pos int, start int, end int")
    spans = spark.createDataFrame([(1, "x", 2, 6), (1, "y", 4, 15)], "call_id int, span_id string, start int, end int")
    got = [(r.pos, r.from_char, r.to_char, r.span_ids) for r in sorted(timelines.cut_turn(turns, spans).collect())]
    assert got == [(0, 0, 2, []), (0, 2, 4, ["x"]), (0, 4, 6, ["x", "y"]), (0, 6, 10, ["y"]), (1, 11, 15, ["y"]), (1, 15, 20, [])]


def test_complete_linkage_does_not_chain(spark):
    def groups(v):
        rows = spark.createDataFrame([(k, k, [float(x) for x in r]) for k, r in enumerate(v)], "rule_id long, pos long, vec array<double>")
        out = {}
        for r in rules.clusters(rows, 0.7).collect():
            out.setdefault(r.cluster, []).append(r.rule_id)
        return [sorted(out[c]) for c in sorted(out)]

    at = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d))]
    assert groups([at(0), at(38), at(80), at(200)]) == [[0, 1], [2], [3]]
    v = np.random.default_rng(1).normal(size=(60, 4))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for g in groups(v):
        assert (unit[g] @ unit[g].T).min() >= 0.7 - 1e-9


def test_rule_lifecycle(spark):
    rows = [(1, 5, 5, False), (2, 4, 6, False), (3, 0, 9, False), (4, 9, 0, True)]
    got = rules.retire(spark.createDataFrame(rows, "rule_id int, success_count int, failure_count int, retired boolean")).collect()
    assert [r.retired for r in sorted(got)] == [False, True, False, True]


def test_batches(spark):
    rows = spark.range(7).withColumn("g", F.lit("x"))
    assert sorted(r["count"] for r in datasets.batches(rows, 5, "g", "id").groupBy("batch").count().collect()) == [1, 1, 1, 2, 2]
    w = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0), ("c", 2, 1.0)], "name string, ord int, weight double")
    assert [r.share for r in sorted(datasets.apportion(w, 4).collect())] == [2, 1, 1]
    parts = datasets.split(spark.range(10).withColumn("g", F.when(F.col("id") == 0, "alone").otherwise("many")), 0.2, 1, "g", "id")
    assert {(r.g, r.part): r["count"] for r in parts.groupBy("g", "part").count().collect()} == {("alone", "train"): 1, ("many", "val"): 2, ("many", "train"): 7}


def test_validators(spark):
    ok = lambda *t: one(spark, validators.chronological(F.array(*map(F.lit, t))))
    assert ok(1.0, 1.0, 2.0) and not ok(2.0, 1.0) and ok(1.0)
    diff = lambda c, d, f, s: one(spark, validators.first_difference(F.lit(c), F.array(*map(F.lit, d)), F.lit(f), F.array(*map(F.lit, s))))
    assert diff(True, [False], False, [0.0]) == "commitments"
    assert diff(False, [False, True], True, [0.0]) == "commitments[1].deadline"
    assert diff(False, [False], False, [0.25, 0.26]) == "rubric_scores[empathy]"
    assert diff(False, [False], False, [0.25]) is None


def test_reaper_order(spark):
    rows = [(1, "queued", 1, 0.0, 950.0, None), (2, "processing", 4, 0.0, None, 50.0), (3, "processing", 3, 0.0, None, 50.0), (4, "queued", 1, 0.0, None, None)]
    got = lifecycle.reap(spark.createDataFrame(rows, "id int, status string, attempts int, queued double, enqueued double, started double"), F.lit(1000.0))
    assert [r.action for r in sorted(got.collect(), key=lambda r: r.id)] == ["none", "fail", "release", "requeue"]


def test_sources(spark, tmp_path):
    for name, text in (("call_1_ar.txt", "Agent: a\nCustomer: b"), ("notes.txt", "x")):
        (tmp_path / name).write_text(text)
    assert [(r.call_id, r.language) for r in tables.transcripts(spark, str(tmp_path)).collect()] == [("call_1_ar", "ar")]
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n\n{"type": "segment", "s": 2}\n{"a": 3')
    records, segments = tables.log(spark, str(log), "a int", "s int")
    assert [r.a for r in records.collect()] == [1] and [r.s for r in segments.collect()] == [2]
    assert tables.markdown([{"a": 0.5, "b": None}], ["a", "b"]).endswith("| 0.500 | — |")


def test_stream_equals_batch(spark, tmp_path):
    from talkgrain.plans import fixtures as fx
    from talkgrain.streaming import lifecycle as stream

    lines = fx.turns(spark, SMALL)
    lines.repartition(1).write.parquet(str(tmp_path / "in"))
    got = []
    source = stream.source(spark, str(tmp_path / "in"), lines.schema)
    stream.pipeline(source, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted(stream.analyse(lines).collect())


def _same(frame):
    show = lambda v: "~" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    frame = frame[sorted(frame.columns)].astype(object).map(show)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.sql("set timezone='UTC'")
        for f in os.listdir(SMALL):
            con.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
        want = con.sql(sql).df()
        pd.testing.assert_frame_equal(_same(got), _same(want))
