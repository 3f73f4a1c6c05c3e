import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import documents, service
from talkgrain.sources import files, published
from tests.test_rules_whole import cosines, matrix_linkage


def test_strings_of_every_depth(spark):
    df = spark.sql("SELECT named_struct('a', array(map('k a@b.cd', 'x a@b.cd')), 'n', 5, 's', cast(null AS string), 'deep', cast(null AS struct<t:string>)) AS d")
    got = df.select(service.scrubbed(df, "d").alias("d")).first().d
    assert got.a == [{"k a@b.cd": "x [EMAIL]"}] and got.n == 5 and got.s is None and got.deep is None


def test_quotes_of_torn_null_and_deep_documents(spark):
    quote = '{"text":"t","speaker":"Agent","start_char":1,"end_char":2,"inner":{"text":"u","speaker":"","start_char":0,"end_char":1}}'
    deep = "[" * 12 + quote + "]" * 12
    odd = '{"a":{"text":5,"speaker":null,"start_char":"one","end_char":[]},"b":{"text":"x","speaker":1,"start_char":1.5,"end_char":2},"c":[],"d":{"text":"no quote"}}'
    twice = '{"a":1,"a":2}'
    rows = spark.createDataFrame([(7, odd), (8, twice), (9, quote), (1, deep), (2, None), (3, "{"), (4, ""), (5, "[]"), (6, '{"a":[1,' + quote + "]}")], "id long, doc string")
    got = sorted(tuple(r) for r in documents.quotes_in(rows, "id", "doc").collect() if r.id != 7)
    assert got == [(1, "[0]" * 12, "t", 1), (6, "a[1]", "t", 1), (9, "", "t", 1)]
    odd = sorted(tuple(r) for r in documents.quotes_in(rows.filter("id = 7"), "id", "doc").collect())
    assert odd == [(7, "a", None, None), (7, "b", "x", None)]


def test_a_line_without_speaker_refuses_the_call(spark):
    rows = [(1, 0, "Agent: call 0551234567"), (1, 1, "  "), (2, 0, "Customer: hi"), (2, 1, "mail me a@b.cd"), (2, 2, "nobody")]
    got = {r.call_id: r for r in service.admitted(spark.createDataFrame(rows, "call_id int, pos int, line string")).collect()}
    assert got[1].admitted and got[1].replaced == 1 and "0551234567" not in got[1].transcript
    assert (got[2].admitted, got[2].bad_line, got[2].bad_text) == (False, 2, "mail me [EMAIL]")


def test_medoids_and_replay_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    v = np.array([centres[i % 4] + rng.normal(size=6) * 0.3 for i in range(36)])
    df = spark.createDataFrame([(i, i, x.tolist(), i % 3) for i, x in enumerate(v)], "rule_id long, pos long, vec array<double>, batch int")
    u, active, want = v / np.linalg.norm(v, axis=1, keepdims=True), [], []
    for b in range(3):
        active = active + [i for i in range(36) if i % 3 == b]
        active.sort()
        groups = matrix_linkage(cosines(v[active]))
        left = []
        for g in groups:
            m = [active[i] for i in g]
            left.append(m[int(np.argmax((u[m] @ u[m].T).sum(1).round(9)))])
        want.append((b, len(active), max(map(len, groups)), len(left)))
        active = left
    assert [tuple(r) for r in service.replayed(df, "batch", 3).sort("batch").collect()] == want
    assert max(w[2] for w in want) > 2
    empty = service.replayed(df.filter("false"), "batch", 1).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, 0)]


def test_retries_and_models(spark):
    def ask(key, n):
        if key < 0 or n < key:
            raise ValueError("no")
        return str(key)

    rows = spark.createDataFrame([(0,), (2,), (3,), (-1,)], "id long")
    got = {r.id: (r.answer, r.tries, r.error) for r in service.retried(rows, "id", ask, 3, 0.0).collect()}
    assert got == {0: ("0", 1, None), 2: ("2", 3, None), 3: (None, 3, "ValueError: no"), -1: (None, 3, "ValueError: no")}
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    got = service.embedded(texts, "t", lambda x: np.array([[len(t)] for t in x])).collect()
    assert sorted((r.id, r.vec) for r in got) == [(1, [2.0]), (2, [0.0])]


def test_bad_quotes_are_told_together(spark):
    got = spark.range(1).select(service.located(F.lit("aXbX"), F.array(F.lit("X"), F.lit(" "), F.lit("c"))).alias("x")).first().x
    assert got.starts == [1, None, None] and got.bad == [" ", "c"]


def test_published_whole_or_not_at_all(spark):
    home = files.shared_folder(spark, "test")
    df = spark.range(5)
    with pytest.raises(ValueError, match="not published"):
        published.publish(df, f"{home}/t", lambda t: t.filter("id > 3"))
    assert not files.exists(spark, f"{home}/t")
    assert published.stored(spark, f"{home}/t", "id long").count() == 0
    assert published.publish(df, f"{home}/t", lambda t: t.filter("id < 0")).count() == 5
    with pytest.raises(FileExistsError):
        published.publish(df, f"{home}/t", lambda t: t.filter("id < 0"))
    with published.only_writer(spark, f"{home}/lock"):
        with pytest.raises(BlockingIOError):
            with published.only_writer(spark, f"{home}/lock", 0.3, 0.1):
                pass
    with published.only_writer(spark, f"{home}/lock"):
        pass


def test_store_is_built_only_for_another_set_of_rules(spark):
    built = []
    store = published.RuleStore(lambda active: built.append(active.count()))
    rows = lambda *retired: spark.createDataFrame(list(enumerate(retired)), "rule_id long, retired boolean")
    for r in (rows(False, False), rows(False, False), rows(False, True), rows(False, True, True)):
        store.current(r)
    assert built == [2, 1]


def test_quotes_of_a_document_are_found_in_one_pass(spark, monkeypatch):
    passes, kept = [], documents.files.kept
    monkeypatch.setattr(documents.files, "kept", lambda df: passes.append(1) or kept(df))
    quote = '{"text": "t", "speaker": "Agent", "start_char": 3, "end_char": 4}'
    rows = spark.createDataFrame([(1, f'{{"claims": [{{"evidence": {quote}}}], "by": [[1, {quote}]]}}'), (2, "7"), (3, '{"claims": [')], "id long, doc string")
    got = sorted(tuple(r) for r in documents.quotes_in(rows, "id", "doc").collect())
    assert got == [(1, "by[0][1]", "t", 3), (1, "claims[0].evidence", "t", 3)]
    assert len(passes) == 1
    deep = [(n, "[" * n + quote + "]" * n) for n in (0, 7, 8, 9, 15, 16, 17, 30)]
    got = sorted(tuple(r) for r in documents.quotes_in(spark.createDataFrame(deep, "id long, doc string"), "id", "doc").collect())
    assert got == [(n, "[0]" * n, "t", 3) for n, _ in deep]
