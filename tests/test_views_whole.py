"""Views that once read only some residues of their keys, held against all rows by brute force."""

import re

from talkgrain.operators.analytics import BANNED, STRIPPED
from talkgrain.plans import fixtures as fx
from talkgrain.plans import registry, views  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SMALL).collect()


def test_pending_keys(spark):
    large = {r.l_orderkey for r in fx.read(spark, SMALL, "lineitem").filter("l_quantity > 45").collect()}
    want = [r.o_orderkey for r in fx.read(spark, SMALL, "orders").collect() if r.o_orderkey not in large]
    assert sorted(r.o_orderkey for r in run(spark, "pending_keys")) == sorted(want) and any(k % 3 for k in want)


def test_cut_turns(spark):
    spans = {r.o_orderkey: (150 + r.o_custkey % 300, 190 + r.o_custkey % 300) for r in fx.read(spark, SMALL, "orders").collect()}
    want = set()
    for k, n in {(r.l_orderkey, r.l_linenumber) for r in fx.read(spark, SMALL, "lineitem").collect()}:
        a, b = n * 100, n * 100 + 80
        if k in spans and spans[k][0] < b and spans[k][1] > a:
            want.add((k, n, 1 + (spans[k][0] > a) + (spans[k][1] < b)))
    got = run(spark, "cut_turns")
    assert {(r.call_id, r.pos, r.pieces) for r in got} == want and len(got) == len(want) and any(k % 50 for k, _, _ in want)


def test_dialect_violations(spark, tmp_path):
    docs = [(1, "هوa كده"), (2, "plain"), (3, "معلش"), (10, "plain"), (20, "plain"), (21, "ok aب"), (22, "hello، (hi؟ x،ب"), (5, "plain")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in docs:
        text += (" aبc" if i % 10 == 0 else "") + (" (hello،" if i % 5 == 0 else "") + (" كده" if i % 20 == 0 else "")
        want += [(i, w, "banned") for w in BANNED if w in text]
        want += [(i, w, "mixed") for w in text.split() if re.search("[\u0600-\u06FF]", w.strip(STRIPPED)) and re.search("[A-Za-z]", w.strip(STRIPPED))]
    got = registry.queries()["dialect_violations"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.what, r.kind) for r in got) == sorted(want)
