"""Decontamination of documents that are shorter than the items in them, against brute force."""

import random

from talkgrain.llm.decontaminate import contaminated, drop_contaminated


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarity(w, v):
    x, y = grams(w), grams(v)
    shared = sum(min(x.count(g), y.count(g)) for g in set(y))
    return shared / max(1, len(x) + len(y) - shared)


def best(w, v):
    return max(similarity(w[s : s + len(v)], v) for s in range(max(1, len(w) - len(v) + 1)))


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate((12, 30, 40, 40, 60))]
    docs = []
    for _, v in items:
        n = len(v)
        docs += [v[: n - n // 10], v[n // 10 :], v[n // 20 : n - n // 20], v[: n - n // 5], v[: n // 2], v[: n - 1], v, [word(), *v[1:-1]], [word() for _ in range(3)] + v[:-2] + [word() for _ in range(3)]]
    docs += [items[1][1][:4], []]
    want = {(i, k): best(w, v) for i, w in enumerate(docs) for k, v in items if best(w, v) >= 0.8}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}
    assert got.keys() == want.keys() and all(abs(r.similarity - want[k]) < 1e-9 for k, r in got.items())
    assert all(r.n_words == len(items[k][1]) and r.start_word + min(r.n_words, len(docs[i])) <= len(docs[i]) for (i, k), r in got.items())
    assert sum(len(docs[i]) < len(items[k][1]) for i, k in want) >= 10
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    leak = text(20)
    rows = [(None, text(30)), (None, leak), (1, text(30)), (1, text(5) + " " + leak), (1, text(40)), (2, leak), (2, leak), (3, text(30))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, leak)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.similarity, r.start_word) for r in contaminated(d, b).collect())
    assert got == [(0, 7, 1.0, 0), (1, 7, 1.0, 5), (2, 7, 1.0, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in drop_contaminated(d, b).collect()) == sorted((i or 0, w) for i, w in rows if leak not in w)
