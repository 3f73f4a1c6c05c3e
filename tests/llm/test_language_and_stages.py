"""Language identification against plain loops, rejection of languages that were not learned, and the pipeline's stages on odd rows."""

import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from talkgrain.llm import language_id as L
from talkgrain.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def plain_vector(text, idf):
    """Weights of the hashed n-grams of one text, by loops over its bytes."""
    low = text.lower().encode()
    letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in low)
    t = b" " + b" ".join(letters.split()) + b" "
    counts = {}
    for n, mix in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        for i in range(len(t) - n + 1):
            place = ((int.from_bytes(t[i : i + n], "big") + 1) * mix % 2**32) >> 20
            counts[place] = counts.get(place, 0) + 1
    v = {k: math.log1p(c) * float(idf[k]) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}, len(t)


def test_prediction_equals_plain_nearest_centroid(docs):
    model = L.fit(docs.filter(~L.held_out()))
    centroids = [{k: float(x) for k, x in enumerate(c) if x} for c in model.centroids]
    some = docs.filter(F.col("text").rlike("\\p{L}")).orderBy("doc_id").limit(60)
    for r in L.identify(some, model).collect():
        v, size = plain_vector(r.text, model.idf)
        cosines = [sum(x * c.get(k, 0.0) for k, x in v.items()) for c in centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        close = sorted(cosines, reverse=True)
        score = min(1.0, max(0.0, cosines[best]))
        assert r.score == pytest.approx(score, abs=2e-4)
        if close[0] - close[1] > 1e-3:
            assert r.lang_pred == model.languages[model.of[best]]
        bound = model.reach[sum(e < size for e in L.LENGTHS)]
        if abs((1 - score) - bound) > 1e-3:
            assert r.rejected == (1 - score > bound)


def test_rejection_of_other_scripts_and_of_unlearned_languages(spark, docs):
    """Texts of other scripts are rejected, and so is nearly all of a language that was left out, though it shares its letters."""
    model = L.fit(docs.filter(~L.held_out()))
    known = L.identify(docs.filter(L.held_out() & F.col("text").rlike("\\p{L}")), model)
    assert known.filter("rejected").count() <= 0.02 * known.count()
    foreign = ["съешь ещё этих мягких французских булок да выпей чаю " * 3, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 3, "مرحبا كيف حالك اليوم أتمنى أن تكون بخير يا صديقي " * 3, "αυτή είναι μια πρόταση στα ελληνικά για δοκιμή " * 3]
    got = L.identify(spark.createDataFrame([(k, t) for k, t in enumerate(foreign)], "doc_id long, text string"), model)
    assert got.filter("rejected").count() >= 3  # one of the four shares enough bytes with accented letters
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()  # enough texts to leave some out
    for lang in model.languages:
        other = L.fit(docs.filter(~L.held_out() & (F.col("lang") != lang)))
        left = L.identify(docs.filter((F.col("lang") == lang) & F.col("text").rlike("\\p{L}")), other)
        assert left.filter("rejected").count() >= 0.9 * left.count() and left.filter(F.col("lang_pred") == lang).isEmpty()


def odd_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["the", "ing", "and", "er", "on", "st", "re", "ha"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(30)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(100, None, "en", "s", 0), (101, "", None, None, None), (102, " \n", "en", "s", 2), (103, texts[0] + " ", "en", "s", 1), (104, texts[1] + " more", "en", "s", 1)]  # nothing to tell; copies
    rows += [(5, texts[5], "en", "s", 1), (None, " ".join(word() for _ in range(40)), "en", "s", 1), (105, " ".join(word() for _ in range(220_000)), "en", "s", 1)]  # a repeated row, no id, more than a megabyte
    return rows, texts


def test_stages_on_odd_rows(spark, tmp_path):
    rows, texts = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_id", "label", "kept", "_far", "_digest", "score", "component_id"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, scratch, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark, "odd"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, str(tmp_path)), f"s{k}")
        if k < 4:
            assert docs.columns == columns
            kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    ids = lambda name: [i for none, i in kept[name] if not none]
    assert not {100, 101, 102} & set(ids("language_id"))  # without a letter nothing is recognised
    assert set(range(30)) <= set(ids("language_id")) and 105 in ids("language_id") and (True, 0) in kept["language_id"]
    assert ids("exact_dedup").count(5) == 1 and 103 in ids("exact_dedup")
    assert 103 not in ids("near_dedup") and 104 not in ids("near_dedup") and set(range(30)) <= set(ids("near_dedup"))
    assert kept["decontamination"] == kept["near_dedup"]
    pieces = docs.collect()
    assert sum(r.length for r in pieces if r.doc_id == 105) > 200_000 and {r.doc_id for r in pieces} == set(ids("near_dedup")) | {None}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
