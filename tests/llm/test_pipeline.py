"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline
from tests.llm.test_llm_operators import brute_components, check_sequences, words  # noqa: F401
from talkgrain.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    scratch = Scratch(spark, "t")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.save(stage(spark, docs, SMALL), f"s{k}")
        kept[name] = docs.count()
        if k < 4:
            assert docs.columns == columns
        if name == "exact_dedup":
            normal = {" ".join(x for x in r.text.replace("\n", " ").replace("\t", " ").split(" ") if x) for r in before.collect()}
            assert kept[name] == len(normal)
        if name == "near_dedup":
            label, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, c in label.items() if i == c}
    assert kept["language_id"] >= 0.97 * spark.read.parquet(f"{SMALL}/documents.parquet").count()
    check_sequences(docs.collect(), 2048)
