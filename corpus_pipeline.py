"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns the pieces
with their sequences. Every stage's result is written as Parquet in the shared folder and read again as the next one's docs.

Defined results: a text that is null, empty or without a letter is no recognised language and goes in the first stage; rows
that repeat id and text, and rows of equal text, leave one row (the smallest id, a null id last); rows without an id are
documents like any other; texts of any length are read whole; columns besides the documents' own pass through, whatever
their names, until packing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkgrain.llm.common import Scratch, scratch_scope
from talkgrain.llm.decontaminate import drop_contaminated
from talkgrain.llm.exact_dedup import drop_copies
from talkgrain.llm.language_id import fit, held_out, recognised
from talkgrain.llm.near_dedup import drop_near_duplicates
from talkgrain.llm.packing import pack_documents
from talkgrain.llm.queries import table, vocabulary

#: Entries of a generation of the tokenizer's cache: workers stand beside an executor that four stages have filled.
CACHE = 40_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not far from every known language stay."""
    model = fit(docs.filter(~held_out()))
    return recognised(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents are linked at a similarity of 0.8."""
    return drop_near_duplicates(docs, 80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary(), 2048, cache=CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Language centroids and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch_scope():  # what the stage's operators kept aside goes once its result is written
            docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
