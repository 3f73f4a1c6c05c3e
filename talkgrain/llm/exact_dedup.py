"""Exact dedup by skew-safe combining (built-in functions only).

Texts are equal when they are the same after each run of ASCII white space becomes one space. Null counts as empty.
Three combining steps, each grouping by digest *and* full content:

1. inside each input partition (the map-side half of the first aggregate) copies become one row;
2. those rows meet by (digest, salt, content), the salt being the partition's number, so a text with copies everywhere
   goes to SALTS tasks and each gets at most one row per partition;
3. the at most SALTS winners of a text meet by (digest, content).

Defined results: null text is the empty text; a null id sorts after every other one, so a group keeps a null id only if
it has no other; rows that repeat id and text are copies of which one is kept; an empty table gives an empty result;
other columns are left alone, whatever their names; texts of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, checked, fresh, join_groups, text_of

SALTS = 16

#: Runs of white space that are not one space already; replacing just these is the same as replacing all runs.
ODD_SPACE = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normal(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), ODD_SPACE, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: _digest, _content, keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("_id"), normal(text_col).alias("_content"))
    rows = rows.select("_id", "_content", F.unhex(F.sha2("_content", 256)).alias("_digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_digest", "_salt", "_content").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    scratch = Scratch(docs.sparkSession, "exact")
    found = groups(docs, id_col, text_col, salts)
    winners = scratch.save(found.select("_digest", "keep_id", "group_size"), "winners")
    most, total = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("s")).agg(F.max("n"), F.sum("s")).first()
    rows = docs.select(F.col(id_col), normal(text_col).alias("_content"))
    rows = rows.select(id_col, F.unhex(F.sha2("_content", 256)).alias("_digest"), "_content")
    if (most or 0) <= 1:  # every digest stands for one content, as compared above
        out = join_groups(rows.drop("_content"), winners, "_digest", id_col, "group_size", total or 0)
    else:  # different contents share a digest: the content decides
        out = rows.join(found, ["_digest", "_content"])
    copy = F.row_number().over(Window.partitionBy(id_col, "_digest").orderBy("keep_id"))
    kept = F.col(id_col).eqNullSafe(F.col("keep_id")) & (copy == 1)
    return out.select(id_col, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact-drop")
    decided = exact_dedup(docs, id_col, text_col).filter("not kept")
    same = F.col(id_col).eqNullSafe(F.col("keep_id"))
    lid, ld = fresh(docs, "_lid"), fresh(docs, "_ld")
    lost = scratch.save(decided.select(F.col(id_col).alias(lid), F.unhex("text_sha256").alias(ld), same.alias("_again")), "lost")
    losers, _ = checked(lost.filter("not _again").drop("_again"))
    digest = fresh(docs, "_digest")
    rows = docs.withColumn(digest, F.unhex(F.sha2(normal(text_col), 256)))
    out = rows.join(losers, F.col(id_col).eqNullSafe(F.col(lid)) & (F.col(digest) == F.col(ld)), "left_anti")
    if not lost.filter("_again").isEmpty():  # rows that repeat id and text
        out = out.dropDuplicates([id_col, digest])
    return out.select(docs.columns)
