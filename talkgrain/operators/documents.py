"""Documents of any shape as variants, walked level by level inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.sources import files

#: What makes an object of a document a quote.
QUOTE = ("text", "speaker", "start_char", "end_char")


def _typed(part: Column, kind: str, to: str) -> Column:
    """A variant's value if it has that kind, else null; nothing is converted."""
    return F.when(F.schema_of_variant(part) == kind, F.try_variant_get(part, "$", to))


#: Levels that one pass opens; deeper documents take further passes over what is still open.
LEVELS = 8


def _judged(level: DataFrame, key: str) -> DataFrame:
    """Nodes (key, path, v, and what was found before) after a look at v: a quote gives up its v for its text and start, so that it is not opened."""
    level = level.withColumn("_o", F.try_variant_get("v", "$", f"struct<{', '.join(f'{f} variant' for f in QUOTE)}>"))
    quote = reduce(lambda a, b: a & b, [F.col(f"_o.{f}").isNotNull() for f in QUOTE])
    new = F.when(quote, F.struct(_typed(F.col("_o.text"), "STRING", "string").alias("text"), _typed(F.col("_o.start_char"), "BIGINT", "bigint").alias("start_char")))
    return level.select(key, "path", F.coalesce("_found", new).alias("_found"), "v").withColumn("v", F.when(F.col("_found").isNull(), F.col("v")))


def _opened(level: DataFrame, key: str) -> DataFrame:
    """The parts of all nodes, and the quotes found before as they are."""
    name = F.when(F.col("_key").isNull(), F.concat("path", F.lit("["), F.col("_at").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "_key"))
    parts = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("_at", "_key", "_v"))
    path = F.when(F.col("_found").isNull(), name).otherwise(F.col("path"))
    return parts.filter("_found is not null or _v is not null").select(key, path.alias("path"), "_found", F.col("_v").alias("v"))


def quotes_in(documents: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, text, start_char of each quote in JSON documents of any shape; a quote is not searched itself.

    Null and torn documents have none, nor have documents that name one field twice. A quote whose text is no string or whose
    start is no whole number keeps its path and has null there. A pass parses or reads its documents once and opens LEVELS
    levels of them, inside one stage; quotes found on the way are carried along without their document. There are as many
    passes as the deepest document has LEVELS levels.
    """
    level = documents.select(F.col(key), F.lit("").alias("path"), F.lit(None).cast("struct<text string, start_char bigint>").alias("_found"), F.try_parse_json(column).alias("v"))
    found = []
    while True:
        for _ in range(LEVELS):
            level = _opened(_judged(level, key), key)
        level = files.kept(level)
        found.append(level.filter("_found is not null").select(key, "path", "_found.text", "_found.start_char"))
        level = level.filter("_found is null and schema_of_variant(v) rlike '^(OBJECT|ARRAY)'")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
