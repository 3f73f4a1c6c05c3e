"""The service around the analysis: documents walked and scrubbed, rules admitted and replayed, outside models asked, calls recorded."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, MapType, StringType, StructType

from talkgrain.functions import redact as R
from talkgrain.functions import text as T
from talkgrain.operators import evidence, linkage, rules
from talkgrain.sources import files

def every_string(value: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """The value with each string in it changed, however deep; keys of maps and names of fields stay."""
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, StructType):
        made = F.struct(*[every_string(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: every_string(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: every_string(x, kind.valueType, change))
    return value


def scrubbed(df: DataFrame, column: str) -> Column:
    """A column with the personal data in all its strings redacted."""
    return every_string(F.col(column), df.schema[column].dataType, lambda s: R.redacted(s)["text"])


def admitted(lines: DataFrame) -> DataFrame:
    """Per call of lines (call_id, pos, line): the redacted transcript, its replacements, and the first line (redacted) without a speaker, which refuses it."""
    done = R.redacted(F.col("line"))
    turns = evidence.split_turns(lines.withColumn("_r", done).select("call_id", "pos", F.col("_r.text").alias("line"), F.col("_r.count").alias("replaced")))
    lost = F.when(F.col("speaker").isNull() & (F.trim("line") != ""), F.struct("source_line", "line"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = turns.groupBy("call_id").agg(F.array_join(parts, "\n").alias("transcript"), F.sum("replaced").alias("replaced"), F.min(lost).alias("_lost"))
    return out.select("call_id", "transcript", "replaced", F.col("_lost.source_line").alias("bad_line"), F.col("_lost.line").alias("bad_text"), F.col("_lost").isNull().alias("admitted"))


def embedded(texts: DataFrame, column: str, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """texts and vec: what an outside model makes of a column, a batch at a time; null is embedded as the empty text."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = model([t if isinstance(t, str) else "" for t in frame[column]])
            yield frame.assign(vec=[v.tolist() for v in np.asarray(vectors, float)])

    return texts.mapInPandas(ask, StructType([*texts.schema.fields]).add("vec", ArrayType(DoubleType())))


def retried(rows: DataFrame, key: str, ask: Callable[[Any, int], str], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """key, answer, tries, error: an outside call per row, repeated after doubled waits; what still fails is a row with its error and without an answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in frame[key]:
                answer = error = None
                for n in range(attempts):
                    try:
                        answer, error = ask(k, n), None
                        break
                    except Exception as problem:  # whatever the outside raises belongs to the row
                        error = f"{type(problem).__name__}: {problem}"
                        if n + 1 < attempts:
                            time.sleep(wait * 2**n)
                out.append((k, answer, n + 1, error))
            yield pd.DataFrame(out, columns=[key, "answer", "tries", "error"])

    return rows.select(key).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, answer string, tries int, error string")


def located(transcript: Column, quotes: Column) -> Column:
    """Struct: starts (place of each quote's first occurrence), bad (every quote that is blank or not in the text)."""
    found = F.transform(quotes, lambda q: F.struct(q.alias("q"), F.when(~q.rlike("^\\s*$"), T.first_offset(transcript, q)).alias("at")))
    bad = F.transform(F.filter(found, lambda x: x["at"].isNull()), lambda x: x["q"])
    return F.struct(F.transform(found, lambda x: x["at"]).alias("starts"), bad.alias("bad"))


def call_records(calls: DataFrame, usages: DataFrame) -> DataFrame:
    """A record per call (call_id, error, failure, seconds, prediction): outcome, tokens and requests summed over its usages (call_id, pos, prompt, completion, finish); only calls that went well keep a prediction."""
    ends = F.transform(F.array_sort(F.collect_list(F.when(F.col("finish").isNotNull(), F.struct("pos", "finish")))), lambda x: x["finish"])
    used = usages.groupBy("call_id").agg(F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.count(F.lit(1)).alias("requests"), ends.alias("finish_reasons"))
    outcome = F.when(F.col("error").isNull(), "ok").otherwise(F.coalesce("failure", F.lit("error")))
    out = calls.join(used, "call_id", "left").withColumn("outcome", outcome)
    none = F.array().cast("array<string>")
    return out.select(
        "call_id", "outcome", F.bround("seconds", 3).alias("latency_s"), "prompt_tokens", "completion_tokens", F.coalesce("requests", F.lit(0).cast("long")).alias("requests"),
        F.coalesce("finish_reasons", none).alias("finish_reasons"), F.substring("error", 1, 1000).alias("error"), F.when(F.col("outcome") == "ok", F.col("prediction")).alias("prediction"),
    )


def inserted(candidates: DataFrame, active: DataFrame, judged: DataFrame) -> DataFrame:
    """candidates (candidate): whether each becomes a rule, and the active rules (rule_id) that a judge (candidate, rule_id, conflict) holds against it, which stay as they are."""
    against = judged.filter("conflict").join(active.select("rule_id"), "rule_id", "left_semi").groupBy("candidate").agg(F.sort_array(F.collect_set("rule_id")).alias("conflicts"))
    return candidates.join(against, "candidate", "left").select("candidate", F.col("conflicts").isNull().alias("inserted"), "conflicts")


def retrieved_from_others(queries: DataFrame, known: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """rules.retrieve over known rules with source_call_ids, without those that come from the call itself: as many more are ranked as one call can own."""
    sources = known.select("rule_id", "source_call_ids")
    own = sources.select("rule_id", F.explode(F.array_distinct("source_call_ids")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ranked = rules.retrieve(queries, known, k + own, digits).join(sources, "rule_id")
    return rules.leave_one_out(ranked, k).select("query_id", "rule_id", "rank", "similarity")


def medoids(known: DataFrame, cluster_of: DataFrame) -> DataFrame:
    """cluster, size, rule_id of the member most similar to all members; the sum of its cosines is one product with the cluster's summed vector. Ties go to the first rule."""
    rows = known.join(cluster_of, "rule_id").filter("cluster is not null")
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("rule_id").alias("rule_id"), F.max(F.size("vec") > 0).alias("_any"))
    alone = size.filter("size = 1 and _any").drop("_any")
    norm = F.sqrt(rules.dot(F.col("vec"), F.col("vec")))
    unit = F.transform(F.array(norm), lambda n: F.transform("vec", lambda x: F.when(n == 0, 0.0).otherwise(x / n)))[0]  # an inner lambda's norm would be computed for each number
    rows = rows.join(size.filter("size > 1").select("cluster"), "cluster").withColumn("_u", unit)
    sums = rows.select("cluster", F.posexplode("_u").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("_sum"))
    scored = rows.join(sums, "cluster").withColumn("_s", F.round(rules.dot(F.col("_u"), F.col("_sum")), 9))
    return scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max_by("rule_id", F.struct("_s", -F.col("pos"))).alias("rule_id")).unionByName(alone)


def replayed(known: DataFrame, batch: str, n: int, threshold: float = rules.SIMILAR) -> DataFrame:
    """Per batch 0..n-1 of rules (rule_id, pos, vec): rules consolidated, the largest cluster, rules left. A cluster's medoid, the first rule of its vector, goes on to the next batch with its pairs, so that only new rules are searched."""
    spark, out, pairs = known.sparkSession, [], None
    known = known.withColumn("pos", F.col("pos").cast("long")).withColumn("fresh", F.lit(True))
    active = known.filter(F.lit(False)).select("rule_id", "pos", "vec", "fresh")
    for b in range(n):
        active = active.unionByName(known.filter(F.col(batch) == b).select("rule_id", "pos", "vec", "fresh"))
        of, pairs = linkage.clusters_onwards(active, threshold, pairs)
        found = files.kept(medoids(active, of))
        total, most, left = found.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.count(F.lit(1))).first()
        out.append((b, total, most, left))
        active = files.kept(active.join(found.select("rule_id"), "rule_id", "left_semi").withColumn("fresh", F.lit(False)))
        for end in ("a", "b"):
            pairs = pairs.join(active.select(F.col("pos").alias(end)), end, "left_semi")
    return spark.createDataFrame(out, "batch int, consolidated long, max_cluster long, active_after long")
