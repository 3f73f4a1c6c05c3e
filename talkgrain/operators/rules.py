"""Rules and vectors: similarity, top-k retrieval, clustering, merging, conflicts, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.operators import search

SIMILAR, MIN_APPLICATIONS, MIN_SUCCESS = 0.7, 10, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def retrieve(queries: DataFrame, rules: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """queries (query_id, vec), active rules (rule_id, pos, vec): the k most similar; ties in insertion order. Rows without a vector match nothing."""
    return search.nearest(queries, rules, k).select("query_id", "rule_id", "rank", F.round("similarity", digits).alias("similarity"))


def leave_one_out(ranked: DataFrame, k: int) -> DataFrame:
    """Without the rules that come from the call itself; then the first k."""
    kept = ranked.filter(~F.coalesce(F.array_contains("source_call_ids", F.col("query_id")), F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def similar_pairs(rules: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs of rules with a cosine of at least the threshold."""
    return search.pairs(rules, threshold)


def clusters(rules: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """rule_id, cluster: complete linkage over all active rules, numbered by their first rules."""
    from talkgrain.operators import linkage

    return linkage.clusters(rules, threshold)


def merged(rules: DataFrame, cluster_of: DataFrame) -> DataFrame:
    """Per cluster: its sources in order without repeats, and summed counters."""
    rows = rules.join(cluster_of, "rule_id")
    sources = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sources"))), lambda x: x["sources"])))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), sources.alias("sources"), F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count"))


def retire(rules: DataFrame) -> DataFrame:
    """Retired once, or tried often enough with too little success; nothing comes back by itself."""
    n = F.col("success_count") + F.col("failure_count")
    bad = (n >= MIN_APPLICATIONS) & (F.try_divide(F.col("success_count"), n) < MIN_SUCCESS)
    return rules.withColumn("retired", F.col("retired") | F.coalesce(bad, F.lit(False)))


#: What a resolution does: to the rules in conflict, and with the candidate. Fixed values.
RESOLUTIONS = (("keep_existing", False, False), ("keep_new", True, True), ("discard", False, False), ("not_a_conflict", False, True))


def resolve(conflicts: DataFrame) -> DataFrame:
    """conflicts (resolution) and: retire_existing, activate_candidate; null while unresolved."""
    table = F.create_map(*[x for name, old, new in RESOLUTIONS for x in (F.lit(name), F.struct(F.lit(old).alias("o"), F.lit(new).alias("n")))])
    step = F.try_element_at(table, F.col("resolution"))
    return conflicts.withColumn("retire_existing", step["o"]).withColumn("activate_candidate", step["n"])


def usage(analyses: DataFrame, column: str = "retrieved_rule_ids") -> DataFrame:
    return analyses.select(F.explode(column).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("used"))
