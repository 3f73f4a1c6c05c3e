"""Registered queries on rules that follow from one another, on places of quotes and on state kept by streams. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.operators import evidence, induction, linkage, places
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import GROUPED_SQL, SPLIT_SQL, VECTOR_SQL, _checkpoints, _grouped_vectors, _vectors, query


@query("""WITH c AS (SELECT o_custkey, list({'k': o_orderkey, 'p': o_totalprice} ORDER BY o_orderkey) AS l FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderstatus = 'F') GROUP BY 1),
    f AS (SELECT list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.p - x[1].p) < 20000)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM c),
    i AS (SELECT unnest(kept).k AS k FROM f)
    SELECT o_orderkey AS candidate, o_orderkey IN (SELECT k FROM i) AS inserted FROM orders""")
def induction_fold(spark, sf_dir):
    """STR-12, STR-17: corrections become rules one after the other, unless an earlier one that became a rule conflicts (the same customer's, with a price less than 20000 away), or a rule that is active already does."""
    _checkpoints(spark)
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    cells = o.withColumn("cell", F.floor(F.col("o_totalprice") / 20000))
    other = cells.select(F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("q"), "o_custkey", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    alike = cells.join(other, ["o_custkey", "cell"]).filter("o_orderkey < b and abs(o_totalprice - q) < 20000").select(F.col("o_orderkey").alias("a"), "b")
    known = o.filter("o_orderpriority like '1%' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("candidate"), F.lit(0).alias("rule_id"))
    found, _ = induction.fold(o.select(F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("pos")), alike, known)
    return found.select("candidate", "inserted")


@query(f"""WITH {VECTOR_SQL}, p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id), s AS (SELECT label, count(*) AS size FROM e GROUP BY 1)
    SELECT s.label AS cluster, any_value(size) AS size, round(min(c), 6) AS least, round(median(c), 6) AS median FROM s LEFT JOIN p USING (label) GROUP BY 1""")
def cluster_statistics(spark, sf_dir):
    """AGG-30: size, least and median similarity of the pairs of each cluster, exactly."""
    _checkpoints(spark)
    v = _vectors(spark, sf_dir).select(F.col("label").alias("cluster"), F.col("vec_id").alias("rule_id"), "vec")
    return linkage.statistics(v).select("cluster", "size", F.round("least", 6).alias("least"), F.round("median", 6).alias("median"))


@query(f"""WITH {GROUPED_SQL}, p AS (SELECT a.vec_id - a.vec_id % 8 AS cluster, list_cosine_similarity(a.v, b.v) AS c FROM g a JOIN g b ON a.vec_id // 8 = b.vec_id // 8 AND a.vec_id < b.vec_id),
    s AS (SELECT vec_id - vec_id % 8 AS cluster, count(*) AS size FROM g GROUP BY 1), m AS (SELECT size, min(c) AS least FROM s LEFT JOIN p USING (cluster) GROUP BY s.cluster, size)
    SELECT size, count(*) AS clusters, round(min(least), 6) AS least FROM m GROUP BY 1""")
def cluster_sizes(spark, sf_dir):
    """AGG-30: how many clusters there are of each size, with the least similarity inside any of them."""
    _checkpoints(spark)
    v = _grouped_vectors(spark, sf_dir).select((F.col("vec_id") - F.col("vec_id") % 8).alias("cluster"), F.col("vec_id").alias("rule_id"), "vec")
    return linkage.statistics(v).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.round(F.min("least"), 6).alias("least"))


def _rules(spark, sf_dir):
    v = _grouped_vectors(spark, sf_dir)
    return v.select(
        F.col("vec_id").cast("long").alias("rule_id"), F.col("vec_id").cast("long").alias("pos"), "vec", F.array(F.col("vec_id") % 9, F.col("vec_id") % 4).cast("array<long>").alias("sources"),
        (F.col("vec_id") % 5).cast("long").alias("success_count"), (F.col("vec_id") % 3).cast("long").alias("failure_count"), (F.col("vec_id") % 13 == 0).alias("retired"),
    )


@query()
def consolidated_rules(spark, sf_dir):
    """STR-13, STR-18, CLU-03, FLT-11: rules of a cluster become its first; rules named by open conflicts and retired ones take no part. No SQL: the clustering is a loop; tested against brute force."""
    _checkpoints(spark)
    held = fx.read(spark, sf_dir, "embeddings").filter("vec_id % 17 = 3").select(F.col("vec_id").cast("long").alias("rule_id"))
    out = induction.consolidate(_rules(spark, sf_dir), held)
    return out.select("rule_id", "fate", "retired", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "success_count", "failure_count")


@query()
def prequential_loop(spark, sf_dir):
    """STR-19, AGG-43: five batches, with and without rules; retrieval, outcomes, induction, conflicts, consolidation and retirement follow from the rules that earlier batches left. No SQL: the state of a batch depends on the last; tested against brute force."""
    _checkpoints(spark)
    v = _grouped_vectors(spark, sf_dir)
    calls = v.select(F.col("vec_id").cast("long").alias("call_id"), (F.col("vec_id") % 5).cast("int").alias("batch"), "vec", F.concat(F.lit("s"), (F.floor(F.col("vec_id") / 8) % 7).cast("string")).alias("wants"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("s"), (F.floor(F.col("vec_id") / 8) % 7).cast("string"))).otherwise("?").alias("plain"))
    return induction.batches(calls, 5)[0]


ASKED = ("onon", "thth", "the ", "nowhere~~")


@query(SPLIT_SQL + f""", texts AS (SELECT call_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM turns GROUP BY call_id), a AS (SELECT call_id, t, unnest({list(ASKED)}) AS q FROM texts),
    h AS (SELECT *, strpos(t, q) - 1 AS start, len(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q)) AS occurrences FROM a WHERE contains(t, q))
    SELECT h.call_id, q AS quote, start, start + length(q) AS "end", min(s.pos) AS turn, any_value(occurrences)::INT AS occurrences FROM h JOIN split s ON s.call_id = h.call_id AND s.start_char <= start AND start < s.start_char + length(s.said) GROUP BY 1, 2, 3, 4""")
def evidence_places(spark, sf_dir):
    """SEG-05: where a quote is first, in which turn that starts, and how often it occurs, overlaps counted."""
    lines = fx.turns(spark, sf_dir)
    asked = evidence.transcript(lines).select("call_id", "transcript", F.explode(F.array(*map(F.lit, ASKED))).alias("ask_id"))
    turns = evidence.split_turns(lines).select("call_id", "pos", "start_char", "end_char")
    return places.evidence(asked.withColumn("quote", F.col("ask_id")), turns).withColumnRenamed("ask_id", "quote")


@query(SPLIT_SQL + """, o AS (SELECT *, unnest(range(1, len(string_split(line, 'the ')))) AS n FROM split), p AS (SELECT *, list_sum(list_transform(string_split(line, 'the ')[1:n], lambda x: length(x)))::BIGINT + 4 * (n - 1) AS off FROM o)
    SELECT call_id, (row_number() OVER (PARTITION BY call_id ORDER BY pos, n) - 1)::INT AS "match", source_line AS line_number, speaker, line_start + off AS start_char, line_start + off + 4 AS end_char, md5(line) AS line_text FROM p""")
def quote_lines(spark, sf_dir):
    """TXT-01: every match with its line, that line's speaker and text."""
    found = places.matches(evidence.transcript(fx.turns(spark, sf_dir)), "call_id", "transcript", F.lit("the "))
    return found.select("call_id", "match", F.col("line_number").cast("long").alias("line_number"), "speaker", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.md5("line_text").alias("line_text"))
