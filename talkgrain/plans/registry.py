"""The library's registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.functions import redact as R
from talkgrain.functions import text as T
from talkgrain.operators import datasets, evidence, lifecycle, metrics, rules, timelines, validators
from talkgrain.plans import fixtures as fx
from talkgrain.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LANGUAGE = "['ar', 'en', 'mixed'][({} % 3 + 1)::INT]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- evidence -----------------------------------------------------------------------------------------------------------

SPLIT_SQL = f"""WITH {fx.TURNS_SQL}, numbered AS (
    SELECT *, row_number() OVER w AS source_line, coalesce(sum(length(line) + 1) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
    FROM turns WINDOW w AS (PARTITION BY call_id ORDER BY pos)),
split AS (SELECT *, nullif(regexp_extract(line, '^(Agent|Customer):\\s*', 1), '') AS speaker, regexp_replace(regexp_replace(line, '^(?:Agent|Customer):\\s*', ''), '^\\s+|\\s+$', '', 'g') AS said,
    line_start + length(line) - length(regexp_replace(line, '^(?:Agent|Customer):\\s*', '')) AS start_char FROM numbered)"""


@query(SPLIT_SQL + " SELECT call_id, pos, source_line, line_start, speaker, start_char, start_char + length(said) AS end_char, 'en' AS script, md5(said) AS said FROM split")
def turns_split(spark, sf_dir):
    """TXT-03, TXT-04, TXT-07, WIN-01, SEG-01."""
    t = evidence.split_turns(fx.turns(spark, sf_dir))
    return t.select("call_id", "pos", "source_line", "line_start", "speaker", "start_char", "end_char", "script", F.md5("said").alias("said"))


GROUND_SQL = SPLIT_SQL + """, spoken AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY pos) AS nth FROM split WHERE speaker IS NOT NULL AND said <> ''),
claims AS (
    SELECT call_id, language, CASE speaker WHEN 'Agent' THEN 'commitment' ELSE 'sentiment' END AS kind, said AS quote FROM spoken WHERE (speaker = 'Agent' AND nth <= 2) OR (speaker = 'Customer' AND nth <= 3)
    UNION ALL SELECT DISTINCT call_id, language, 'commitment', '(unsupported claim 1)' FROM turns WHERE call_id % 2 = 1),
texts AS (SELECT call_id, string_agg(line, chr(10) ORDER BY pos) AS transcript FROM turns GROUP BY call_id),
grounded AS (SELECT c.*, strpos(transcript, quote) - 1 AS found_at FROM claims c JOIN texts USING (call_id)),
counts AS (SELECT call_id, count(*) AS proposed, count(*) FILTER (WHERE found_at >= 0) AS kept FROM grounded WHERE kind <> 'sentiment' GROUP BY call_id),
calls AS (SELECT call_id, language, coalesce(proposed, 0) AS proposed, coalesce(kept, 0) AS kept, CASE WHEN coalesce(proposed, 0) = 0 THEN 1.0 ELSE kept / proposed END AS coverage
          FROM (SELECT DISTINCT call_id, language FROM turns) LEFT JOIN counts USING (call_id))"""


def _calls(spark, sf_dir):
    lines = fx.turns(spark, sf_dir)
    turns = evidence.split_turns(lines)
    grounded = evidence.ground(evidence.extract(turns, F.pmod("call_id", F.lit(2)).cast("int")), evidence.transcript(lines))
    return evidence.confidence(grounded, lines)


@query(GROUND_SQL + " SELECT language, count(*) AS calls, sum(proposed)::BIGINT AS proposed, sum(kept)::BIGINT AS kept, round(avg(coverage), 6) AS coverage, count(*) FILTER (WHERE coverage < 0.7) AS escalated FROM calls GROUP BY language")
def grounded_summary(spark, sf_dir):
    """EXT-01, GRD-01, GRD-03, GRD-04, GRD-05, AGG-24, AGG-40, WIN-03, SRC-01: the spine."""
    return evidence.summary(_calls(spark, sf_dir))


flagship = grounded_summary


@query(GROUND_SQL + " SELECT call_id, language, proposed, kept, coverage, coverage < 0.7 AS needs_review, CASE WHEN coverage < 0.7 THEN 'escalate' ELSE 'end' END AS route FROM calls")
def routed_calls(spark, sf_dir):
    """GRD-04, GRD-05, PRJ-07, PRJ-10 per call."""
    return _calls(spark, sf_dir).withColumn("route", evidence.route(F.lit(None), F.col("needs_review")))


@query(GROUND_SQL + " SELECT language, round(avg((found_at >= 0)::INT), 6) AS grounding_precision, round(1 - avg((found_at >= 0)::INT) FILTER (WHERE kind <> 'sentiment'), 6) AS unsupported_rate, count(*) AS quotes FROM grounded GROUP BY language")
def pooled_support(spark, sf_dir):
    """AGG-04, AGG-05, TXT-01, TXT-02, PRJ-01."""
    lines = fx.turns(spark, sf_dir)
    claims = evidence.extract(evidence.split_turns(lines), F.pmod("call_id", F.lit(2)).cast("int"))
    return metrics.pooled_support(evidence.ground(claims, evidence.transcript(lines)).withColumnRenamed("kept", "supported"))


@query(r"""WITH d AS (SELECT doc_id, text, 'the ' AS q FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, string_split(text, q) AS p, q FROM d)
    SELECT doc_id, len(p) - 1 AS found, CASE WHEN len(p) > 1 THEN length(p[1]) END AS first_at, CASE WHEN len(p) > 1 THEN list_sum(list_transform(p[1:-2], lambda x: length(x) + 4))::BIGINT - 4 + 0 * len(p) END AS last_at FROM s""")
def quote_matches(spark, sf_dir):
    """TXT-01: every non-overlapping occurrence; SEG-05 agrees for a quote that cannot overlap itself."""
    at = T.all_offsets(F.col("text"), F.lit("the "))
    rows = fx.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", at.alias("at"))
    return rows.select("doc_id", F.size("at").cast("long").alias("found"), F.get("at", 0).cast("long").alias("first_at"), F.get("at", F.size("at") - 1).cast("long").alias("last_at"))


# --- text ---------------------------------------------------------------------------------------------------------------


@query()
def pii_redacted(spark, sf_dir):
    """PII-01: its lookbehinds are beyond DuckDB's regexes; the tests hold it against examples."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", R.redacted(F.coalesce("text", F.lit(""))).alias("r"))
    return d.select("doc_id", "lang", "r.original_length", "r.count", F.md5("r.text").alias("redacted_md5"), F.array_join(F.array_sort(F.array_distinct(R.placeholders(F.col("r.text")))), ",").alias("labels"))


@query(r"""WITH r AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '\p{Nd}(?:[ .\-]?\p{Nd})*')) AS run FROM documents)
    SELECT lang, regexp_replace(run, '\p{Nd}', 'd', 'g') AS shape, count(*) AS runs, count(DISTINCT doc_id) AS docs FROM r WHERE length(regexp_replace(run, '\P{Nd}', '', 'g')) >= 7 GROUP BY 1, 2""")
def digit_run_audit(spark, sf_dir):
    """PII-02, AGG-26."""
    r = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(R.digit_runs(F.col("text"))).alias("run"))
    return r.groupBy("lang", R.shape(F.col("run")).alias("shape")).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("doc_id").alias("docs"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x))) AS w FROM benchmark)
    SELECT a.item_id AS a, max(round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6)) AS best
    FROM t a JOIN t b ON a.item_id % 10 = b.item_id % 10 AND a.item_id <> b.item_id GROUP BY 1""")
def best_overlap(spark, sf_dir):
    """SIM-01, TXT-06, JOIN-20, AGG-02's matching: the best token overlap within a call."""
    t = fx.read(spark, sf_dir, "benchmark").select(F.col("item_id"), F.pmod("item_id", F.lit(10)).alias("call"), T.tokens(F.col("text")).alias("w"))
    b = t.select(F.col("item_id").alias("other"), "call", F.col("w").alias("v"))
    pairs = t.join(b, "call").filter("item_id <> other")
    return pairs.groupBy(F.col("item_id").alias("a")).agg(F.max(F.round(T.jaccard(F.col("w"), F.col("v")), 6)).alias("best"))


@query()
def word_error_rates(spark, sf_dir):
    """TXT-05, SIM-02, AGG-07, AGG-08, AGG-09: a reference against itself with words lost, changed and added."""
    d = fx.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("call_id"), fx.category("item_id").alias("language"), F.col("text").alias("reference"))
    d = d.withColumn("hypothesis", F.regexp_replace(F.regexp_replace("reference", " the ", " "), " of ", " off well "))
    s = metrics.word_errors(d)
    return metrics.wer_pooled(s).join(metrics.wer_mean(s), "language").join(metrics.wer_weighted(s), "language")


@query(r"""SELECT doc_id, CASE WHEN text ~ '[A-Za-z]' THEN 'ltr' ELSE 'ltr' END AS direction, octet_length(encode(text)) AS bytes, length(text) AS chars, split_part(text, ' ', 1) AS code, left(text, 8) AS short FROM documents""")
def display_scalars(spark, sf_dir):
    """TXT-08, TXT-17, TXT-18, TXT-19."""
    t = F.col("text")
    return fx.read(spark, sf_dir, "documents").select("doc_id", T.direction(t).alias("direction"), F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"), F.substring_index(t, " ", 1).alias("code"), F.left(t, F.lit(8)).alias("short"))


@query(r"""SELECT event_id, regexp_replace('list[' || user_id || '].field', '\[[^\]]*\]', '', 'g') AS topic, nullif(regexp_extract('x ' || props || ' y', '\{[\s\S]*\}', 0), '') AS js,
    CASE WHEN floor(value / 60) < 1 THEN '<1m' WHEN floor(value / 60) < 60 THEN floor(value / 60)::BIGINT || 'm' ELSE floor(floor(value / 60) / 60)::BIGINT || 'h ' || floor(value / 60)::BIGINT % 60 || 'm' END AS waiting,
    least(2.0 * pow(2.0, user_id % 8), 60.0) AS backoff FROM events""")
def path_and_time_scalars(spark, sf_dir):
    """TXT-11, TXT-13, TXT-18, DAT-03."""
    e = fx.read(spark, sf_dir, "events")
    path = F.concat(F.lit("list["), F.col("user_id").cast("string"), F.lit("].field"))
    return e.select("event_id", T.topic(path).alias("topic"), T.json_slice(F.concat(F.lit("x "), "props", F.lit(" y"))).alias("js"), T.waiting(F.col("value")).alias("waiting"), lifecycle.backoff(F.pmod("user_id", F.lit(8))).alias("backoff"))


# --- metrics ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.SCORES_SQL}, p AS (SELECT call_id, criterion, score FROM preds QUALIFY row_number() OVER (PARTITION BY call_id, criterion ORDER BY pos DESC) = 1),
    paired AS (SELECT DISTINCT call_id, language FROM refs WHERE call_id IN (SELECT call_id FROM preds)),
    a AS (SELECT r.call_id, 1 - avg(abs(p.score - r.score)) AS a FROM refs r JOIN p USING (call_id, criterion) GROUP BY 1)
    SELECT language, round(avg(coalesce(a, 0)), 6) AS agreement, count(*) AS calls FROM paired LEFT JOIN a USING (call_id) GROUP BY 1""")
def rubric_agreement(spark, sf_dir):
    """AGG-03, JOIN-01, JOIN-03."""
    return metrics.rubric_agreement(fx.scores(spark, sf_dir, "prediction"), fx.scores(spark, sf_dir, "reference"))


VERDICT_SQL = f"""v AS (SELECT d.doc_id AS claim_id, d.source AS review_id, {LANGUAGE.format("d.doc_id")} AS language, CASE WHEN quality = 1 AND toxic = 0 THEN 'confirm' WHEN toxic = 1 THEN 'reject' ELSE 'correct' END AS verdict
    FROM documents d JOIN labels l USING (doc_id))"""


def _verdicts(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("review_id"), fx.category("doc_id").alias("language"))
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "confirm").when(F.col("toxic") == 1, "reject").otherwise("correct")
    return d.join(fx.read(spark, sf_dir, "labels"), "doc_id").select("language", "review_id", verdict.alias("verdict"))


@query(f"""WITH {VERDICT_SQL}, p AS (SELECT language, review_id, count(verdict) AS n, count(*) FILTER (WHERE verdict = 'confirm') AS c, count(*) FILTER (WHERE verdict = 'correct') AS k, count(*) FILTER (WHERE verdict = 'reject') AS r FROM v GROUP BY 1, 2)
    SELECT language, count(*) AS reviews, sum(n)::BIGINT AS claims, sum(c)::BIGINT AS confirmed, sum(k)::BIGINT AS corrected, sum(r)::BIGINT AS rejected, round(sum(c) / sum(n), 6) AS claim_rate, round(avg((c = n)::INT), 6) AS call_rate FROM p GROUP BY 1""")
def reviewer_agreement(spark, sf_dir):
    """AGG-11, AGG-12, JOIN-04."""
    return metrics.reviewer_agreement(_verdicts(spark, sf_dir))


@query("SELECT event_type, user_id % 5 AS arm, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2")
def latency_quantiles(spark, sf_dir):
    """AGG-17."""
    return metrics.quantiles(fx.read(spark, sf_dir, "events").withColumn("arm", F.pmod("user_id", F.lit(5))), ["event_type", "arm"], "value")


@query(f"""SELECT 'arm' || user_id % 3 AS arm, {LANGUAGE.format("event_id")} AS language, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS valid, round(avg((event_type <> 'error')::INT), 6) AS valid_rate, count(*) FILTER (WHERE event_type = 'error') AS errors,
    round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95, round(avg(length(props)), 6) AS tokens FROM events GROUP BY 1, 2""")
def benchmark_cells(spark, sf_dir):
    """AGG-16, FLT-08, PRJ-14."""
    e = fx.read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    arm = F.concat(F.lit("arm"), F.pmod("user_id", F.lit(3)).cast("string"))
    return metrics.benchmark_cells(e.select(arm.alias("arm"), fx.category("event_id").alias("language"), outcome.alias("outcome"), F.col("value").alias("latency"), F.length("props").alias("tokens")))


@query(f"""WITH c AS (SELECT {LANGUAGE.format("user_id")} AS language, event_id % 4 AS attempts, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, epoch_us(ts) / 1e6 AS q, epoch_us(ts) / 1e6 + value AS s, epoch_us(ts) / 1e6 + value * 3 AS f FROM events)
    SELECT language, count(*) AS n, round(quantile_cont(s - q, 0.5), 6) AS wait_p50, round(quantile_cont(s - q, 0.95), 6) AS wait_p95, round(quantile_cont(f - s, 0.5), 6) AS time_p50, round(quantile_cont(f - s, 0.95), 6) AS time_p95,
    round(avg((attempts > 1)::INT), 6) AS retry_rate, round(avg((status = 'failed')::INT), 6) AS failure_rate, round(count(*) * 60 / (max(f) - min(q)), 6) AS calls_per_minute FROM c GROUP BY 1""")
def service_burst(spark, sf_dir):
    """AGG-21, DAT-02."""
    q = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = fx.read(spark, sf_dir, "events").select(fx.category("user_id").alias("language"), F.pmod("event_id", F.lit(4)).alias("attempts"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), q.alias("queued"), (q + F.col("value")).alias("started"), (q + F.col("value") * 3).alias("finished"))
    return metrics.service(e)


@query(f"""WITH s AS (SELECT {LANGUAGE.format("o_orderkey")} AS language, o_orderkey % 4 AS repeat, CASE WHEN o_custkey % 2 = 0 THEN 'on' ELSE 'off' END AS arm, o_totalprice / 1e5 AS accuracy FROM orders),
    w AS (SELECT language, repeat, avg(accuracy) FILTER (WHERE arm = 'off') AS off_, avg(accuracy) FILTER (WHERE arm = 'on') AS on_ FROM s GROUP BY 1, 2),
    o AS (SELECT language, avg(on_ - off_) AS effect, greatest(max(off_) - min(off_), max(on_ - off_) - min(on_ - off_)) AS noise, count(on_ - off_) AS repeats FROM w GROUP BY 1)
    SELECT language, round(effect, 6) AS effect, round(noise, 6) AS noise, repeats, CASE WHEN repeats < 2 THEN 'incomplete' WHEN abs(effect) <= noise THEN 'inconclusive' WHEN effect > 0 THEN 'confirms' ELSE 'contradicts' END AS verdict FROM o""")
def paired_verdict(spark, sf_dir):
    """AGG-31, JOIN-13."""
    o = fx.read(spark, sf_dir, "orders")
    return metrics.paired_verdict(o.select(fx.category("o_orderkey").alias("language"), F.pmod("o_orderkey", F.lit(4)).alias("repeat"), F.when(F.pmod("o_custkey", F.lit(2)) == 0, "on").otherwise("off").alias("arm"), (F.col("o_totalprice") / 1e5).alias("accuracy")))


@query("""WITH k AS (SELECT user_id AS series, count(*) AS n, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT series, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient' WHEN b > a THEN 'rising' WHEN b < a THEN 'falling' ELSE 'flat' END AS trend FROM (SELECT DISTINCT user_id AS series FROM events) LEFT JOIN k USING (series)""")
def metric_trend(spark, sf_dir):
    """AGG-34, WIN-04, WIN-05."""
    e = fx.read(spark, sf_dir, "events")
    return metrics.trend(e.select(F.col("user_id").alias("series"), F.col("event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("value")).alias("value")))


# --- timelines ----------------------------------------------------------------------------------------------------------

BOTH = f"{fx.segments_sql('asr', 'asr')}, {fx.segments_sql('speakers', 'spk')}"


@query(f"""WITH {BOTH}, j AS (SELECT a.call_id, a.pos, s.name AS speaker, s.pos AS p, CASE WHEN s.pos IS NOT NULL THEN greatest(0.0, least(a.end_sec, s.end_sec) - greatest(a.start_sec, s.start_sec)) END AS o, abs((a.start_sec + a.end_sec) / 2 - (s.start_sec + s.end_sec) / 2) AS d FROM asr a LEFT JOIN spk s USING (call_id))
    SELECT call_id, pos, speaker, round(o, 6) AS overlap_sec FROM j QUALIFY row_number() OVER (PARTITION BY call_id, pos ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, p) = 1""")
def speaker_alignment(spark, sf_dir):
    """JOIN-14, SIM-05, SEG-02."""
    return timelines.align(fx.segments(spark, sf_dir, "asr"), fx.segments(spark, sf_dir, "speakers"))


@query(f"""WITH {BOTH}, pt AS (SELECT DISTINCT call_id, start_sec AS at FROM asr) SELECT pt.call_id, pt.at, min(s.pos) AS span_pos FROM pt LEFT JOIN spk s ON pt.call_id = s.call_id AND pt.at >= s.start_sec AND pt.at < s.end_sec GROUP BY 1, 2""")
def point_in_span(spark, sf_dir):
    """JOIN-15, JOIN-16."""
    points = fx.segments(spark, sf_dir, "asr").select("call_id", F.col("start_sec").alias("at")).distinct()
    return timelines.covering(points, fx.segments(spark, sf_dir, "speakers"))


@query(f"""WITH {fx.segments_sql('asr', 'asr')}, m AS (SELECT *, CASE WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS n FROM asr WINDOW w AS (PARTITION BY call_id ORDER BY pos)),
    i AS (SELECT *, sum(n) OVER (PARTITION BY call_id ORDER BY pos) AS island FROM m)
    SELECT call_id, island::BIGINT AS island, min(name) AS speaker, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, count(*) AS segments FROM i GROUP BY 1, 2""")
def speaker_islands(spark, sf_dir):
    """WIN-02, ORD-06."""
    return timelines.islands(fx.segments(spark, sf_dir, "asr"))


@query("""WITH f AS (SELECT o_orderkey AS call_id, unnest(generate_series(0, (floor((o_orderkey % 40) / 100.0 / 0.01) - 1)::BIGINT)) AS frame FROM orders)
    SELECT call_id, count(*) AS frames, max(frame) AS last FROM f GROUP BY 1""")
def frame_grid(spark, sf_dir):
    """AGG-10's grid."""
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.pmod("o_orderkey", F.lit(40)) / 100.0).alias("end_sec"))
    return timelines.frames(o).groupBy("call_id").agg(F.count(F.lit(1)).alias("frames"), F.max("frame").cast("long").alias("last"))


# --- rules and vectors --------------------------------------------------------------------------------------------------

VECTOR_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _checkpoints(spark) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(files.shared_folder(spark, "checkpoints"))


def _vectors(spark, sf_dir):
    return fx.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


#: Vectors that cluster: each leans towards the first of its eight.
GROUPED_SQL = """g AS (SELECT a.vec_id, a.label, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + 1.6 * coalesce(b.embedding[i]::DOUBLE, 0)) AS v FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 8)"""


def _grouped_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    head = v.filter("vec_id % 8 = 0").select(F.col("vec_id").alias("head"), F.col("vec").alias("u"))
    near = F.zip_with("vec", F.coalesce("u", F.transform("vec", lambda _: F.lit(0.0))), lambda x, y: x + F.lit(1.6) * y)
    return v.join(head, F.col("head") == F.col("vec_id") - F.col("vec_id") % 8, "left").select("vec_id", "label", near.alias("vec"))


@query(f"""WITH {VECTOR_SQL}, s AS (SELECT q.vec_id AS query_id, r.vec_id AS rule_id, list_cosine_similarity(q.v, r.v) AS c FROM e q JOIN e r ON q.vec_id % 20 = 0 AND r.label % 5 <> 0)
    SELECT query_id, rule_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, rule_id)::BIGINT AS rank, round(c, 6) AS similarity FROM s QUALIFY rank <= 5""")
def retrieved_rules(spark, sf_dir):
    """TOP-01, JOIN-18, SIM-03, FLT-02: the five most similar active rules of each query; k is the feature. Queries are the ids divisible by 20, against all active rules."""
    v = _vectors(spark, sf_dir)
    r = v.filter("label % 5 <> 0").select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec")
    return rules.retrieve(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec"), r, 5).withColumn("rank", F.col("rank").cast("long"))


@query()
def rule_clusters(spark, sf_dir):
    """CLU-01: complete linkage of all vectors, leaning towards the first of their eight; it is tested against brute force."""
    _checkpoints(spark)
    v = _grouped_vectors(spark, sf_dir)
    return rules.clusters(v.select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec"))


@query("""SELECT o_orderkey AS rule_id, o_orderkey % 12 AS success_count, o_custkey % 12 AS failure_count,
    o_orderkey % 50 = 0 OR (o_orderkey % 12 + o_custkey % 12 >= 10 AND (o_orderkey % 12) / (o_orderkey % 12 + o_custkey % 12) < 0.5) AS retired FROM orders""")
def retired_rules(spark, sf_dir):
    """STR-15."""
    o = fx.read(spark, sf_dir, "orders").selectExpr("o_orderkey as rule_id", "o_orderkey % 12 as success_count", "o_custkey % 12 as failure_count", "o_orderkey % 50 = 0 as retired")
    return rules.retire(o)


@query("""SELECT event_id, r AS resolution, CASE WHEN r IS NULL THEN NULL ELSE r = 'keep_new' END AS retire_existing, CASE WHEN r IS NULL THEN NULL ELSE r IN ('keep_new', 'not_a_conflict') END AS activate_candidate
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'keep_existing' WHEN 'view' THEN 'keep_new' WHEN 'error' THEN 'discard' WHEN 'signup' THEN 'not_a_conflict' END AS r FROM events)""")
def resolved_conflicts(spark, sf_dir):
    """STR-14, VAL-10, FLT-04."""
    r = F.when(F.col("event_type") == "click", "keep_existing").when(F.col("event_type") == "view", "keep_new").when(F.col("event_type") == "error", "discard").when(F.col("event_type") == "signup", "not_a_conflict")
    return rules.resolve(fx.read(spark, sf_dir, "events").select("event_id", r.alias("resolution")))


@query("SELECT l_partkey AS rule_id, count(*) AS used FROM lineitem GROUP BY 1")
def rule_usage(spark, sf_dir):
    """AGG-15, JSN-02, JOIN-08."""
    a = fx.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("retrieved_rule_ids"))
    return rules.usage(a)


# --- lifecycle ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id AS call_id, row_number() OVER w AS attempt, row_number() OVER w = 1 AS won FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def claimed_calls(spark, sf_dir):
    """STR-02."""
    e = fx.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("call_id"), F.col("ts").alias("at"))
    return lifecycle.claims(e).select("event_id", "call_id", F.col("attempt").cast("long").alias("attempt"), "won")


STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'awaiting_review' ELSE 'failed' END"


def _status():
    return F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "awaiting_review").otherwise("failed")


@query(f"""WITH s AS (SELECT event_id, user_id AS call_id, ts, {STATUS_SQL} AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS previous FROM s)
    SELECT event_id, call_id, status, previous, CASE WHEN previous IS NOT NULL THEN previous || '>' || status IN ({", ".join(f"'{a}>{b}'" for a, b in lifecycle.LEGAL)}) END AS legal FROM l""")
def legal_transitions(spark, sf_dir):
    """STR-03, STR-08."""
    e = fx.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("call_id"), F.col("ts").alias("at"), _status().alias("status"))
    return lifecycle.transitions(e).select("event_id", "call_id", "status", "previous", "legal")


@query(f"""WITH c AS (SELECT event_id, {STATUS_SQL} AS status, event_id % 6 AS attempts, epoch_us(ts) / 1e6 AS t FROM events), n AS (SELECT max(t) - 100000 AS now FROM c)
    SELECT event_id, status, CASE WHEN status = 'queued' AND t < now - 900 THEN 'requeue' WHEN status = 'processing' AND t < now - 900 AND attempts >= 4 THEN 'fail' WHEN status = 'processing' AND t < now - 900 THEN 'release' ELSE 'none' END AS action FROM c, n""")
def reaped_calls(spark, sf_dir):
    """STR-07, DAT-04."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    c = fx.read(spark, sf_dir, "events").select("event_id", _status().alias("status"), F.pmod("event_id", F.lit(6)).alias("attempts"), t.alias("queued"), F.lit(None).cast("double").alias("enqueued"), t.alias("started"))
    now = c.agg((F.max("queued") - 100000).alias("now"))
    return lifecycle.reap(c.join(F.broadcast(now)), F.col("now")).select("event_id", "status", "action")  # now is one row


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_state(spark, sf_dir):
    """JOIN-26, SRC-08, SNK-05."""
    return lifecycle.latest(fx.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


# --- data sets ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::BIGINT AS batch FROM orders")
def sequential_batches(spark, sf_dir):
    """BAT-01, AGG-44."""
    return datasets.batches(fx.read(spark, sf_dir, "orders"), 5, "o_orderstatus", "o_orderkey").select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("""WITH w AS (SELECT n_name AS name, n_nationkey AS ord, (n_nationkey + 3)::DOUBLE AS weight FROM nation), x AS (SELECT *, weight * 997 / sum(weight) OVER () AS x FROM w),
    r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, ord) AS k, 997 - sum(floor(x)) OVER () AS l FROM x) SELECT name, ord, weight, (f + CASE WHEN k <= l THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def apportioned(spark, sf_dir):
    """BAT-02."""
    return datasets.apportion(fx.read(spark, sf_dir, "nation").selectExpr("n_name as name", "n_nationkey as ord", "cast(n_nationkey + 3 as double) as weight"), 997)


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey)) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus FROM s WHERE r <= round_even(n * 0.1, 0)""")
def held_out_sample(spark, sf_dir):
    """BAT-03, FLT-13."""
    return datasets.sample(fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 0.1, 7, "o_orderstatus", "o_orderkey")


@query("""WITH s AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3:' || c_custkey)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT c_custkey, c_nationkey, CASE WHEN n >= 2 AND r <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS part FROM s""")
def stratified_split(spark, sf_dir):
    """BAT-04, FLT-09."""
    return datasets.split(fx.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), 0.2, 3, "c_nationkey", "c_custkey")


@query("""WITH t AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer), n AS (SELECT min(k) AS k FROM (SELECT max(turn) AS k FROM t GROUP BY c_mktsegment))
    SELECT c_custkey, c_mktsegment, turn FROM t, n WHERE turn <= k""")
def interleaved(spark, sf_dir):
    """ORD-05, SRC-13, FLT-10."""
    return datasets.interleave(fx.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", even=True).withColumn("turn", F.col("turn").cast("long"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1")
def first_examples(spark, sf_dir):
    """DED-01, ORD-03, ORD-04."""
    return datasets.first_of(fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], "l_linenumber")


# --- joins, sets, validators --------------------------------------------------------------------------------------------


@query("""SELECT n_name, count(DISTINCT c_custkey) AS calls, count(o_orderkey) AS analyses, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def queue_view(spark, sf_dir):
    """JOIN-05, PRJ-09, MTH-01, AGG-14."""
    c = fx.read(spark, sf_dir, "customer").join(F.broadcast(fx.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    o = fx.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name").agg(F.count_distinct("c_custkey").alias("calls"), F.count("o_orderkey").alias("analyses"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 4).alias("mean"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def pending_keys(spark, sf_dir):
    """JOIN-11, JOIN-12, SET-04, FLT-03."""
    return fx.read(spark, sf_dir, "orders").select("o_orderkey").join(fx.read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def shared_keys(spark, sf_dir):
    """SET-01, SET-03, JOIN-13."""
    li = fx.read(spark, sf_dir, "lineitem")
    return li.filter("l_returnflag = 'A'").select("l_suppkey").intersect(li.filter("l_returnflag = 'R'").select("l_suppkey"))


@query("""WITH a AS (SELECT l_orderkey AS call_id, l_partkey AS claim_id FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), b AS (SELECT l_orderkey AS call_id, l_partkey AS claim_id FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY 1, 2)
    SELECT coalesce(a.call_id, b.call_id) AS call_id, count(*) FILTER (WHERE b.call_id IS NULL) AS missing, count(*) FILTER (WHERE a.call_id IS NULL) AS unknown FROM a FULL JOIN b ON a.call_id = b.call_id AND a.claim_id = b.claim_id WHERE a.call_id IS NULL OR b.call_id IS NULL GROUP BY 1""")
def verdict_audit(spark, sf_dir):
    """VAL-07, VAL-11."""
    k = lambda q: fx.read(spark, sf_dir, "lineitem").filter(q).select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("claim_id")).distinct()
    return validators.verdicts_ok(k("l_linenumber <= 4"), k("l_linenumber between 2 and 5"))


@query("""SELECT doc_id, n_chars = length(text) AS length_ok, trim(text) <> '' AS not_blank, NOT (doc_id % 10 / 10.0 < 0.7 AND doc_id % 2 = 0) AS review_ok, doc_id % 10 / 10.0 BETWEEN 0 AND 1 AS range_ok FROM documents""")
def row_expectations(spark, sf_dir):
    """VAL-01, VAL-02, VAL-04, VAL-05."""
    c = F.pmod("doc_id", F.lit(10)) / 10.0
    d = fx.read(spark, sf_dir, "documents")
    return d.select("doc_id", validators.offsets_ok(F.lit(0), F.greatest(F.col("n_chars"), F.lit(1)), F.col("text")).alias("length_ok"), validators.not_blank(F.col("text")).alias("not_blank"), validators.review_flag_ok(c, F.pmod("doc_id", F.lit(2)) == 1, 0.7).alias("review_ok"), c.between(0, 1).alias("range_ok"))
