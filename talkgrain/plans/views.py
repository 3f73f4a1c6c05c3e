"""More registered queries: arms, recognisers, dashboards, rules, reviews, audits. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import redact as R
from talkgrain.functions import text as T
from talkgrain.operators import analytics, lifecycle, rules, timelines, validators
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import GROUPED_SQL, LANGUAGE, VERDICT_SQL, _checkpoints, _grouped_vectors, _verdicts, query

EVENT_LANGUAGE = LANGUAGE.format("event_id")


@query("""WITH c AS (SELECT user_id % 4 AS arm, value * 40 AS latency, length(props) AS tokens, CASE WHEN user_id % 4 = 1 THEN 1 ELSE 8 END AS concurrency FROM events),
    o AS (SELECT *, CASE WHEN concurrency = 1 AND latency > 3600 THEN NULL ELSE latency END AS own FROM c),
    a AS (SELECT arm, count(own) AS calls, sum(own) AS busy, sum(tokens) FILTER (WHERE own IS NOT NULL) AS tokens, max(concurrency) AS k FROM o GROUP BY 1), s AS (SELECT user_id % 4 AS arm, sum(value * 90) AS wall FROM events GROUP BY 1),
    u AS (SELECT *, CASE WHEN k = 1 AND wall > 1.25 * busy THEN busy ELSE wall END AS seconds FROM a JOIN s USING (arm))
    SELECT arm, calls, round(calls / seconds * 60, 6) AS calls_per_minute, round(tokens / seconds, 6) AS tokens_per_second FROM u""")
def arm_throughput(spark, sf_dir):
    """AGG-18, AGG-19, FLT-07."""
    e = fx.read(spark, sf_dir, "events").withColumn("arm", F.pmod("user_id", F.lit(4)))
    calls = e.select("arm", (F.col("value") * 40).alias("latency"), F.length("props").alias("tokens"), F.when(F.col("arm") == 1, 1).otherwise(8).alias("concurrency"))
    return analytics.throughput(calls, e.select("arm", (F.col("value") * 90).alias("seconds")))


@query("SELECT event_id, round((length(props) * 0.3 + value * 2.5) / 1000, 6) AS token_cost, round(1.5 / 3600 * value * length(props) * 1000, 6) AS hourly_cost FROM events")
def call_costs(spark, sf_dir):
    """AGG-20."""
    n, v = F.length("props"), F.col("value")
    return fx.read(spark, sf_dir, "events").select("event_id", F.round(analytics.token_cost(n, v, 0.3, 2.5), 6).alias("token_cost"), F.round(analytics.hourly_cost(1.5, v, n), 6).alias("hourly_cost"))


@query(f"""WITH r AS (SELECT {EVENT_LANGUAGE} AS language, value AS audio_s, CASE WHEN event_id % 11 <> 0 THEN value * (1 + event_id % 3) END AS total_s, CASE WHEN event_type <> 'view' THEN value * 0.5 END AS stage_s FROM events)
    SELECT language, count(*) AS n, round(avg(total_s), 6) AS mean_s, round(median(total_s), 6) AS median_s, round(max(total_s), 6) AS max_s, round(sum(total_s) / sum(audio_s) FILTER (WHERE total_s IS NOT NULL), 6) AS rtf, round(sum(audio_s) FILTER (WHERE total_s IS NOT NULL) / sum(total_s), 6) AS speed, round(sum(stage_s) / sum(audio_s) FILTER (WHERE stage_s IS NOT NULL), 6) AS stage_rtf FROM r GROUP BY 1""")
def recogniser_latency(spark, sf_dir):
    """AGG-22, AGG-23."""
    v = F.col("value")
    return analytics.recogniser(fx.read(spark, sf_dir, "events").select(fx.category("event_id").alias("language"), v.alias("audio_s"), F.when(F.col("event_id") % 11 != 0, v * (F.pmod("event_id", F.lit(3)) + 1)).alias("total_s"), F.when(F.col("event_type") != "view", v * 0.5).alias("stage_s")))


@query(f"SELECT {LANGUAGE.format('doc_id')} AS language, lang AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def detected_languages(spark, sf_dir):
    """AGG-25."""
    return fx.read(spark, sf_dir, "documents").groupBy(fx.category("doc_id").alias("language"), F.col("lang").alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VERDICT_SQL}, l AS (SELECT unnest(['ar', 'en', 'mixed']) AS language),
    p AS (SELECT {LANGUAGE.format("o_orderkey")} AS language, count(*) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    g AS (SELECT language, count(*) AS claims, count(*) FILTER (WHERE verdict = 'confirm') AS confirmed FROM v GROUP BY 1),
    r AS (SELECT {LANGUAGE.format("l_partkey")} AS language, count(DISTINCT l_orderkey) AS active_rules FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1),
    c AS (SELECT {EVENT_LANGUAGE} AS language, count(*) AS open_conflicts FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT language, coalesce(pending, 0) AS pending, coalesce(claims, 0) AS claims, round(confirmed / claims, 6) AS agreement, coalesce(active_rules, 0) AS active_rules, coalesce(open_conflicts, 0) AS open_conflicts
    FROM l LEFT JOIN p USING (language) LEFT JOIN g USING (language) LEFT JOIN r USING (language) LEFT JOIN c USING (language)""")
def dashboard_stats(spark, sf_dir):
    """AGG-13, AGG-12, AGG-14, JOIN-04."""
    languages = spark.createDataFrame([(x,) for x in fx.LANGUAGES], "language string")
    pending = fx.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(fx.category("o_orderkey").alias("language"))
    active = fx.read(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("rule_id")).agg(F.collect_set(fx.category("l_partkey")).alias("languages"))
    conflicts = fx.read(spark, sf_dir, "events").filter("event_type = 'error'").select(fx.category("event_id").alias("language"))
    return analytics.dashboard(languages, pending, _verdicts(spark, sf_dir), active, conflicts)


@query(f"""WITH r AS (SELECT l_orderkey AS rule_id, l_partkey AS source_id FROM lineitem), s AS (SELECT p_partkey AS source_id, {LANGUAGE.format("p_partkey")} AS language FROM part WHERE p_partkey % 4 <> 0)
    SELECT rule_id, coalesce(string_agg(DISTINCT language, '+' ORDER BY language), '') AS languages FROM r LEFT JOIN s USING (source_id) GROUP BY 1""")
def rule_language_sets(spark, sf_dir):
    """JOIN-09, JOIN-10, AGG-29."""
    made = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rule_id")).agg(F.collect_list("l_partkey").alias("source_ids"))
    sources = fx.read(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("source_id"), fx.category("p_partkey").alias("language"))
    order = spark.createDataFrame(list(enumerate(fx.LANGUAGES)), "ord int, language string")
    return analytics.rule_languages(made, sources, order).select("rule_id", F.array_join("languages", "+").alias("languages"))


@query("""SELECT l_orderkey AS id, r - 1 AS pos, l_partkey AS rule_id, p_name AS text, coalesce(NOT p_partkey % 7 = 0, false) AS active FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = l_partkey""")
def conflict_view(spark, sf_dir):
    """JOIN-06, PRJ-09, PRJ-12."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    conflicts = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(items.alias("conflicting"))
    known = fx.read(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").selectExpr("p_partkey as rule_id", "p_name as text", "p_partkey % 7 = 0 as retired")
    return analytics.conflict_view(conflicts, known).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT o_orderkey AS call_id, o_orderdate AS finished_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def review_queue(spark, sf_dir):
    """TOP-03, ORD-01, FLT-01: the limit is the feature."""
    o = fx.read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("call_id"), F.lit(None).cast("timestamp").alias("queued_at"), F.col("o_orderdate").alias("finished_at"))
    return analytics.queue(o).select("call_id", "finished_at")


@query("""WITH l AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM l QUALIFY rank <= 3""")
def recent_uploads(spark, sf_dir):
    """TOP-04."""
    return analytics.recent(fx.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3).withColumn("rank", F.col("rank").cast("long"))


@query()
def single_linkage(spark, sf_dir):
    """CLU-02 on the links of all orders: recursive SQL is too slow on them; it is tested against brute force."""
    _checkpoints(spark)
    p = fx.read(spark, sf_dir, "orders").selectExpr("o_orderkey as a", "o_custkey % 400 as b")
    nodes = p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    return analytics.linked(p, nodes)


@query(f"""WITH {GROUPED_SQL} SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.7""")
def similar_rules(spark, sf_dir):
    """JOIN-19 over all vectors, leaning towards the first of their eight."""
    v = _grouped_vectors(spark, sf_dir).select(F.col("vec_id").alias("rule_id"), "vec")
    return rules.similar_pairs(v).select("a", "b")


@query("""WITH c AS (SELECT l_orderkey AS call_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS p, list(l_discount ORDER BY l_linenumber, l_discount) AS d FROM lineitem GROUP BY 1)
    SELECT call_id, CASE WHEN n <> 4 AND n < 3 THEN 'commitments' WHEN p > 2 THEN 'compliance_flags' WHEN d[1] * 10 > 0.25 AND len(d) >= 1 THEN 'rubric_scores[professionalism]' WHEN len(d) >= 2 AND d[2] * 10 > 0.25 THEN 'rubric_scores[empathy]' END AS difference FROM c""")
def first_differences(spark, sf_dir):
    """DIF-01, CAP-01, MTH-03, JOIN-21."""
    d = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda x: x["l_discount"] * 10)
    c = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("p"), d.alias("d"))
    return c.select("call_id", validators.first_difference((F.col("n") != 4) & (F.col("n") < 3), F.array(F.lit(False)), F.col("p") > 2, F.slice("d", 1, 2)).alias("difference"))


@query(f"""WITH c AS (SELECT o_orderkey, {LANGUAGE.format("o_orderkey")} AS language, count(l_orderkey) FILTER (WHERE l_linenumber <= 3) AS np, count(l_orderkey) FILTER (WHERE l_linenumber >= 2) AS nr, (list(l_discount ORDER BY l_linenumber, l_discount))[1] AS a, (list(l_discount ORDER BY l_linenumber, l_discount))[-1] AS b, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 OR nr = 0 THEN 0.0 ELSE 0.5 * (1 - abs(np - nr) / greatest(np, nr)) + 0.5 * 0.5 END AS k, CASE WHEN n < 2 THEN 'unknown' WHEN abs(b * 10 - a * 10) < 0.1 THEN 'flat' WHEN b > a THEN 'up' ELSE 'down' END AS d FROM c)
    SELECT language, round(avg((1 + k + (np = nr)::INT + (d = 'up')::INT) / 4), 6) AS accuracy, count(*) AS calls FROM s GROUP BY 1""")
def accuracy_by_category(spark, sf_dir):
    """AGG-01, AGG-02, WIN-04, AGG-33."""
    li, o = fx.read(spark, sf_dir, "lineitem"), fx.read(spark, sf_dir, "orders").select("o_orderkey")
    c = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count_if(F.col("l_linenumber") <= 3).alias("np"), F.count_if(F.col("l_linenumber") >= 2).alias("nr"), F.min(F.struct("l_linenumber", "l_discount"))["l_discount"].alias("a"), F.max(F.struct("l_linenumber", "l_discount"))["l_discount"].alias("b"), F.count("l_orderkey").alias("n"))
    up = analytics.sentiment_direction(F.col("a") * 10, F.col("b") * 10, F.col("n")) == "up"
    parts = c.select(fx.category("o_orderkey").alias("language"), F.lit(1.0).alias("summaries"), analytics.commitment_agreement(F.col("np"), F.col("nr"), F.lit(0.5)).alias("commitments"), (F.col("np") == F.col("nr")).cast("double").alias("flags"), up.cast("double").alias("direction"))
    return analytics.accuracy(parts)


@query("""SELECT doc_id, strpos(text, left(text, 20)) - 1 < 0 AS absent, substr(text, (doc_id % 3 + 1)::BIGINT, length(left(text, 20))) <> left(text, 20) AS drifted, 0 AS new_start, length(left(text, 20)) AS new_end FROM documents WHERE text <> ''""")
def stored_quote_audit(spark, sf_dir):
    """JSN-07, JSN-08, AGG-27."""
    q = fx.read(spark, sf_dir, "documents").filter("text <> ''").select(F.col("doc_id").alias("id"), F.col("text").alias("transcript"), F.left("text", F.lit(20)).alias("quote"), F.pmod("doc_id", F.lit(3)).cast("int").alias("start"))
    return analytics.stored_quotes(q).withColumnRenamed("id", "doc_id").withColumn("new_end", F.col("new_end").cast("long"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'commitments' END AS list, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS index,
    CASE WHEN event_id % 11 = 0 THEN 'daily_quota' WHEN [408, 429, 500, 502, 503, 504, 400, 401][(event_id % 8 + 1)::INT] NOT IN (400, 401) THEN 'transient' WHEN event_id % 5 = 0 THEN 'schema' ELSE 'permanent' END AS class FROM events""")
def claim_ids_and_errors(spark, sf_dir):
    """TXT-12, TXT-20, STR-05."""
    i = F.col("event_id")
    claim = F.when(i % 3 == 0, F.concat(F.lit("commitments["), (i % 7).cast("string"), F.lit("]"))).otherwise("summary")
    status = F.element_at(F.array(*map(F.lit, (408, 429, 500, 502, 503, 504, 400, 401))), (i % 8 + 1).cast("int"))
    message = F.concat(F.when(i % 11 == 0, "PerDay ").otherwise(""), F.when(i % 5 == 0, "ValidationError").otherwise(""))
    p = analytics.claim_parts(claim)
    return fx.read(spark, sf_dir, "events").select("event_id", p["list"].alias("list"), p["index"].cast("long").alias("index"), lifecycle.error_class(status, message).alias("class"))


@query("""WITH c AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1)
    SELECT id, len(CASE WHEN id % 3 = 0 THEN a[2:] ELSE a END) AS n, (CASE id % 3 WHEN 0 THEN a[2:] WHEN 1 THEN list_concat([-1], a[2:]) ELSE a END)[1] AS first FROM c""")
def planned_corrections(spark, sf_dir):
    """RVW-01, ARR-02."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    c = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(a.alias("a"))
    verdict = F.when(F.col("id") % 3 == 0, "reject").when(F.col("id") % 3 == 1, "correct").otherwise("confirm")
    after = analytics.planned(F.col("a"), verdict, F.lit(0), F.lit(-1).cast("long"))
    return c.select("id", F.size(after).cast("long").alias("n"), F.get(after, 0).alias("first"))


@query("""WITH u AS (SELECT l_orderkey AS call_id, l_suppkey AS rule_id, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_orderkey % 3 END AS topic FROM lineitem), t AS (SELECT s_suppkey AS rule_id, s_suppkey % 3 AS topic FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT rule_id, count(*) FILTER (WHERE u.topic IS NULL OR u.topic <> t.topic) AS successes, count(*) FILTER (WHERE u.topic = t.topic) AS failures FROM u JOIN t USING (rule_id) GROUP BY 1""")
def rule_outcomes(spark, sf_dir):
    """AGG-35, FLT-11."""
    u = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("rule_id"), F.when(F.col("l_orderkey") % 4 != 0, F.col("l_orderkey") % 3).alias("topic"))
    t = fx.read(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").selectExpr("s_suppkey as rule_id", "s_suppkey % 3 as topic")
    return analytics.rule_outcomes(u, t)


@query("""SELECT user_id, sum(CASE WHEN event_type <> 'view' THEN event_id END)::BIGINT AS prompt, sum(CASE WHEN event_type = 'purchase' THEN event_id END)::BIGINT AS completion, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'click') AS model FROM events GROUP BY 1""")
def usage_totals(spark, sf_dir):
    """AGG-36."""
    e = fx.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("prompt"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("completion"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("model"))
    return analytics.usage_total(e, "user_id")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS call_id, l_linenumber AS pos, l_linenumber * 100 AS s, l_linenumber * 100 + 80 AS e FROM lineitem), p AS (SELECT DISTINCT o_orderkey AS call_id, 150 + o_custkey % 300 AS s, 190 + o_custkey % 300 AS e FROM orders),
    j AS (SELECT t.*, CASE WHEN p.s < t.e AND p.e > t.s THEN p.s END AS ps, CASE WHEN p.s < t.e AND p.e > t.s THEN p.e END AS pe FROM t JOIN p USING (call_id)) SELECT call_id, pos, 1 + coalesce((ps > s)::INT + (pe < e)::INT, 0) AS pieces FROM j WHERE ps IS NOT NULL""")
def cut_turns(spark, sf_dir):
    """SEG-04, JOIN-22."""
    t = fx.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as call_id", "l_linenumber as pos", "l_linenumber * 100 as start", "l_linenumber * 100 + 80 as end")
    p = fx.read(spark, sf_dir, "orders").selectExpr("o_orderkey as call_id", "'x' as span_id", "150 + o_custkey % 300 as start", "190 + o_custkey % 300 as end")
    t = t.selectExpr("call_id", "pos", "cast(start as bigint) as start", "cast(end as bigint) as end").distinct()
    return timelines.cut_turn(t, p).groupBy("call_id", "pos").agg(F.count(F.lit(1)).cast("int").alias("pieces"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(text, '[0-9]{16}', '[CARD]', 'g') AS t FROM documents) SELECT p AS label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '\[[A-Z_]+\]')) AS p FROM r) GROUP BY 1""")
def placeholder_histogram(spark, sf_dir):
    """PII-03, AGG-26, AGG-38."""
    t = F.regexp_replace("text", "[0-9]{16}", "[CARD]")
    return fx.read(spark, sf_dir, "documents").select(F.explode(R.placeholders(t)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, try_cast(CASE WHEN user_id % 2 = 0 THEN '2024-01-0' || (user_id % 9 + 1) ELSE 'soon' END AS TIMESTAMP) AS deadline, count(*) AS n FROM events GROUP BY 1, 2""")
def parsed_deadlines(spark, sf_dir):
    """DAT-01: junk is null."""
    text = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("user_id") % 9 + 1).cast("string"))).otherwise("soon")
    return fx.read(spark, sf_dir, "events").groupBy("user_id", F.try_to_timestamp(text).cast("timestamp_ntz").alias("deadline")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6""")
def repeated_keys(spark, sf_dir):
    """VAL-06's duplicate audit."""
    return validators.repeated(fx.read(spark, sf_dir, "lineitem"), "l_orderkey").filter("n > 6")


@query(r"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN ' aبc' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' (hello،' ELSE '' END || CASE WHEN doc_id % 20 = 0 THEN ' كده' ELSE '' END AS t FROM documents)
    SELECT doc_id, word AS what, 'mixed' AS kind FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\s+')) AS word FROM d) WHERE trim(word, '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~،؛؟“”‘’') ~ '[\x{0600}-\x{06FF}]' AND trim(word, '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~،؛؟“”‘’') ~ '[A-Za-z]'
    UNION ALL SELECT doc_id, b, 'banned' FROM d, (SELECT unnest(['فندم', 'إزاي', 'خالص', 'معلش', 'عايز', 'فين', 'كده', 'النهاردة']) AS b) WHERE contains(t, b)""")
def dialect_violations(spark, sf_dir):
    """TXT-09, TXT-10: every document is scanned; texts of every tenth get a planted word, those of every twentieth a banned one; an Arabic comma after a Latin word is no violation."""
    d = fx.read(spark, sf_dir, "documents")
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 10 == 0, " aبc").otherwise(""), F.when(F.col("doc_id") % 5 == 0, " (hello،").otherwise(""), F.when(F.col("doc_id") % 20 == 0, " كده").otherwise(""))
    return analytics.violations(d.select(F.col("doc_id").alias("call_id"), t.alias("text"))).withColumnRenamed("call_id", "doc_id")


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))[1] AS least, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS distinct_words FROM documents")
def token_sets(spark, sf_dir):
    """SET-05, SET-06, TXT-06."""
    w = T.tokens(F.col("text"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.array_min("w").alias("least"), F.size("w").cast("long").alias("distinct_words"))
