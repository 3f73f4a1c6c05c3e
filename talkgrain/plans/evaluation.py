"""Registered queries that evaluate predictions against references, audit quotes, and read back what they write. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators import analytics, metrics, rules, timelines, validators
from talkgrain.plans import fixtures as fx
from talkgrain.plans.records import CRITERION_SQL, _criterion, _pick
from talkgrain.plans.registry import LANGUAGE, query
from talkgrain.sources import files, tables

WORDS_SQL = r"list_distinct(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)))"


@query(f"""WITH {fx.CLAIMS_SQL}, i AS (SELECT call_id, pos, {WORDS_SQL.format("p_name")} AS r, CASE WHEN l_quantity <= 40 THEN {WORDS_SQL.format("CASE WHEN l_linenumber % 2 = 0 THEN 'new ' || p_name ELSE p_name END")} END AS p FROM c JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'),
    b AS (SELECT a.call_id, a.pos, max(len(list_intersect(a.r, x.p)) / len(list_distinct(list_concat(a.r, x.p)))) AS best FROM i a JOIN i x ON a.call_id = x.call_id AND x.p IS NOT NULL GROUP BY 1, 2), m AS (SELECT call_id, avg(best) AS best FROM b GROUP BY 1),
    k AS (SELECT call_id, {LANGUAGE.format("call_id")} AS language, call_id % 5 AS batch, count(*) FILTER (WHERE l_returnflag = 'A') AS nr, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity <= 40) AS np, count(*) FILTER (WHERE l_returnflag = 'N') > 0 AS fr, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity <= 40) > 0 AS fp,
        list(l_discount * 10 ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS sr, list(l_tax * 10 ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS sp FROM c GROUP BY 1),
    d AS (SELECT *, CASE WHEN coalesce(len(sr), 0) < 2 THEN 'unknown' WHEN abs(sr[-1] - sr[1]) < 0.1 THEN 'flat' WHEN sr[-1] > sr[1] THEN 'up' ELSE 'down' END AS dr, CASE WHEN coalesce(len(sp), 0) < 2 THEN 'unknown' WHEN abs(sp[-1] - sp[1]) < 0.1 THEN 'flat' WHEN sp[-1] > sp[1] THEN 'up' ELSE 'down' END AS dp FROM k),
    s AS (SELECT d.*, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 OR nr = 0 THEN 0.0 ELSE 0.5 * (1 - abs(np - nr) / greatest(np, nr)) + 0.5 * best END AS agreement FROM d LEFT JOIN m USING (call_id))
    SELECT batch, language, count(*) FILTER (WHERE call_id % 13 <> 0) AS calls, count(*) FILTER (WHERE call_id % 13 = 0) AS failures, round(avg(agreement) FILTER (WHERE call_id % 13 <> 0), 6) AS commitments,
    round(avg(((call_id % 11 <> 0)::INT + agreement + (fr = fp)::INT + (dr = dp)::INT) / 4) FILTER (WHERE call_id % 13 <> 0), 6) AS accuracy FROM s GROUP BY 1, 2""")
def evaluated_batches(spark, sf_dir):
    """AGG-01, AGG-02, AGG-33, JOIN-20, EVL-01, EXT-06: per batch and category, over calls that did not fail, the mean of four parts, with commitments matched by their words."""
    c = fx.claims(spark, sf_dir)
    part = fx.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = c.filter("l_returnflag = 'A'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    reference = items.select("call_id", T.tokens(F.col("p_name")).alias("words"))
    predicted = items.filter("l_quantity <= 40").select("call_id", T.tokens(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name"))).alias("words"))
    a, n, kept = F.col("l_returnflag") == "A", F.col("l_returnflag") == "N", F.col("l_quantity") <= 40
    points = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("pos", (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("p")))))
    k = c.groupBy("call_id").agg(F.count_if(a).alias("nr"), F.count_if(a & kept).alias("np"), (F.count_if(n) > 0).alias("fr"), (F.count_if(n & kept) > 0).alias("fp"), points.alias("points"))
    k = k.join(analytics.best_matches(predicted, reference), "call_id", "left")
    way = lambda side: analytics.sentiment_direction(F.get("points", 0)[side], F.get("points", F.size("points") - 1)[side], F.size("points"))
    k = k.select("call_id", fx.category("call_id").alias("language"), (F.col("call_id") % 5).alias("batch"), analytics.commitment_agreement(F.col("np"), F.col("nr"), F.col("best")).alias("agreement"), (F.col("fr") == F.col("fp")).cast("double").alias("flags"), (way("r") == way("p")).cast("double").alias("direction"))
    ok = F.col("call_id") % 13 != 0
    parts = ((F.col("call_id") % 11 != 0).cast("double") + F.col("agreement") + F.col("flags") + F.col("direction")) / 4
    return k.groupBy("batch", "language").agg(F.count_if(ok).alias("calls"), F.count_if(~ok).alias("failures"), F.round(F.avg(F.when(ok, F.col("agreement"))), 6).alias("commitments"), F.round(F.avg(F.when(ok, parts)), 6).alias("accuracy"))


@query(f"""WITH {fx.CLAIMS_SQL}, k AS (SELECT call_id, count(*) FILTER (WHERE l_returnflag = 'A') AS n, list((l_linenumber % 2 = 0) <> ((l_linenumber % 2 = 0) <> (l_partkey % 7 = 0)) ORDER BY pos) FILTER (WHERE l_returnflag = 'A') AS due,
        coalesce(list_sort(list(DISTINCT l_partkey % 5) FILTER (WHERE l_returnflag = 'N')), []) AS fr, coalesce(list_sort(list(DISTINCT l_partkey % 5) FILTER (WHERE l_returnflag = 'N' AND l_suppkey % 5 <> 0)), []) AS fp FROM c GROUP BY 1),
    s AS (SELECT call_id, {CRITERION_SQL} AS k, arg_min(l_discount * 10 - l_tax * 10, pos) AS d FROM c WHERE l_returnflag = 'R' GROUP BY 1, 2), f AS (SELECT call_id, arg_min(k, list_position({list(validators.RUBRIC)!r}, k)) AS k FROM s WHERE abs(d) > 0.25 AND list_contains({list(validators.RUBRIC)!r}, k) GROUP BY 1)
    SELECT call_id, CASE WHEN call_id % 6 = 0 THEN 'commitments' WHEN coalesce(list_position(due, true), 0) > 0 THEN 'commitments[' || (list_position(due, true) - 1) || '].deadline' WHEN fr <> fp THEN 'compliance_flags' WHEN k IS NOT NULL THEN 'rubric_scores[' || k || ']' END AS difference FROM k LEFT JOIN f USING (call_id)""")
def quality_differences(spark, sf_dir):
    """DIF-01, JOIN-21, SET-06, MTH-03: the first difference in fixed order: number of commitments, deadlines by index, sets of flags, the seven scores."""
    c = fx.claims(spark, sf_dir)
    due = (F.col("l_linenumber") % 2 == 0) != ((F.col("l_linenumber") % 2 == 0) != (F.col("l_partkey") % 7 == 0))
    flag = F.col("l_partkey") % 5
    n, r = F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"
    ordered = lambda x: F.array_sort(F.collect_list(x))
    k = c.groupBy("call_id").agg(
        ordered(F.when(F.col("l_returnflag") == "A", F.struct("pos", due.alias("x")))).alias("due"), F.array_sort(F.collect_set(F.when(n, flag))).alias("fr"), F.array_sort(F.collect_set(F.when(n & (F.col("l_suppkey") % 5 != 0), flag))).alias("fp"),
        ordered(F.when(r, F.struct("pos", _criterion().alias("k"), (F.col("l_discount") * 10 - F.col("l_tax") * 10).alias("d")))).alias("s"),
    )
    deltas = F.transform(F.array(*map(F.lit, validators.RUBRIC)), lambda name: F.coalesce(F.get(F.filter("s", lambda x: x["k"] == name), 0)["d"], F.lit(0.0)))
    return k.select("call_id", validators.first_difference(F.col("call_id") % 6 == 0, F.transform("due", lambda x: x["x"]), F.col("fr") != F.col("fp"), deltas).alias("difference"))


@query("""WITH t AS (SELECT c_custkey AS call_id, c_nationkey, (c_custkey % 12) * 0.01 AS d FROM customer), g AS (SELECT *, unnest(generate_series(0, 44)) AS f FROM t),
    s AS (SELECT *, CASE WHEN f * 0.01::DOUBLE < 0.2::DOUBLE THEN 'a' WHEN f * 0.01::DOUBLE >= 0.25::DOUBLE AND f * 0.01::DOUBLE < 0.45::DOUBLE THEN 'b' END AS r, CASE WHEN f * 0.01::DOUBLE < 0.2::DOUBLE + d::DOUBLE THEN 'a' WHEN f * 0.01::DOUBLE < 0.45::DOUBLE THEN 'b' END AS h FROM g),
    p AS (SELECT call_id, c_nationkey, avg((r = h)::INT) AS a FROM s WHERE r IS NOT NULL GROUP BY 1, 2) SELECT c_nationkey AS language, round(avg(a), 6) AS accuracy, count(*) AS calls FROM p GROUP BY 1""")
def speaker_attribution(spark, sf_dir):
    """AGG-10, JOIN-16: over 10 ms frames in which the reference speaks, the share that the other timeline gives to the same speaker."""
    t = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.col("c_nationkey").alias("language"), ((F.col("c_custkey") % 12) * F.lit(0.01)).alias("d"))
    span = lambda pos, name, a, b: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), a.cast("double").alias("start_sec"), b.cast("double").alias("end_sec"))
    reference = t.select("call_id", F.inline(F.array(span(0, "a", F.lit(0.0), F.lit(0.2)), span(1, "b", F.lit(0.25), F.lit(0.45)))))
    other = t.select("call_id", F.inline(F.array(span(0, "a", F.lit(0.0), F.lit(0.2) + F.col("d")), span(1, "b", F.lit(0.0), F.lit(0.45)))))
    grid = timelines.frames(t.select("call_id", F.lit(0.451).alias("end_sec"))).select("call_id", "at")
    named = lambda spans, name: timelines.covering(grid, spans).select("call_id", "at", F.when(F.col("span_pos") == 0, "a").when(F.col("span_pos") == 1, "b").alias(name))
    both = named(reference, "reference").join(named(other, "hypothesis"), ["call_id", "at"]).join(t.select("call_id", "language").hint("merge"), "call_id")
    return metrics.speaker_accuracy(both)


@query(r"""WITH d AS (SELECT lang, ['commitment', 'flag', 'sentiment'][(doc_id % 3 + 1)::INT] AS kind, doc_id, text AS raw, regexp_replace(text, '[0-9]{16}', '[CARD]', 'g') AS t FROM documents WHERE text IS NOT NULL),
    q AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'no such words' ELSE substr(raw, 6, 20) END AS quote, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE 5 END AS start FROM d)
    SELECT lang, kind, count(*) AS quotes, count(*) FILTER (WHERE NOT contains(t, quote)) AS absent, count(*) FILTER (WHERE NOT contains(raw, quote)) AS absent_before, count(*) FILTER (WHERE substr(t, start + 1, length(quote)) <> quote) AS drifted, count(*) FILTER (WHERE regexp_matches(quote, '[0-9]{7}')) AS residual,
    sum(CASE WHEN contains(t, quote) THEN strpos(t, quote) - 1 ELSE start END)::BIGINT AS new_starts, sum(CASE WHEN contains(t, quote) THEN strpos(t, quote) - 1 ELSE start END + length(quote))::BIGINT AS new_ends FROM q GROUP BY 1, 2""")
def quote_audit(spark, sf_dir):
    """JSN-07, JSN-08, AGG-27, AGG-06: stored quotes against the raw and the redacted text: absent, drifted, with numbers left; and where they are anchored anew."""
    raw = F.col("text")
    d = fx.read(spark, sf_dir, "documents").filter("text is not null").select("lang", _pick(("commitment", "flag", "sentiment"), F.col("doc_id") % 3).alias("kind"), "doc_id", raw.alias("raw"), F.regexp_replace(raw, "[0-9]{16}", "[CARD]").alias("transcript"))
    q = d.withColumn("quote", F.when(F.col("doc_id") % 7 == 0, "no such words").otherwise(F.substring("raw", 6, 20))).withColumn("start", F.when(F.col("doc_id") % 4 == 0, 7).otherwise(5)).withColumn("id", F.struct("lang", "kind", "raw", "quote"))
    s = analytics.stored_quotes(q)
    return s.groupBy("id.lang", "id.kind").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if("absent").alias("absent"), F.count_if(~F.contains("id.raw", "id.quote")).alias("absent_before"), F.count_if("drifted").alias("drifted"),
        F.count_if(F.col("id.quote").rlike("[0-9]{7}")).alias("residual"), F.sum("new_start").alias("new_starts"), F.sum("new_end").alias("new_ends"),
    )


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(text, 20) WHEN 1 THEN 'مرحبا كيف الحال [NAME]' WHEN 2 THEN 'مرحبا ok' ELSE 'مرحبا hello there friends' END AS t FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' ELSE 'mixed' END AS script, CASE WHEN len(regexp_extract_all(t, '[\x{0600}-\x{06FF}]')) > len(regexp_extract_all(t, '[A-Za-z]')) THEN 'rtl' ELSE 'ltr' END AS direction FROM d""")
def turn_scripts(spark, sf_dir):
    """TXT-07, TXT-08: script and direction of Latin, Arabic and mixed texts; a placeholder is of no script."""
    i = F.col("doc_id") % 4
    t = F.when(i == 0, F.left("text", F.lit(20))).when(i == 1, "مرحبا كيف الحال [NAME]").when(i == 2, "مرحبا ok").otherwise("مرحبا hello there friends")
    return fx.read(spark, sf_dir, "documents").select("doc_id", T.script_class(F.coalesce(t, F.lit(""))).alias("script"), T.direction(F.coalesce(t, F.lit(""))).alias("direction"))


@query("""SELECT doc_id, w AS what, 'transliterated' AS kind FROM (SELECT doc_id, unnest(['kif', 'ba''dar,', 'l''order']) AS w FROM documents WHERE doc_id % 3 <> 1) WHERE w <> 'kif'""")
def transliterations(spark, sf_dir):
    """TXT-09: the apostrophe rule: contractions and English calls are left alone."""
    d = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), fx.category("doc_id").alias("language"), F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "'", ""), F.lit(" kif ba'dar, Don't l'order it's بa'b")).alias("text"))
    return analytics.transliterated(d).withColumnRenamed("call_id", "doc_id")


@query("""SELECT l_suppkey % 50 AS cluster, count(*) AS members, sum(l_linenumber)::BIGINT AS success_count, sum(l_partkey % 7)::BIGINT AS failure_count, count(DISTINCT l_orderkey % 9) AS sources FROM lineitem GROUP BY 1""")
def merged_clusters(spark, sf_dir):
    """CLU-03: counters summed, sources in order without repeats."""
    li = fx.read(spark, sf_dir, "lineitem").withColumn("rule_id", F.monotonically_increasing_id())
    r = li.select("rule_id", F.col("rule_id").alias("pos"), F.array(F.col("l_orderkey") % 9).alias("sources"), F.col("l_linenumber").alias("success_count"), (F.col("l_partkey") % 7).alias("failure_count"), (F.col("l_suppkey") % 50).alias("cluster"))
    return rules.merged(r.drop("cluster"), r.select("rule_id", "cluster")).withColumn("sources", F.size("sources").cast("long"))


# --- files: written below the shared folder, read back --------------------------------------------------------------------


@query("""SELECT 'call_' || lpad(n_nationkey::VARCHAR, 4, '0') || '_' || ['ar', 'en', 'mixed'][n_nationkey % 3 + 1] AS call_id, ['ar', 'en', 'mixed'][n_nationkey % 3 + 1] AS language, length(n_name) + 8 AS letters FROM nation""")
def transcript_files(spark, sf_dir):
    """SRC-01, SRC-02, SRC-04, SNK-07: a file per call, named by id and language; others in the folder are not transcripts."""
    folder = files.shared_folder(spark, "transcripts")
    for r in fx.read(spark, sf_dir, "nation").collect():  # 25 rows by definition
        files.put(spark, f"{folder}/call_{r.n_nationkey:04d}_{fx.LANGUAGES[r.n_nationkey % 3]}.txt", f"Agent: {r.n_name}\n")
    files.put(spark, f"{folder}/notes.txt", "not a call")
    t = tables.transcripts(spark, folder)
    named = tables.call_name(F.concat("call_id", F.lit(".txt")))
    return t.select(named["call_id"].alias("call_id"), named["language"].alias("language"), F.length("text").cast("long").alias("letters"))


@query("""SELECT CASE WHEN event_type = 'error' THEN 'segment' ELSE 'record' END AS kind, user_id % 3 AS arm, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def journal(spark, sf_dir):
    """SRC-06, SNK-01, SNK-02, SNK-08: items appended as JSON lines with sorted keys; torn and blank lines are skipped when they are read; counts per arm."""
    path = files.shared_folder(spark, "journal")
    e = fx.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("arm"), "value", F.when(F.col("event_type") == "error", "segment").otherwise("record").alias("type"))
    tables.write_jsonl(e.filter("type = 'record'").drop("type"), path)  # a record is what has no type
    tables.write_jsonl(e.filter("type = 'segment'"), path)
    files.put(spark, f"{path}/torn.txt", '{"event_id": 1, "arm": 0, "val\n\n   \n')
    record, segment = tables.log(spark, path, "event_id long, arm long, value double", "event_id long, arm long, value double")
    both = record.withColumn("kind", F.lit("record")).unionByName(segment.withColumn("kind", F.lit("segment")))
    return both.groupBy("kind", "arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) SELECT user_id AS call_id, event_id AS line FROM l WHERE user_id % 3 <> 0""")
def resume_log(spark, sf_dir):
    """SRC-08: the last entry of each call, if its file is still there."""
    path = files.shared_folder(spark, "resume")
    e = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("line"), F.concat(F.lit("audio/"), F.col("user_id").cast("string")).alias("path"))
    tables.write_jsonl(e, path)
    there = e.filter("call_id % 3 <> 0").select("path").distinct()
    return tables.completed(spark.read.schema("call_id long, line long, path string").json(path), there).select("call_id", "line")


@query("""SELECT n_nationkey::BIGINT AS call_id, n_name AS summary, NOT n_nationkey % 4 = 0 AS has_evidence FROM nation""")
def label_documents(spark, sf_dir):
    """SRC-05, SNK-09, SNK-06: a document per call with its provenance, which readers pass over; each is validated."""
    folder = files.shared_folder(spark, "labels")
    n = fx.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("call_id"), F.col("n_name").alias("summary"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise("said").alias("evidence"))
    made = tables.with_provenance(n, "rules", "none", F.lit("2024-01-01T00:00:00Z"))
    for r in made.select("call_id", F.to_json(F.struct(*made.columns)).alias("doc")).collect():  # 25 rows by definition
        files.put(spark, f"{folder}/call_{r.call_id:04d}.json", r.doc)
    d = tables.documents(spark, folder, "call_id long, summary string, evidence string")
    return d.select("call_id", "summary", validators.not_blank(F.col("evidence")).alias("has_evidence"))


@query("""SELECT o_orderkey AS step, o_totalprice AS train_loss, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 2 END AS eval_loss FROM orders""")
def training_curve(spark, sf_dir):
    """SRC-16: a log with blanks for what was not measured."""
    path = files.shared_folder(spark, "curve")
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("step"), F.lit(1.0).alias("epoch"), F.col("o_totalprice").alias("train_loss"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") / 2).alias("eval_loss"))
    o.write.csv(path, header=True)
    return tables.training_log(spark, path).select(F.col("step").cast("long").alias("step"), "train_loss", "eval_loss")


@query("""SELECT 'arm' || n_regionkey AS arm, count(*) AS records, count(*) FILTER (WHERE n_nationkey % 6 <> 0) AS valid, round(sum(n_nationkey + 1.5), 4) AS seconds FROM nation GROUP BY 1""")
def assembled_results(spark, sf_dir):
    """SRC-09, SRC-10, SNK-08, EVL-03: a document of records, segments and meta, and its views per arm; a missing one is told."""
    path = files.shared_folder(spark, "results") + "/results.json"
    assert not files.exists(spark, path)
    n = fx.read(spark, sf_dir, "nation").select(F.concat(F.lit("arm"), F.col("n_regionkey").cast("string")).alias("arm"), F.when(F.col("n_nationkey") % 6 == 0, "failed").otherwise("ok").alias("outcome"), (F.col("n_nationkey") + 1.5).alias("seconds"))
    doc = n.agg(F.to_json(F.struct(F.collect_list(F.struct("arm", "outcome")).alias("records"), F.collect_list(F.struct("arm", "seconds")).alias("segments"), F.struct(F.lit(7).alias("seed")).alias("meta"))).alias("doc"))  # 25 rows by definition
    files.put(spark, path, doc.first().doc)
    records, segments = tables.assembled(spark, path, "arm string, outcome string", "arm string, seconds double")
    r = records.groupBy("arm").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("outcome") == "ok").alias("valid"))
    return r.join(segments.groupBy("arm").agg(F.round(F.sum("seconds"), 4).alias("seconds")), "arm")


@query("""SELECT o_orderkey AS call_id, o_orderkey % 4 AS batch FROM orders""")
def run_checkpoint(spark, sf_dir):
    """SNK-04: a run goes on from its checkpoint; that of another number of batches is refused."""
    path = files.shared_folder(spark, "run")
    done = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_orderkey") % 4).alias("batch"))
    tables.save_checkpoint(done, path, 4)
    return tables.load_checkpoint(spark, path, 4)


