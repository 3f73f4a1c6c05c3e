"""Registered queries over records of calls, reviews, rules and evaluations. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.operators import datasets, lifecycle, ordered, records, rules, validators
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import LANGUAGE, _vectors, query

CRITERIA = (*validators.RUBRIC, "tone", "greeting")
CRITERION_SQL = f"[{', '.join(repr(x) for x in CRITERIA)}][(l_partkey % 9 + 1)::INT]"
SEVERITY_SQL = "['low', 'medium', 'high', 'critical'][(l_suppkey % 4 + 1)::INT]"


def _pick(names, column):
    return F.element_at(F.array(*map(F.lit, names)), column.cast("int") + 1)


def _criterion():
    return _pick(CRITERIA, F.col("l_partkey") % 9)


@query(f"""WITH {fx.CLAIMS_SQL}, s AS (SELECT call_id, pos, {CRITERION_SQL} AS criterion, l_discount * 10 AS score FROM c),
    f AS (SELECT call_id, criterion, arg_min(score, pos) AS score, count(*) AS n, list_position({list(validators.RUBRIC)!r}, criterion) AS ord FROM s GROUP BY 1, 2)
    SELECT call_id, coalesce(string_agg(criterion || '=' || printf('%.2f', score), ',' ORDER BY ord) FILTER (WHERE ord > 0), '') AS kept, coalesce(sum(n) FILTER (WHERE coalesce(ord, 0) = 0), 0)::BIGINT AS unexpected,
    array_to_string(list_filter({list(validators.RUBRIC)!r}, lambda x: NOT list_contains(list(criterion), x)), ',') AS missing FROM f GROUP BY 1""")
def reconciled_rubric(spark, sf_dir):
    """FLT-05, ORD-03, GRD-02, VAL-09."""
    c = fx.claims(spark, sf_dir).select("call_id", "pos", _criterion().alias("criterion"), (F.col("l_discount") * 10).alias("score"))
    out = records.reconciled(c)
    kept = F.transform("scores", lambda x: F.concat(x["criterion"], F.lit("="), F.format_string("%.2f", x["score"])))
    return out.select("call_id", F.array_join(kept, ",").alias("kept"), "unexpected", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {fx.CLAIMS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id, l_returnflag ORDER BY pos) - 1 AS i FROM c)
    SELECT call_id, CASE l_returnflag WHEN 'A' THEN 'commitments' WHEN 'N' THEN 'compliance_flags' ELSE 'rubric_scores' END || '[' || i || ']' AS claim_id, CASE WHEN l_returnflag <> 'R' THEN 'part ' || l_partkey END AS description,
    CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS promised_by, CASE WHEN l_returnflag = 'N' THEN {SEVERITY_SQL} END AS severity, CASE WHEN l_returnflag = 'R' THEN {CRITERION_SQL} END AS criterion, CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END AS score FROM n""")
def claim_views(spark, sf_dir):
    """PRJ-02: a row per claim of the three lists, with the columns of its kind."""
    c = fx.claims(spark, sf_dir)
    text = F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description")
    of = lambda flag, *columns: c.filter(F.col("l_returnflag") == flag).select("call_id", "pos", *columns)
    lists = {"commitments": of("A", text, F.col("l_suppkey").alias("promised_by")), "compliance_flags": of("N", text, _pick(("low", "medium", "high", "critical"), F.col("l_suppkey") % 4).alias("severity")), "rubric_scores": of("R", _criterion().alias("criterion"), (F.col("l_discount") * 10).alias("score"))}
    return records.claim_views(lists)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'commitment' WHEN 'N' THEN 'compliance_flag' ELSE 'rubric_score' END AS kind,
    coalesce(nullif(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'j' || l_partkey END END, ''), nullif(CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'd' || l_suppkey END, ''), '') AS said FROM lineitem WHERE l_quantity > 40""")
def rejected_claims(spark, sf_dir):
    """PRJ-03."""
    c = fx.read(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    justification = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("j"), F.col("l_partkey").cast("string"))))
    description = F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("d"), F.col("l_suppkey").cast("string")))
    kind = F.when(F.col("l_returnflag") == "A", "commitment").when(F.col("l_returnflag") == "N", "compliance_flag").otherwise("rubric_score")
    return c.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), records.shown_text(justification, description).alias("said"))


@query("""WITH s AS (SELECT l_orderkey AS call_id, count(*) FILTER (WHERE l_quantity > 40) AS rejected, count(*) FILTER (WHERE l_quantity <= 40) AS kept, CASE WHEN l_orderkey % 17 = 0 THEN 'TimeoutError' END AS error FROM lineitem GROUP BY ALL),
    v AS (SELECT *, kept / (kept + rejected) AS coverage FROM s)
    SELECT call_id, CASE WHEN error IS NOT NULL THEN 'Analysis error: ' || error WHEN coverage < 0.7 THEN rejected || ' of ' || (rejected + kept) || ' claims had no verbatim evidence (grounding coverage ' || round_even(coverage * 100, 0)::BIGINT || '%, threshold 70%)' END AS reason,
    CASE WHEN error IS NOT NULL THEN 'analysis_error' WHEN coverage < 0.7 THEN 'low_grounding' END AS kind, CASE WHEN error IS NOT NULL THEN 0 ELSE kept END AS claims, CASE WHEN error IS NOT NULL THEN 0.0 ELSE coverage END AS confidence FROM v""")
def escalations(spark, sf_dir):
    """PRJ-07, PRJ-08: what is stored of a call and why it waits; a failed one has no claims, no confidence and the sentinel summary."""
    li = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.count_if(F.col("l_quantity") > 40).alias("rejected"), F.count_if(F.col("l_quantity") <= 40).alias("kept"))
    error = F.when(F.col("call_id") % 17 == 0, "TimeoutError")
    s = li.withColumn("error", error).withColumn("coverage", F.col("kept") / (F.col("kept") + F.col("rejected")))
    s = s.withColumn("summary", F.when(F.col("error").isNotNull(), records.NO_ANALYSIS).otherwise("a summary"))
    reason = records.escalation(F.col("error"), F.col("coverage") < 0.7, F.col("rejected"), F.col("kept"), F.col("coverage"), 0.7)
    kind = F.when(reason.isNotNull(), F.when(F.col("summary") == records.NO_ANALYSIS, "analysis_error").otherwise("low_grounding"))
    failed = F.col("error").isNotNull()
    return s.select("call_id", reason.alias("reason"), kind.alias("kind"), F.when(failed, 0).otherwise(F.col("kept")).cast("long").alias("claims"), F.when(failed, 0.0).otherwise(F.col("coverage")).alias("confidence"))


PATHS = ("commitments", "commitments[0].deadline", "compliance_flags", "commitments[1]", "compliance_flags[0]", "rubric_scores[empathy].justification", "rubric_scores[call_closure]", "commitments[9].deadline", "somewhere.else")


@query(f"""WITH {fx.CLAIMS_SQL}, p AS (SELECT call_id, {list(PATHS)!r}[(call_id % 9 + 1)::INT] AS path, list('part ' || l_partkey ORDER BY pos) FILTER (WHERE l_returnflag = 'A') AS d, list(l_suppkey ORDER BY pos) FILTER (WHERE l_returnflag = 'A') AS by_,
    list(CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END ORDER BY pos) FILTER (WHERE l_returnflag = 'A') AS due, list('r' || l_partkey % 5 ORDER BY pos) FILTER (WHERE l_returnflag = 'N') AS r, list({SEVERITY_SQL} ORDER BY pos) FILTER (WHERE l_returnflag = 'N') AS sev,
    list('part ' || l_partkey ORDER BY pos) FILTER (WHERE l_returnflag = 'N') AS fd, list({CRITERION_SQL} ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS k, list(printf('%.2f', l_discount * 10) ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS sc, list('j' || l_suppkey ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS j FROM c GROUP BY 1)
    SELECT call_id, path, CASE call_id % 9 WHEN 0 THEN coalesce(len(d), 0) WHEN 1 THEN least(coalesce(len(d), 0), 1) WHEN 2 THEN coalesce(len(r), 0) WHEN 6 THEN coalesce(len(list_filter(k, lambda x: x = 'call_closure')), 0) WHEN 7 THEN (coalesce(len(d), 0) > 9)::INT END::BIGINT AS relevant,
    CASE call_id % 9 WHEN 0 THEN coalesce(len(d), 0) || ' commitment(s)' WHEN 1 THEN 'deadline=' || CASE WHEN coalesce(due[1], '') <> '' THEN 'given' ELSE 'none' END WHEN 2 THEN 'flags=[' || coalesce(array_to_string(r, ', '), 'none') || ']'
    WHEN 3 THEN CASE WHEN coalesce(len(d), 0) < 2 THEN 'commitment absent' ELSE 'description=''' || d[2] || '''; promised_by=' || by_[2] || '; deadline=' || CASE WHEN due[2] = '' THEN 'none' ELSE due[2] END END
    WHEN 4 THEN CASE WHEN coalesce(len(r), 0) < 1 THEN 'flag absent' ELSE 'rule_id=' || r[1] || '; severity=' || sev[1] || '; description=''' || fd[1] || '''' END
    WHEN 5 THEN CASE WHEN coalesce(list_position(k, 'empathy'), 0) = 0 THEN 'empathy=not scored' ELSE 'empathy=' || sc[list_position(k, 'empathy')] || '; justification=''' || j[list_position(k, 'empathy')] || '''' END
    WHEN 6 THEN 'call_closure=' || CASE WHEN coalesce(list_position(k, 'call_closure'), 0) = 0 THEN 'not scored' ELSE sc[list_position(k, 'call_closure')] END WHEN 7 THEN CASE WHEN coalesce(due[10], '') <> '' THEN 'deadline=given' ELSE 'deadline=none' END END AS described FROM p""")
def field_paths(spark, sf_dir):
    """PRJ-04, PRJ-05: the field that an error path names, of nine shapes, two of them out of range or unknown."""
    c = fx.claims(spark, sf_dir)
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    severity = _pick(("low", "medium", "high", "critical"), F.col("l_suppkey") % 4)
    commitment = F.struct("pos", part.alias("description"), F.col("l_suppkey").cast("string").alias("promised_by"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("deadline"))
    flag = F.struct("pos", F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string")).alias("rule_id"), severity.alias("severity"), part.alias("description"))
    rubric = F.struct("pos", _criterion().alias("criterion"), (F.col("l_discount") * 10).alias("score"), F.concat(F.lit("j"), F.col("l_suppkey").cast("string")).alias("justification"))
    lists = {name: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == x, s))).alias(name) for name, x, s in (("commitments", "A", commitment), ("flags", "N", flag), ("rubric", "R", rubric))}
    a = c.groupBy("call_id").agg(*lists.values()).withColumn("path", _pick(PATHS, F.col("call_id") % 9))
    columns = {name: F.col(name) for name in lists}
    return a.select("call_id", "path", records.relevant(columns, F.col("path")).cast("long").alias("relevant"), records.described(columns, F.col("path")).alias("described"))


@query("""WITH o AS (SELECT 'call_' || o_custkey || '_' || ['ar', 'en', 'mixed'][(o_custkey % 3 + 1)::INT] AS call_id, o_orderkey, ['ar', 'en', 'mixed'][(CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE o_custkey END % 3 + 1)::INT] AS language FROM orders)
    SELECT 'duplicate' AS problem, call_id AS subject, count(*)::VARCHAR AS detail FROM o GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'language', o_orderkey::VARCHAR, language FROM o WHERE regexp_extract(call_id, '_(ar|en|mixed)$', 1) <> language
    UNION ALL SELECT 'criterion', o_orderkey::VARCHAR, r.x FROM o, (SELECT unnest(['professionalism', 'empathy']) AS x) r WHERE r.x = 'empathy' AND o_orderkey % 4 = 0""")
def reference_audit(spark, sf_dir):
    """VAL-06, SRC-03: every problem of a reference set at once: repeated calls, languages against the name, missing criteria."""
    from talkgrain.sources.tables import language_suffix

    o = fx.read(spark, sf_dir, "orders").withColumn("_l", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey")).otherwise(F.col("o_custkey")))
    o = o.select(F.concat(F.lit("call_"), F.col("o_custkey").cast("string"), F.lit("_"), fx.category("o_custkey")).alias("call_id"), "o_orderkey", fx.category("_l").alias("language"))
    have = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("professionalism"))).otherwise(F.array(F.lit("professionalism"), F.lit("empathy")))
    row = lambda problem, subject, detail: (F.lit(problem).alias("problem"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    repeated = validators.repeated(o, "call_id").select(*row("duplicate", F.col("call_id"), F.col("n")))
    named = o.filter(language_suffix(F.col("call_id")) != F.col("language")).select(*row("language", F.col("o_orderkey"), F.col("language")))
    lost = o.withColumn("x", F.explode(validators.missing(have, ("professionalism", "empathy")))).select(*row("criterion", F.col("o_orderkey"), F.col("x")))
    return repeated.unionByName(named).unionByName(lost)


@query(f"""WITH {fx.CLAIMS_SQL}, v AS (SELECT call_id, pos, 'k[' || CASE WHEN pos = 3 THEN 2 ELSE pos END || ']' AS claim_id, CASE l_returnflag WHEN 'A' THEN 'commitment' WHEN 'N' THEN 'compliance_flag' ELSE 'rubric_score' END AS kind, ['confirm', 'correct', 'reject'][(l_suppkey % 3 + 1)::INT] AS verdict, l_partkey % 6 AS m FROM c),
    f AS (SELECT *, count(*) OVER (PARTITION BY call_id, claim_id) > 1 AS again FROM v)
    SELECT call_id, pos, array_to_string(list_filter([CASE WHEN again THEN 'repeated' END, CASE WHEN verdict = 'correct' AND m = 0 THEN 'no changes' END, CASE WHEN verdict <> 'correct' AND m > 0 THEN 'changes not allowed' END, CASE WHEN m = 1 THEN 'empty changes' END, CASE WHEN m = 4 THEN 'null field' END,
    CASE WHEN (m = 2 AND kind <> 'commitment') OR (m = 3 AND kind = 'rubric_score') OR (m = 4 AND kind <> 'rubric_score') OR (m = 5 AND kind <> 'compliance_flag') THEN 'not editable' END], lambda x: x IS NOT NULL), ',') AS faults FROM f""")
def verdict_rules(spark, sf_dir):
    """VAL-08, JSN-06: a change that is absent is not a change to null."""
    c = fx.claims(spark, sf_dir)
    m, none = F.col("l_partkey") % 6, F.lit(None).cast("string")
    changes = F.when(m == 1, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))).when(m == 2, F.create_map(F.lit("deadline"), none)).when(m == 3, F.create_map(F.lit("description"), F.lit("x")))
    changes = changes.when(m == 4, F.create_map(F.lit("score"), none)).when(m == 5, F.create_map(F.lit("severity"), F.lit("high"), F.lit("description"), F.lit("y")))
    kind = F.when(F.col("l_returnflag") == "A", "commitment").when(F.col("l_returnflag") == "N", "compliance_flag").otherwise("rubric_score")
    claim = F.concat(F.lit("k["), F.when(F.col("pos") == 3, 2).otherwise(F.col("pos")).cast("string"), F.lit("]"))
    v = c.select("call_id", "pos", claim.alias("claim_id"), kind.alias("kind"), _pick(("confirm", "correct", "reject"), F.col("l_suppkey") % 3).alias("verdict"), changes.alias("changes"))
    return records.verdict_faults(v).select("call_id", "pos", F.array_join("faults", ",").alias("faults"))


@query("""SELECT event_id, (event_type <> 'error') = (user_id % 7 <> 0) AND (event_type <> 'error') = (event_id % 5 <> 0) AS consistent FROM events""")
def conflict_states(spark, sf_dir):
    """VAL-10: resolution, by whom and when are set together or not at all."""
    e = fx.read(spark, sf_dir, "events")
    parts = [F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("user_id") % 7 != 0, F.col("user_id")), F.when(F.col("event_id") % 5 != 0, F.col("ts"))]
    return e.select("event_id", ((parts[0].isNull() == parts[1].isNull()) & (parts[0].isNull() == parts[2].isNull())).alias("consistent"))


@query("""SELECT ['ar', 'en', 'mixed'][(n_nationkey % 3 + 1)::INT] AS language, (n_nationkey * 70)::VARCHAR AS call_id FROM nation WHERE n_nationkey * 70 NOT IN (SELECT c_custkey FROM customer)""")
def corpus_drift(spark, sf_dir):
    """VAL-11, SRC-12: held-out ids, read from a document of lists per language, that the corpus lacks."""
    from talkgrain.sources.tables import held_out

    n = fx.read(spark, sf_dir, "nation").select(fx.category("n_nationkey").alias("language"), (F.col("n_nationkey") * 70).cast("string").alias("call_id"))
    lists = n.groupBy("language").agg(F.collect_list("call_id").alias("ids"))  # 25 nations by definition
    doc = lists.agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct("language", "ids"))), F.create_map(F.lit("_meta"), F.array(F.lit("seed 7"))))).alias("value"))
    corpus = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("call_id"))
    return held_out(doc).join(corpus, "call_id", "left_anti").select("language", "call_id")


@query("""SELECT item_id, '[{"role":"system","content":"Correct the field."},{"role":"user","content":"item ' || item_id || '"},{"role":"assistant","content":"' || length(text) || ' letters"}]' AS messages, '{"call_id":' || item_id || ',"letters":' || length(text) || ',"topic":"t' || item_id % 4 || '"}' AS record FROM benchmark WHERE text IS NOT NULL""")
def chat_records(spark, sf_dir):
    """PRJ-06, JSN-04: a training record with its keys in order, and as a chat."""
    b = fx.read(spark, sf_dir, "benchmark").filter("text is not null")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    chat = F.array(turn("system", F.lit("Correct the field.")), turn("user", F.concat(F.lit("item "), F.col("item_id").cast("string"))), turn("assistant", F.concat(F.length("text").cast("string"), F.lit(" letters"))))
    record = F.to_json(F.struct(F.col("item_id").alias("call_id"), F.length("text").alias("letters"), F.concat(F.lit("t"), (F.col("item_id") % 4).cast("string")).alias("topic")))
    return b.select("item_id", F.to_json(chat).alias("messages"), record.alias("record"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de-DE' ELSE 'ar' END AS decoder FROM documents""")
def decoder_languages(spark, sf_dir):
    """PRJ-13: a configured language, else the default."""
    known = F.create_map(F.lit("en"), F.lit("en"), F.lit("de"), F.lit("de-DE"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(known, F.coalesce("lang", F.lit(""))), F.lit("ar")).alias("decoder"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN ' ' ELSE text END AS text FROM conversations)
    SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS reference_md5, md5(string_agg(trim(text, e' \\n\\r\\t'), ' ' ORDER BY turn) FILTER (WHERE trim(text, e' \\n\\r\\t') <> '')) AS transcript_md5 FROM t GROUP BY 1""")
def call_texts(spark, sf_dir):
    """PRJ-15: the turns of a call as one text; only the second leaves out blank ones."""
    t = fx.read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    stripped = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, "^[ \\n\\r\\t]+|[ \\n\\r\\t]+$", "")), lambda x: x != "")
    return t.groupBy("conv_id").agg(F.md5(F.array_join(parts, " ")).alias("reference_md5"), F.md5(F.array_join(stripped(parts), " ")).alias("transcript_md5"))


@query(f"""WITH p AS (SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 5 END AS topic FROM orders WHERE o_orderkey % 3 <> 0), t AS (SELECT o_orderkey AS call_id, {LANGUAGE.format("o_custkey")} AS language, o_orderkey % 5 AS topic FROM orders)
    SELECT language, count(*) AS compared, count(*) FILTER (WHERE p.topic <> t.topic) AS corrected, count(*) FILTER (WHERE p.topic = t.topic) AS matched, count(*) FILTER (WHERE p.topic IS NULL) AS failed FROM p JOIN t USING (call_id) GROUP BY 1""")
def correction_tally(spark, sf_dir):
    """JOIN-02, AGG-41, CAP-01: predictions against the truth of the same call; calls without a prediction are skipped."""
    o = fx.read(spark, sf_dir, "orders")
    p = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") % 5).alias("p"))
    t = o.select(F.col("o_orderkey").alias("call_id"), fx.category("o_custkey").alias("language"), (F.col("o_orderkey") % 5).alias("t"))
    return p.join(t, "call_id").groupBy("language").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("p") != F.col("t")).alias("corrected"), F.count_if(F.col("p") == F.col("t")).alias("matched"), F.count_if(F.col("p").isNull()).alias("failed"))


@query("""WITH r AS (SELECT event_id % 3 AS arm, event_id // 3 AS call_id, event_type, event_id, CASE WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'ok' END AS outcome, event_id * 7 % 20000 AS tokens FROM events)
    SELECT r.arm, r.call_id, CASE WHEN r.event_type = 'click' THEN 'stop, filtered' WHEN r.tokens >= 16384 THEN 'length (inferred: ' || r.tokens || ' output tokens = max_tokens; not recorded)' ELSE 'not recorded' END AS finish_reason,
    CASE WHEN r.event_id % 2 = 0 THEN (r.event_id % 90)::INT END AS broke_at, coalesce(b.outcome || ' (' || b.tokens || ' tokens)', 'not run') AS base FROM r LEFT JOIN (SELECT * FROM r WHERE arm = 0 AND call_id % 4 <> 0) b ON b.call_id = r.call_id WHERE r.outcome <> 'ok'""")
def failure_details(spark, sf_dir):
    """JOIN-17, TXT-16: every failed call, why it stopped, where its JSON broke off, and how the base arm did on the same call."""
    i = F.col("event_id")
    r = fx.read(spark, sf_dir, "events").select("event_id", (i % 3).alias("arm"), F.floor(i / 3).alias("call_id"), "event_type", F.when(F.col("event_type").isin("error", "click"), "failed").otherwise("ok").alias("outcome"), (i * 7 % 20_000).alias("tokens"))
    reasons = F.when(F.col("event_type") == "click", F.array(F.lit("stop"), F.lit("filtered"))).otherwise(F.array().cast("array<string>"))
    error = F.when(i % 2 == 0, F.concat(F.lit("EOF while parsing: line "), (i % 90).cast("string"), F.lit(" column 3"))).otherwise("timed out")
    base = r.filter("arm = 0 and call_id % 4 <> 0").select("call_id", F.concat("outcome", F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens)")).alias("base"))
    out = r.filter("outcome <> 'ok'").join(base, "call_id", "left")
    return out.select("arm", "call_id", records.finish_reason(reasons, F.col("tokens")).alias("finish_reason"), records.broke_at(error).alias("broke_at"), F.coalesce("base", F.lit("not run")).alias("base"))


@query("""WITH cur AS (SELECT DISTINCT s_nationkey AS key FROM supplier WHERE s_suppkey % 3 = 0) SELECT key, 'old' AS origin FROM cur UNION ALL SELECT DISTINCT c_nationkey, 'new' FROM customer WHERE c_nationkey NOT IN (SELECT key FROM cur)""")
def agents_upserted(spark, sf_dir):
    """JOIN-23: new keys are inserted once, known ones stay as they are."""
    cur = fx.read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("key")).distinct().withColumn("origin", F.lit("old"))
    return lifecycle.upsert(cur, fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("new").alias("origin")), "key")


RULES_SQL = "g AS (SELECT p_partkey, unnest(range(1, 8)) AS n FROM part), r AS (SELECT p_partkey * 10 + n AS rule_id, (p_partkey + n) % 3 = 0 AS retired, coalesce(list_sort(list(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IS NOT NULL)), []) AS sources FROM g LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = n GROUP BY 1, 2)"


def _rules(spark, sf_dir):
    """A rule per part and place of a line; its sources are the orders that have the part there. Both meet by grouping: Spark takes the exploded parts for small, and would broadcast them all."""
    every = fx.read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"))
    every = every.select((F.col("p_partkey") * 10 + F.col("n")).alias("rule_id"), ((F.col("p_partkey") + F.col("n")) % 3 == 0).alias("retired"))
    made = fx.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("rule_id"), F.col("l_orderkey").alias("source"))
    both = every.unionByName(made, allowMissingColumns=True).groupBy("rule_id").agg(F.max("retired").alias("retired"), F.array_sort(F.collect_set("source")).alias("source_ids"))
    return both.filter("retired is not null")


@query(f"""WITH {RULES_SQL}, one AS (SELECT rule_id AS ancestor, sources[1] AS s FROM r WHERE len(sources) = 1), e AS (SELECT rule_id, unnest(sources) AS s FROM r WHERE NOT retired) SELECT DISTINCT rule_id, ancestor FROM e JOIN one USING (s) WHERE rule_id <> ancestor""")
def rule_lineage(spark, sf_dir):
    """JOIN-24, JOIN-27, JSN-03: active rules and the rules of a single source that went into them."""
    return records.lineage(_rules(spark, sf_dir))


@query(f"""WITH {RULES_SQL}, e AS (SELECT rule_id, unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS s FROM r WHERE NOT retired) SELECT rule_id, coalesce(array_to_string(list_sort(list(DISTINCT o_custkey) FILTER (WHERE o_custkey IS NOT NULL)), ','), '') AS call_ids FROM e LEFT JOIN orders ON o_orderkey = s GROUP BY 1""")
def rule_snapshot(spark, sf_dir):
    """JOIN-25: active rules with the calls they come from; those without any have none."""
    calls = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("call_id"))
    return records.snapshot(_rules(spark, sf_dir), calls).select("rule_id", F.array_join(F.transform("call_ids", lambda x: x.cast("string")), ",").alias("call_ids"))


@query("""SELECT o_orderkey AS action_id, c_custkey AS analysis_id, n_name AS call FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def training_corrections(spark, sf_dir):
    """JOIN-07: actions, analyses and calls of one category."""
    n = fx.read(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")  # 25 rows by definition
    c = fx.read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return fx.read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("action_id"), F.col("c_custkey").alias("analysis_id"), F.col("n_name").alias("call"))


@query("""WITH d AS (SELECT lang, text, CASE WHEN doc_id % 4 = 0 THEN left(text, 12) || '~~' ELSE left(text, 12) END AS quote FROM documents WHERE text <> '')
    SELECT lang, count(*) AS points, count(*) FILTER (WHERE NOT contains(text, quote)) AS dropped, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{16}')) AS with_numbers FROM d GROUP BY 1""")
def sentiment_drops(spark, sf_dir):
    """AGG-28: points whose quote is not in the text, and texts with long numbers, per category."""
    d = fx.read(spark, sf_dir, "documents").filter("text <> ''").withColumn("quote", F.concat(F.left("text", F.lit(12)), F.when(F.col("doc_id") % 4 == 0, "~~").otherwise("")))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("points"), F.count_if(~F.contains("text", "quote")).alias("dropped"), F.count_if(F.col("text").rlike("[0-9]{16}")).alias("with_numbers"))


@query(f"""WITH b AS (SELECT {LANGUAGE.format("o_custkey")} AS language, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1e5 END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN (o_totalprice + o_custkey) / 1e5 END AS t FROM orders)
    SELECT language, count(*) FILTER (WHERE b IS NOT NULL AND t IS NOT NULL) AS shared, round(avg(b) FILTER (WHERE t IS NOT NULL AND b IS NOT NULL), 6) AS base, round(avg(t) FILTER (WHERE b IS NOT NULL AND t IS NOT NULL), 6) AS tuned,
    round(avg(t) FILTER (WHERE b IS NOT NULL AND t IS NOT NULL) - avg(b) FILTER (WHERE t IS NOT NULL AND b IS NOT NULL), 6) AS delta, count(*) FILTER (WHERE b IS NULL) AS base_failed, count(*) FILTER (WHERE t IS NULL) AS tuned_failed FROM b GROUP BY 1""")
def held_out_comparison(spark, sf_dir):
    """AGG-32, EVL-02: two arms over the calls where both succeeded."""
    o = fx.read(spark, sf_dir, "orders").withColumn("call_id", F.col("o_orderkey")).withColumn("language", fx.category("o_custkey"))
    base = o.withColumn("score", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1e5))
    tuned = o.withColumn("score", F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_totalprice") + F.col("o_custkey")) / 1e5))
    return records.comparison(base, tuned)


@query(f"""WITH a AS (SELECT o_orderkey, {LANGUAGE.format("o_custkey")} AS language, CASE o_orderstatus WHEN 'F' THEN 'inserted' WHEN 'P' THEN 'conflict' END AS outcome FROM orders), s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)
    SELECT language, count(*) AS corrections, count(*) FILTER (WHERE o) AS reopened, count(*) FILTER (WHERE outcome = 'inserted' AND NOT o) AS inserted, count(*) FILTER (WHERE outcome = 'conflict' AND NOT o) AS conflicts, count(*) FILTER (WHERE outcome IS NULL OR o) AS pending
    FROM (SELECT *, coalesce(outcome = 'conflict', false) AND o_orderkey IN (SELECT l_orderkey FROM s) AS o FROM a) GROUP BY 1""")
def induction_report(spark, sf_dir):
    """AGG-37, STR-12, STR-16: what became of corrections, once the conflicts that were selected are open again."""
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", fx.category("o_custkey").alias("language"), F.when(F.col("o_orderstatus") == "F", "inserted").when(F.col("o_orderstatus") == "P", "conflict").alias("outcome"))
    chosen = fx.read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("s", F.lit(True))
    o = o.join(chosen, "o_orderkey", "left").withColumn("o", F.coalesce((F.col("outcome") == "conflict") & F.col("s"), F.lit(False))).withColumn("outcome", F.when(~F.col("o"), F.col("outcome")))
    return o.groupBy("language").agg(F.count(F.lit(1)).alias("corrections"), F.count_if("o").alias("reopened"), F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.count_if(F.col("outcome").isNull()).alias("pending"))


@query("""WITH a AS (SELECT user_id % 4 AS batch, CASE WHEN user_id % 2 = 0 THEN 'memory' ELSE 'control' END AS arm, event_type, value FROM events WHERE user_id % 4 <> 3 OR event_id % 2 = 0)
    SELECT event_type AS batch, round(avg(value) FILTER (WHERE arm = 'memory'), 6) AS memory, round(avg(value) FILTER (WHERE arm = 'control'), 6) AS control, round(avg(value) FILTER (WHERE arm = 'memory') - avg(value) FILTER (WHERE arm = 'control'), 6) AS delta,
    round(count(*) FILTER (WHERE arm = 'memory') / nullif(count(*) FILTER (WHERE arm = 'control'), 0), 6) AS ratio FROM a GROUP BY 1""")
def memory_effect(spark, sf_dir):
    """AGG-42, AGG-43: per batch the two arms, their signed difference and the ratio of their throughputs; null if one is missing."""
    a = fx.read(spark, sf_dir, "events").filter("user_id % 4 <> 3 or event_id % 2 = 0").withColumn("memory", F.col("user_id") % 2 == 0)
    mean = lambda on: F.avg(F.when(F.col("memory") == on, F.col("value")))
    return a.groupBy(F.col("event_type").alias("batch")).agg(F.round(mean(True), 6).alias("memory"), F.round(mean(False), 6).alias("control"), F.round(mean(True) - mean(False), 6).alias("delta"), F.round(F.try_divide(F.count_if("memory"), F.count_if(~F.col("memory"))), 6).alias("ratio"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT q.vec_id AS candidate, r.vec_id AS rule_id, list_cosine_similarity(q.v, r.v) AS c FROM e q JOIN e r ON q.vec_id % 20 = 0 AND r.label % 5 <> 0 AND q.vec_id <> r.vec_id)
    SELECT candidate, rule_id, round(c, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY c DESC, rule_id) <= 3""")
def conflict_candidates(spark, sf_dir):
    """TOP-02, PRJ-12: the three active rules most similar to a new one, which a judge then looks at; new ones are the ids divisible by 20."""
    v = _vectors(spark, sf_dir)
    known = v.filter("label % 5 <> 0").select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec")
    found = rules.retrieve(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec"), known, 4, 4).filter("query_id <> rule_id")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("_n", best).filter("_n <= 3").select(F.col("query_id").alias("candidate"), "rule_id", "similarity")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('11:' || c_custkey)) AS turn, ['billing', 'delivery', 'repair'][((c_custkey * 7 + 11) % 3 + 1)::INT] AS scenario FROM customer""")
def shuffled_sequence(spark, sf_dir):
    """BAT-05: a seeded order within a category and a seeded choice."""
    c = fx.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.md5(F.concat(F.lit("11:"), F.col("c_custkey").cast("string"))).alias("draw"))
    return ordered.ranked(c, ["c_nationkey"], ["draw", "c_custkey"], "turn", "size").select("c_custkey", F.col("turn").cast("long").alias("turn"), _pick(("billing", "delivery", "repair"), (F.col("c_custkey") * 7 + 11) % 3).alias("scenario"))


@query("""SELECT o_orderkey AS id, 'analysis' AS origin, c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT l_orderkey, 'correction', s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'""")
def all_documents(spark, sf_dir):
    """SET-01, SET-02: the rows of two joins, kept as a bag."""
    o = fx.read(spark, sf_dir, "orders").join(fx.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.lit("analysis").alias("origin"), F.col("c_name").alias("owner"))
    li = fx.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(fx.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return o.unionByName(li.select(F.col("l_orderkey").alias("id"), F.lit("correction").alias("origin"), F.col("s_name").alias("owner")))


@query(f"""WITH {fx.CLAIMS_SQL}, r AS (SELECT o_orderkey AS call_id, list('rule ' || l_partkey ORDER BY pos) FILTER (WHERE call_id IS NOT NULL AND l_partkey IS NOT NULL) AS r FROM orders LEFT JOIN c ON call_id = o_orderkey GROUP BY 1)
    SELECT call_id, md5('Extract.' || CASE WHEN r IS NULL THEN '' ELSE chr(10) || chr(10) || '{records.GUIDANCE}' || chr(10) || array_to_string(list_transform(r, lambda x: '- ' || x), chr(10)) END) AS prompt_md5 FROM r""")
def prompts(spark, sf_dir):
    """TXT-14, JOIN-08: retrieved rules in their order; without any the prompt is the plain one."""
    c = fx.claims(spark, sf_dir).groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))), lambda x: F.concat(F.lit("rule "), x["l_partkey"].cast("string"))).alias("r"))
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id")).join(c, "call_id", "left")
    return o.select("call_id", F.md5(records.prompt("Extract.", F.coalesce("r", F.array().cast("array<string>")))).alias("prompt_md5"))


@query("""WITH e AS (SELECT event_id, ['UnattributableLineError', 'NoSpeechError', 'FileNotFoundError', 'ValueError'][(event_id % 4 + 1)::INT] AS k, repeat(event_type, (user_id % 300)::INT) AS m, CASE WHEN event_id % 3 > 0 THEN ts END AS queued, CASE WHEN event_id % 3 > 1 THEN ts END AS started FROM events)
    SELECT event_id, CASE k WHEN 'UnattributableLineError' THEN 'asr: the transcript has a line without a speaker prefix' WHEN 'ValueError' THEN 'asr: ValueError' ELSE left('asr: ' || k || ': ' || m, 1000) END AS reason, CASE WHEN queued IS NULL THEN 1 WHEN started IS NULL THEN 2 ELSE 3 END AS stage FROM e""")
def failure_reasons(spark, sf_dir):
    """TXT-15, DAT-05, STR-08: why a call failed, and at which of the three stages, told by the times that are missing."""
    e = fx.read(spark, sf_dir, "events")
    kind = _pick(("UnattributableLineError", "NoSpeechError", "FileNotFoundError", "ValueError"), F.col("event_id") % 4)
    stage = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 2).otherwise(3)
    return e.select("event_id", records.failure_reason(kind, F.expr("repeat(event_type, cast(user_id % 300 as int))")).alias("reason"), stage.alias("stage"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 2) AS even, l_quantity / 8 - 2.5 > 0.25 OR l_quantity / 8 - 2.5 < -0.25 AS differs FROM lineitem""")
def rounded(spark, sf_dir):
    """MTH-02, MTH-03: halves go to the even neighbour."""
    q = F.col("l_quantity") / 8
    return fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(q, 2).alias("even"), (F.abs(q - 2.5) > 0.25).alias("differs"))


@query("""WITH b AS (SELECT floor(least(0, min(o_totalprice / 1e5 - 1)) / 0.5) AS lo, ceil(greatest(0, max(o_totalprice / 1e5 - 1)) / 0.5) AS hi FROM orders) SELECT unnest(generate_series(lo::BIGINT, hi::BIGINT)) * 0.5::DOUBLE AS tick FROM b""")
def axis_ticks(spark, sf_dir):
    """MTH-04: the steps of an axis that holds zero and all values."""
    v = F.col("o_totalprice") / 1e5 - 1
    b = fx.read(spark, sf_dir, "orders").agg(F.floor(F.least(F.lit(0.0), F.min(v)) / 0.5).alias("lo"), F.ceil(F.greatest(F.lit(0.0), F.max(v)) / 0.5).alias("hi"))
    return b.select(F.explode(F.sequence("lo", "hi")).alias("step")).select((F.col("step") * 0.5).alias("tick"))


@query(f"""WITH {fx.CLAIMS_SQL} SELECT call_id, count(*) FILTER (WHERE l_quantity <= 40) AS kept, count(*) FILTER (WHERE l_quantity > 40) AS dropped, coalesce(string_agg(l_partkey || '@' || (l_partkey % 50 + 3), ',' ORDER BY pos) FILTER (WHERE l_quantity <= 40), '') AS located FROM c GROUP BY 1""")
def partitioned_claims(spark, sf_dir):
    """ARR-01, ARR-03: the kept and the dropped claims of a list, and the kept ones with new places."""
    c = fx.claims(spark, sf_dir).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("pos", "l_partkey", "l_quantity", (F.col("l_partkey") % 50).alias("start")))).alias("a"))
    kept, dropped = F.filter("a", lambda x: x["l_quantity"] <= 40), F.filter("a", lambda x: x["l_quantity"] > 40)
    located = F.transform(F.transform(kept, lambda x: x.withField("start", x["start"] + 3)), lambda x: F.concat(x["l_partkey"].cast("string"), F.lit("@"), x["start"].cast("string")))
    return c.select("call_id", F.size(kept).cast("long").alias("kept"), F.size(dropped).cast("long").alias("dropped"), F.array_join(located, ",").alias("located"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_fields(spark, sf_dir):
    """JSN-01: a field of a document as text."""
    return fx.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH t AS (SELECT conv_id AS call_id, turn AS pos, length(text) / 16.0 AS s FROM conversations), w AS (SELECT *, coalesce(sum(s + 0.5) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t)
    SELECT call_id, pos, round(a::DOUBLE, 4) AS start_sec, round((a + s)::DOUBLE, 4) AS end_sec FROM w""")
def spoken_timeline(spark, sf_dir):
    """SEG-03: places of turns that are spoken one after the other with a fixed gap."""
    t = fx.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("pos"), (F.length("text") / 16.0).alias("seconds"))
    return records.timeline(t, 0.5)


@query("""WITH s AS (SELECT o_orderkey AS call_id FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT l_orderkey AS call_id, arg_min(l_suppkey, l_shipdate::VARCHAR || lpad(l_suppkey::VARCHAR, 9, '0')) AS submission_id, count(*) AS submissions FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
    SELECT call_id, submission_id, submissions, CASE WHEN submission_id IS NULL THEN 'awaiting_review' ELSE 'completed' END AS status FROM s LEFT JOIN f USING (call_id)""")
def resumed_calls(spark, sf_dir):
    """STR-06: a suspended call goes on with its first submission, and only once."""
    s = fx.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("call_id"))
    return records.resumed(s, fx.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("submission_id")))


@query("""SELECT CASE WHEN event_type IN ('click', 'view') THEN 'asr' ELSE 'default' END AS queue, user_id, count(*) AS tasks FROM events GROUP BY 1, 2""")
def routed_topics(spark, sf_dir):
    """STR-09: speech tasks have a queue of their own."""
    return fx.read(spark, sf_dir, "events").groupBy(F.when(F.col("event_type").isin("click", "view"), "asr").otherwise("default").alias("queue"), "user_id").agg(F.count(F.lit(1)).alias("tasks"))


@query("""WITH b AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 20 = 0), h AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 49)
    SELECT coalesce(a.id, b.id) AS rule_id, CASE WHEN b.id IS NOT NULL AND b.id IN (SELECT id FROM h) THEN 'held' WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'kept' WHEN b.id IS NOT NULL THEN 'retired' ELSE 'inserted' END AS fate FROM a FULL JOIN b ON a.id = b.id""")
def consolidation_sync(spark, sf_dir):
    """STR-13, STR-18, SET-04: after consolidation rules are kept, retired or inserted; those of open conflicts took no part."""
    p = fx.read(spark, sf_dir, "part")
    before = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("rule_id"))
    after = p.filter("p_partkey % 4 <> 0 and p_partkey % 3 <> 0").select(F.col("p_partkey").alias("rule_id")).unionByName(p.filter("p_partkey % 20 = 0").select((-F.col("p_partkey")).alias("rule_id")))
    return records.consolidated(before, after, fx.read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("rule_id")))


@query("""WITH d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(text, 6, 15) || '~~' ELSE substr(text, 6, 15) END AS q, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 7 - 2)::BIGINT END AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN q <> '' THEN greatest(coalesce(s, 0), 0) END AS start, CASE WHEN q <> '' THEN greatest(coalesce(s, 0), 0) + length(q) END AS "end", CASE WHEN q <> '' AND contains(text, q) THEN strpos(text, q) - 1 ELSE 0 END AS plain_start,
    CASE WHEN q = '' THEN 1 WHEN contains(text, q) THEN strpos(text, q) - 1 + length(q) ELSE length(q) END AS plain_end, CASE WHEN q <> '' AND contains(text, q) THEN 'Agent' ELSE 'Unknown' END AS speaker FROM d""")
def repaired_quotes(spark, sf_dir):
    """EXT-02, EXT-03: offsets that follow from start and text; quotes kept as they came, with places of their own if they are not in the text."""
    d = fx.read(spark, sf_dir, "documents").filter("text is not null")
    cut = F.substring("text", 6, 15)
    q = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.concat(cut, F.lit("~~"))).otherwise(cut)
    d = d.select("doc_id", "text", q.alias("q"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 - 2).alias("s"))
    r, p = records.repaired(F.col("q"), F.col("s")), records.as_returned(F.col("text"), F.col("q"), F.lit("Agent"))
    return d.select("doc_id", r["start"].alias("start"), r["end"].alias("end"), p["start"].alias("plain_start"), p["end"].alias("plain_end"), p["speaker"].alias("speaker"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE left(text, (doc_id % 40)::INT) END = '' OR length(CASE WHEN doc_id % 4 = 0 THEN '' ELSE left(text, (doc_id % 40)::INT) END) < 0.2 * length(left(text, 100)) AS collapsed FROM documents WHERE regexp_matches(left(text, 100), '^\\S')""")
def length_collapse(spark, sf_dir):
    """FLT-12."""
    tuned = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.left("text", F.col("doc_id") % 40))
    return fx.read(spark, sf_dir, "documents").filter(F.left("text", F.lit(100)).rlike("^\\S")).select("doc_id", records.collapsed(F.left("text", F.lit(100)), tuned).alias("collapsed"))


@query("""WITH p AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, NOT bool_or(coalesce(before > value, false)) AS chronological, arg_min(event_id, printf('%020.6f', value) || printf('%012d', event_id)) AS first_id, arg_max(event_id, printf('%020.6f', value) || printf('%012d', event_id)) AS last_id FROM p GROUP BY 1""")
def point_order(spark, sf_dir):
    """VAL-03, ORD-02, WIN-05: whether points are in the order of their times, and the ends of the sorted list."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = fx.read(spark, sf_dir, "events").withColumn("before", F.lag("value").over(w))
    key = F.struct("value", "event_id")
    return e.groupBy("user_id").agg((~F.bool_or(F.coalesce(F.col("before") > F.col("value"), F.lit(False)))).alias("chronological"), F.min(key)["event_id"].alias("first_id"), F.max(key)["event_id"].alias("last_id"))


@query("""WITH s AS (SELECT c_custkey AS call_id, c_nationkey % 4 AS topic, c_acctbal AS target FROM customer), h AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), k AS (SELECT * FROM s WHERE call_id NOT IN (SELECT c_custkey FROM h)),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('5:' || call_id)) AS r, count(*) OVER (PARTITION BY topic) AS n FROM k)
    SELECT topic, CASE WHEN n >= 2 AND r <= least(greatest(1, round_even(n * 0.15, 0)), n - 1) THEN 'val' ELSE 'train' END AS part, count(*) AS examples, 0::BIGINT AS leaked FROM r GROUP BY 1, 2""")
def training_set(spark, sf_dir):
    """FT-01, FLT-09: held-out calls left out, repeated examples dropped, split by topic, and a guard that none leaked."""
    c = fx.read(spark, sf_dir, "customer")
    held = c.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("call_id"))
    s = c.select(F.col("c_custkey").alias("call_id"), (F.col("c_nationkey") % 4).alias("topic"), F.col("c_acctbal").alias("target"))
    twice = s.withColumn("pos", F.lit(0)).unionByName(s.withColumn("pos", F.lit(1)))
    examples = datasets.first_of(twice.join(held, "call_id", "left_anti"), ["call_id", "topic", "target"], "pos").drop("pos")
    split = datasets.split(examples, 0.15, 5, "topic", "call_id")
    leaked = datasets.leaks(split, held, "call_id").agg(F.count(F.lit(1)).alias("leaked"))
    return split.groupBy("topic", "part").agg(F.count(F.lit(1)).alias("examples")).join(F.broadcast(leaked))  # one row
