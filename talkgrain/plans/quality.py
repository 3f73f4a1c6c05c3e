"""Registered queries on usable transcripts, training sets, whole evaluation runs and review. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import redact as R
from talkgrain.functions import text as T
from talkgrain.operators import datasets, evaluate, evidence, metrics, timelines, training
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import GROUND_SQL, LANGUAGE, SPLIT_SQL, query

REPAIRED_SQL = SPLIT_SQL + """, n AS (SELECT call_id, source_line, speaker, said, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM split),
    p AS (SELECT call_id, source_line, CASE WHEN speaker IS NOT NULL THEN speaker WHEN call_id % 4 = 0 THEN 'Agent' END AS speaker,
          CASE WHEN speaker IS NOT NULL THEN said WHEN call_id % 4 = 0 THEN regexp_replace(CASE WHEN starts_with(line, 'You ') THEN substr(line, 5) ELSE line END, '^\\s+|\\s+$', '', 'g') END AS text,
          CASE WHEN speaker IS NULL AND call_id % 4 > 1 THEN 'no speaker: ' || left(line, 80) END AS fault FROM n WHERE line <> ''),
    parsed AS (SELECT * FROM p WHERE fault IS NOT NULL OR (text <> '' AND speaker IS NOT NULL))""".replace("\\\\", "\\")


def _parsed(spark, sf_dir):
    """Calls divisible by 4 have their unprefixed lines repaired, those one further dropped; the others have no repair."""
    lines = fx.turns(spark, sf_dir)
    bare = evidence.split_turns(lines).filter("speaker is null and call_id % 4 < 2")
    repairs = bare.select("call_id", "source_line", F.when(F.col("call_id") % 4 == 0, "Agent").alias("speaker"), F.lit("You ").alias("strip"))
    return training.parsed(lines, repairs)


@query(REPAIRED_SQL + " SELECT call_id, source_line, speaker, md5(text) AS text, fault FROM parsed")
def parsed_turns(spark, sf_dir):
    """TXT-03: turns with hand repairs by call and line: another speaker, a wrong prefix removed, a line dropped; a line without prefix and repair is a fault."""
    return _parsed(spark, sf_dir).select("call_id", "source_line", "speaker", F.md5("text").alias("text"), "fault")


@query(REPAIRED_SQL + """, u AS (SELECT call_id FROM parsed GROUP BY 1 HAVING count(fault) = 0), c AS (SELECT DISTINCT call_id, language FROM turns)
    SELECT call_id, language, row_number() OVER (PARTITION BY language ORDER BY call_id) AS place FROM c WHERE call_id IN (SELECT call_id FROM u) QUALIFY place <= 20""")
def usable_transcripts(spark, sf_dir):
    """FLT-10: the first twenty calls of each language whose every line has a speaker; the number is the feature."""
    calls = fx.turns(spark, sf_dir).select("call_id", "language").distinct()
    return training.usable(_parsed(spark, sf_dir), calls, 20)


@query(f"""WITH c AS (SELECT o_orderkey AS call_id, {LANGUAGE.format("o_orderkey")} AS language FROM orders), i AS (SELECT DISTINCT l_orderkey AS call_id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT call_id FROM c))
    SELECT 'ids' AS how, call_id FROM c WHERE call_id IN (SELECT call_id FROM i) UNION ALL SELECT 'first', call_id FROM (SELECT * FROM c ORDER BY call_id LIMIT 30)
    UNION ALL SELECT 'per_language', call_id FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY call_id) <= 7) UNION ALL SELECT 'languages', call_id FROM (SELECT * FROM c WHERE language IN ('ar', 'mixed') ORDER BY call_id LIMIT 12)""")
def selected_calls(spark, sf_dir):
    """FLT-13: by explicit ids, the first n, the first n of each language, and some languages with a limit."""
    c = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), fx.category("o_orderkey").alias("language"))
    ids = fx.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("call_id")).join(c, "call_id", "left_semi")
    ways = {"ids": training.selected(c, ids), "first": training.selected(c, limit=30), "per_language": training.selected(c, per_language=7), "languages": training.selected(c, languages=["ar", "mixed"], limit=12)}
    out = None
    for how, rows in ways.items():
        rows = rows.select(F.lit(how).alias("how"), "call_id")
        out = rows if out is None else out.unionByName(rows)
    return out


EXAMPLES_SQL = f"""{fx.CLAIMS_SQL}, e AS (SELECT l_orderkey AS call_id, 'commitments[' || l_linenumber % 3 || ']' AS location, CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 4 END AS target, CASE l_returnflag WHEN 'A' THEN 'review' WHEN 'R' THEN 'difference' ELSE 'written' END AS source, l_suppkey % 6 AS topic, l_orderkey * 100 + pos AS pos FROM c),
    r AS (SELECT *, CASE WHEN call_id % 10 = 0 THEN 'held_out' WHEN call_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') THEN 'not_in_corpus' WHEN target IS NULL THEN 'no_target' END AS why FROM e),
    k AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why, call_id, location, target ORDER BY pos) > 1 THEN 'repeated' ELSE why END AS dropped FROM r),
    s AS (SELECT *, CASE WHEN dropped IS NULL THEN row_number() OVER (PARTITION BY dropped, topic ORDER BY md5('9:' || pos), pos) END AS nth, count(*) OVER (PARTITION BY dropped, topic) AS n FROM k),
    t AS (SELECT *, CASE WHEN dropped IS NULL THEN CASE WHEN n >= 2 AND nth <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END END AS part FROM s)"""


@query(f"""WITH {EXAMPLES_SQL} SELECT source, count(*) AS examples, count(*) FILTER (WHERE part = 'train') AS train, count(*) FILTER (WHERE part = 'val') AS val, count(*) FILTER (WHERE dropped = 'held_out') AS held_out, count(*) FILTER (WHERE dropped = 'not_in_corpus') AS not_in_corpus,
    count(*) FILTER (WHERE dropped = 'no_target') AS no_target, count(*) FILTER (WHERE dropped = 'repeated') AS repeated FROM t GROUP BY 1""")
def training_manifest(spark, sf_dir):
    """FT-01, FLT-09, SET-01: a training set from three sources, each example with the reason that drops it or its part; a held-out call among them would stop the job."""
    c = fx.claims(spark, sf_dir)
    source = F.when(F.col("l_returnflag") == "A", "review").when(F.col("l_returnflag") == "R", "difference").otherwise("written")
    e = c.select("call_id", F.concat(F.lit("commitments["), (F.col("l_linenumber") % 3).cast("string"), F.lit("]")).alias("location"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey") % 4).alias("target"), source.alias("source"), (F.col("l_suppkey") % 6).alias("topic"), (F.col("call_id") * 100 + F.col("pos")).alias("pos"))
    o = fx.read(spark, sf_dir, "orders")
    corpus = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("call_id"))
    held = c.filter("call_id % 10 = 0").select("call_id")
    return training.manifest(training.training_examples(e, corpus, held, 0.2, 9))


@query(GROUND_SQL + """, e AS (SELECT call_id, language, CASE WHEN call_id % 5 = 2 THEN 'TimeoutError: ' || call_id END AS error FROM calls), q AS (SELECT g.*, found_at >= 0 AS ok FROM grounded g JOIN e USING (call_id) WHERE error IS NULL),
    r AS (SELECT l_orderkey AS call_id, 1 - avg(abs(l_discount * 10 - least(1.0, l_discount * 10 + l_tax))) AS r FROM lineitem GROUP BY 1),
    m AS (SELECT e.language, avg(coverage) AS a, avg(coalesce(r, 0)) AS r FROM e JOIN calls USING (call_id) LEFT JOIN r ON r.call_id = e.call_id WHERE error IS NULL GROUP BY 1),
    p AS (SELECT language, avg(ok::INT) AS g, 1 - avg(ok::INT) FILTER (WHERE kind <> 'sentiment') AS u FROM q GROUP BY 1)
    SELECT e.language, count(*) AS calls, count(*) FILTER (WHERE error IS NULL) AS scored, count(error) AS failed, round(any_value(a), 6) AS accuracy, round(any_value(m.r), 6) AS rubric_agreement, round(any_value(g), 6) AS grounding_precision, round(any_value(u), 6) AS unsupported_rate
    FROM e LEFT JOIN m USING (language) LEFT JOIN p USING (language) GROUP BY 1""")
def evaluation_run(spark, sf_dir):
    """EVL-01, EXT-06, AGG-03, AGG-04, AGG-05: one run over all calls: failures counted, and four metrics over the others."""
    calls, claims, scores = _run(spark, sf_dir)
    return evaluate.run(calls.select("call_id", "language", "error"), calls.select("call_id", F.col("coverage").alias("value")), scores, claims)


def _run(spark, sf_dir):
    lines = fx.turns(spark, sf_dir)
    turns = evidence.split_turns(lines)
    grounded = evidence.ground(evidence.extract(turns, F.pmod("call_id", F.lit(2)).cast("int")), evidence.transcript(lines))
    calls = evidence.confidence(grounded, lines).withColumn("error", F.when(F.col("call_id") % 5 == 2, F.concat(F.lit("TimeoutError: "), F.col("call_id").cast("string"))))
    both = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.abs(F.col("l_discount") * 10 - F.least(F.lit(1.0), F.col("l_discount") * 10 + F.col("l_tax"))).alias("d"))
    return calls, grounded.select("call_id", "kind", F.col("kept").alias("supported")), both.groupBy("call_id").agg((1 - F.avg("d")).alias("value"))


@query(GROUND_SQL + " SELECT call_id, language, 'TimeoutError: ' || call_id AS reason FROM calls WHERE call_id % 5 = 2")
def evaluation_failures(spark, sf_dir):
    """EVL-01: the calls that a run failed on, by name and reason."""
    return evaluate.failures(_run(spark, sf_dir)[0])


@query(r"""WITH q AS (SELECT coalesce(lang, 'und') AS language, doc_id % 3 AS kind, 'id 1234567890, ' || coalesce(text, '') AS raw, 'id [NATIONAL_ID], ' AS head, CASE doc_id % 4 WHEN 0 THEN '1234567890' WHEN 1 THEN '[NATIONAL_ID]' WHEN 2 THEN 'id ' ELSE 'nowhere~~' END AS quote, doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\p{Nd}@]')),
    v AS (SELECT language, kind, 'raw' AS view, contains(raw, quote) AS ok FROM q UNION ALL SELECT language, kind, 'redacted', contains(head || substr(raw, 16), quote) FROM q)
    SELECT language, view, count(*) AS quotes, round(avg(ok::INT), 6) AS grounding_precision, round(1 - avg(ok::INT) FILTER (WHERE kind <> 0), 6) AS unsupported_rate FROM v GROUP BY 1, 2""")
def grounding_views(spark, sf_dir):
    """AGG-06: precision and unsupported rate under the raw and the redacted text, by the real redaction; texts get a number in front, and those with digits of their own are left to the tests, as SQL cannot redact them."""
    text = F.coalesce("text", F.lit(""))
    d = fx.read(spark, sf_dir, "documents").filter(~text.rlike("(?U)[\\d@]"))
    i = F.col("doc_id") % 4
    quote = F.when(i == 0, "1234567890").when(i == 1, "[NATIONAL_ID]").when(i == 2, "id ").otherwise("nowhere~~")
    kind = F.when(F.col("doc_id") % 3 == 0, "sentiment").otherwise("commitment")
    return evaluate.grounding_views(d.select(F.coalesce("lang", F.lit("und")).alias("language"), kind.alias("kind"), F.concat(F.lit("id 1234567890, "), text).alias("transcript"), quote.alias("quote")))


@query(f"""WITH {fx.CLAIMS_SQL}, i AS (SELECT call_id, list(l_partkey ORDER BY pos) AS items, list(CASE WHEN l_suppkey % 5 = 0 THEN 'reject' WHEN l_suppkey % 5 = 1 THEN 'correct' ELSE 'confirm' END ORDER BY pos) AS v, list(CASE WHEN l_tax > 0.04 THEN 'note ' || pos END ORDER BY pos) FILTER (WHERE l_tax > 0.04) AS notes FROM c GROUP BY 1),
    a AS (SELECT *, list_filter(list_transform(range(1, len(items) + 1), lambda k: CASE v[k] WHEN 'reject' THEN NULL WHEN 'correct' THEN -items[k] ELSE items[k] END), lambda x: x IS NOT NULL) AS kept FROM i)
    SELECT call_id, array_to_string(kept, ',') AS items, len(list_filter(v, lambda x: x = 'correct'))::INT AS corrected, len(list_filter(v, lambda x: x = 'reject'))::INT AS rejected, coalesce(array_to_string(notes, chr(10) || chr(10)), '') AS notes, CASE WHEN call_id % 9 = 0 THEN 'claims[99]' ELSE '' END AS unknown FROM a""")
def reviewed_claims(spark, sf_dir):
    """RVW-01, ARR-02: the verdicts of a review on any item of a list, all at once; notes joined by blank lines; verdicts on items that are not there are told."""
    c = fx.claims(spark, sf_dir)
    items = c.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))), lambda x: x["l_partkey"]).alias("items")).withColumn("list", F.lit("claims"))
    s = F.col("l_suppkey") % 5
    verdict = F.when(s == 0, "reject").when(s == 1, "correct").otherwise("confirm")
    v = c.select("call_id", F.concat(F.lit("claims["), F.col("pos").cast("string"), F.lit("]")).alias("claim_id"), verdict.alias("verdict"), (-F.col("l_partkey")).alias("patch"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("note "), F.col("pos").cast("string"))).alias("note"))
    lost = c.filter("call_id % 9 = 0").select("call_id").distinct().select("call_id", F.lit("claims[99]").alias("claim_id"), F.lit("reject").alias("verdict"), F.lit(None).cast(v.schema["patch"].dataType).alias("patch"), F.lit(None).cast("string").alias("note"))
    out = evaluate.planned_corrections(v.unionByName(lost), items)
    return out.select("call_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "corrected", "rejected", "notes", F.array_join("unknown", ",").alias("unknown"))


@query(f"""WITH {fx.segments_sql('asr', 'asr')}, {fx.segments_sql('speakers', 'spk')}, j AS (SELECT a.call_id, a.pos, s.name AS speaker, CASE WHEN a.pos % 5 = 3 THEN ' ' ELSE ' word  ' || a.pos || ' ' END AS text, CASE WHEN s.pos IS NOT NULL THEN greatest(0.0, least(a.end_sec, s.end_sec) - greatest(a.start_sec, s.start_sec)) END AS o, abs((a.start_sec + a.end_sec) / 2 - (s.start_sec + s.end_sec) / 2) AS d, s.pos AS p FROM asr a LEFT JOIN spk s USING (call_id)),
    b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY call_id, pos ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, p) = 1), k AS (SELECT * FROM b WHERE trim(text) <> ''),
    r AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM first_value(speaker) OVER (PARTITION BY call_id ORDER BY pos) THEN 'Agent' ELSE 'Customer' END AS role FROM k),
    n AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY call_id ORDER BY pos) = role THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY pos) AS island FROM n),
    l AS (SELECT call_id, island, role || ': ' || string_agg('word ' || pos, ' ' ORDER BY pos) AS line FROM i GROUP BY call_id, island, role) SELECT call_id, md5(string_agg(line, chr(10) ORDER BY island)) AS transcript FROM l GROUP BY 1""")
def labelled_transcripts(spark, sf_dir):
    """SEG-02, ORD-06, WIN-02: recognised segments get speakers, empty ones go, stretches of one speaker become lines, and who speaks first is the agent."""
    asr = fx.segments(spark, sf_dir, "asr")
    text = F.when(F.col("pos") % 5 == 3, " ").otherwise(F.concat(F.lit(" word  "), F.col("pos").cast("string"), F.lit(" ")))
    said = timelines.align(asr, fx.segments(spark, sf_dir, "speakers")).select("call_id", "pos", "speaker", text.alias("text"))
    return timelines.labelled_transcript(said).select("call_id", F.md5("transcript").alias("transcript"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS language, text || CASE WHEN doc_id % 6 = 0 THEN ' [PHONE]' ELSE '' END AS t FROM documents) SELECT language, count(*) AS calls, count(*) FILTER (WHERE regexp_matches(t, '\[[A-Z_]+\]')) AS with_placeholders FROM d GROUP BY 1""")
def placeholder_calls(spark, sf_dir):
    """AGG-38: per language the calls that bear a placeholder."""
    t = F.concat("text", F.when(F.col("doc_id") % 6 == 0, " [PHONE]").otherwise(""))
    d = fx.read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("language"), F.size(R.placeholders(t)).alias("n"))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("n") > 0).alias("with_placeholders"))


@query(f"""WITH e AS (SELECT 'arm' || user_id % 3 AS arm, {LANGUAGE.format("event_id")} AS language, event_type <> 'error' AS ok, value, length(props) AS tokens, CASE WHEN event_id % 4 > 0 THEN 2 END AS n FROM events)
    SELECT arm, language, count(*) AS n, count(*) FILTER (WHERE ok) AS valid, round(avg(ok::INT), 6) AS valid_rate, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(tokens), 6) AS tokens, round(avg(value / 1000) FILTER (WHERE ok), 6) AS accuracy, round(avg(value / 2000) FILTER (WHERE ok), 6) AS rubric_agreement,
    round(avg(1 - value / 1000) FILTER (WHERE ok), 6) AS grounding_precision, round(avg(value / 4000) FILTER (WHERE ok), 6) AS unsupported_rate, coalesce(sum(CASE WHEN arm <> 'arm2' THEN n END), count(*))::BIGINT AS latency_n, round(quantile_cont(value, 0.5) FILTER (WHERE ok), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE ok), 6) AS p95 FROM e GROUP BY 1, 2""")
def benchmark_quality_cells(spark, sf_dir):
    """AGG-16, PRJ-14: a benchmark cell with its four metrics over valid calls, and the number of latencies, which is that of calls where none is told."""
    e = fx.read(spark, sf_dir, "events")
    arm = F.concat(F.lit("arm"), F.pmod("user_id", F.lit(3)).cast("string"))
    rows = e.select(
        arm.alias("arm"), fx.category("event_id").alias("language"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"), F.col("value").alias("latency"), F.length("props").alias("tokens"),
        (F.col("value") / 1000).alias("accuracy"), (F.col("value") / 2000).alias("rubric_agreement"), (1 - F.col("value") / 1000).alias("grounding_precision"), (F.col("value") / 4000).alias("unsupported_rate"),
        F.when((arm != "arm2") & (F.col("event_id") % 4 > 0), 2).cast("long").alias("latency_n"),
    )
    return metrics.benchmark_cells(rows)


@query(f"""WITH b AS (SELECT {LANGUAGE.format("o_custkey")} AS language, ntile(5) OVER (PARTITION BY {LANGUAGE.format("o_custkey")} ORDER BY o_orderkey) AS batch FROM orders) SELECT language, batch::BIGINT AS batch, count(*) AS calls FROM b GROUP BY 1, 2""")
def batch_sizes(spark, sf_dir):
    """AGG-44, BAT-01: how many calls of each language each batch has."""
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", fx.category("o_custkey").alias("language"))
    return datasets.batches(o, 5, "language", "o_orderkey").groupBy("language", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("calls"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 6 > 0 THEN value END AS x, CASE WHEN event_id % 7 > 0 THEN (event_id % 5 - 2) * 0.75 END AS d FROM events)
    SELECT event_id, coalesce(printf('%.3f', x), '—') AS shown, CASE WHEN d IS NULL THEN '—' WHEN d = 0 THEN '0.00' WHEN d < 0 THEN '−' || printf('%.2f', -d) ELSE '+' || printf('%.2f', d) END AS change FROM v""")
def display_numbers(spark, sf_dir):
    """TXT-18: fixed digits, signed differences, a dash for what is not known."""
    e = fx.read(spark, sf_dir, "events")
    d = F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 5 - 2) * F.lit(0.75))
    return e.select("event_id", T.fixed(F.when(F.col("event_id") % 6 > 0, F.col("value")), 3).alias("shown"), T.signed(d, 2).alias("change"))


ARMS_SQL = f"""b AS (SELECT o_orderkey AS call_id, {LANGUAGE.format("o_custkey")} AS language, CASE WHEN o_orderkey % 7 = 0 THEN 'broke' END AS e, o_totalprice / 1e6 AS accuracy, o_custkey / 1e4 AS support FROM orders WHERE o_orderkey % 11 > 0),
    t AS (SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 5 = 0 THEN 'broke' END AS f, (o_totalprice + (o_orderkey % 3 - 1) * 1000) / 1e6 AS accuracy, o_custkey / 1e4 + 0.1 AS support FROM orders WHERE o_orderkey % 13 > 0)"""


def _arms(spark, sf_dir):
    o, key = fx.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = o.filter("o_orderkey % 11 > 0").select(key.alias("call_id"), fx.category("o_custkey").alias("language"), F.when(key % 7 == 0, "broke").alias("error"), (F.col("o_totalprice") / 1e6).alias("accuracy"), (F.col("o_custkey") / 1e4).alias("support"))
    other = o.filter("o_orderkey % 13 > 0").select(key.alias("call_id"), fx.category("o_custkey").alias("language"), F.when(key % 5 == 0, "broke").alias("error"), ((F.col("o_totalprice") + (key % 3 - 1) * 1000) / 1e6).alias("accuracy"), (F.col("o_custkey") / 1e4 + 0.1).alias("support"))
    return base, other


@query(f"""WITH {ARMS_SQL}, j AS (SELECT language, b.accuracy AS a1, t.accuracy AS a2, b.support AS s1, t.support AS s2 FROM b JOIN t USING (call_id) WHERE e IS NULL AND f IS NULL), m AS (SELECT language, 'accuracy' AS metric, a1 AS x, a2 AS y FROM j UNION ALL SELECT language, 'support', s1, s2 FROM j)
    SELECT language, metric, count(*) AS calls, round(avg(x), 6) AS base, round(avg(y), 6) AS other, round(avg(y) - avg(x), 6) AS delta FROM m GROUP BY 1, 2""")
def compared_metrics(spark, sf_dir):
    """AGG-32, JOIN-13: metrics of two arms over the calls that neither failed."""
    return evaluate.compared(*_arms(spark, sf_dir), ["accuracy", "support"])


@query(f"""WITH {ARMS_SQL} SELECT call_id, CASE WHEN (b.accuracy IS NULL OR e IS NOT NULL) AND (t.accuracy IS NULL OR f IS NOT NULL) THEN 'both_failed' WHEN b.accuracy IS NULL OR e IS NOT NULL THEN 'base_failed' WHEN t.accuracy IS NULL OR f IS NOT NULL THEN 'other_failed'
    WHEN round(t.accuracy - b.accuracy, 6) > 0 THEN 'better' WHEN round(t.accuracy - b.accuracy, 6) < 0 THEN 'worse' ELSE 'same' END AS outcome, CASE WHEN e IS NULL AND f IS NULL THEN round(t.accuracy - b.accuracy, 6) END AS delta FROM b FULL JOIN t USING (call_id)""")
def call_outcomes(spark, sf_dir):
    """AGG-32: what became of each call in the two arms."""
    return evaluate.outcomes(*_arms(spark, sf_dir), "accuracy")


@query(f"""WITH {fx.CLAIMS_SQL}, v AS (SELECT call_id, 'claims[' || pos || ']' AS location, 'p' || l_partkey AS p, CASE WHEN l_tax > 0.02 THEN 'p' || l_partkey ELSE 'r' || l_suppkey END AS r, pos FROM c),
    d AS (SELECT call_id, arg_min(location, pos) AS location FROM v WHERE p <> r GROUP BY 1) SELECT d.call_id, d.location, 'claims' AS topic, CASE WHEN pos <> 1 THEN p END AS original, r AS corrected FROM d JOIN v USING (call_id, location)""")
def captured_corrections(spark, sf_dir):
    """CAP-01, JOIN-02: the first difference of each call as a correction with both sides; a side may have nothing there."""
    c = fx.claims(spark, sf_dir)
    at, p = F.concat(F.lit("claims["), F.col("pos").cast("string"), F.lit("]")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    r = F.when(F.col("l_tax") > 0.02, p).otherwise(F.concat(F.lit("r"), F.col("l_suppkey").cast("string")))
    rows = c.select("call_id", at.alias("location"), p.alias("p"), r.alias("r"), "pos")
    first = rows.groupBy("call_id").agg(F.min(F.when(F.col("p") != F.col("r"), F.struct("pos", "location")))["location"].alias("difference"))
    return evaluate.captured(first, rows.filter("pos <> 1").select("call_id", "location", F.col("p").alias("value")), rows.select("call_id", "location", F.col("r").alias("value")))


@query()
def forced_languages(spark, sf_dir):
    """EVL-02: word error rates of two hypotheses per text, and which is better. No SQL: edit distance of words; tested on hand-made cases."""
    d = fx.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("call_id"), fx.category("item_id").alias("language"), F.col("text").alias("reference"))
    return evaluate.forcing(d.select("*", F.regexp_replace("reference", " the ", " ").alias("forced"), F.regexp_replace("reference", " of ", " off well ").alias("detected")))
