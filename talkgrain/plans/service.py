"""Registered queries around the analysis: ingest as a stream, documents, rules, outside models, published tables. Importing this registers them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talkgrain.operators import documents, evidence, rules, service
from talkgrain.plans import fixtures as fx
from talkgrain.plans.registry import GROUND_SQL, SPLIT_SQL, _vectors, query
from talkgrain.sources import files, published, tables
from talkgrain.streaming import lifecycle as stream

EVERY_CALL = GROUND_SQL.replace(" WHERE call_id % 2 = 1", "")


@query(EVERY_CALL + " SELECT language, count(*) AS calls, sum(proposed)::BIGINT AS proposed, sum(kept)::BIGINT AS kept, round(avg(coverage), 6) AS coverage, count(*) FILTER (WHERE coverage < 0.7) AS escalated FROM calls GROUP BY language")
def streamed_calls(spark, sf_dir):
    """STR-01, STR-04, STR-11: files of whole calls, a bounded number per micro-batch, through extraction, grounding and routing; a repeated batch replaces its own output."""
    home = files.shared_folder(spark, "stream")
    lines = fx.turns(spark, sf_dir)
    lines.repartition("call_id").write.parquet(f"{home}/in")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{home}/out/batch={n}")
    run = stream.pipeline(stream.source(spark, f"{home}/in", lines.schema, 4), sink, f"{home}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return evidence.summary(spark.read.parquet(f"{home}/out"))


@query(SPLIT_SQL + """ SELECT call_id, count(*) AS lines, min(source_line) FILTER (WHERE speaker IS NULL AND trim(line) <> '') AS bad_line, count(*) FILTER (WHERE speaker IS NULL AND trim(line) <> '') = 0 AS admitted FROM split GROUP BY 1""")
def admitted_transcripts(spark, sf_dir):
    """PII-04: redacted first; then a line without a speaker refuses its call."""
    lines = fx.turns(spark, sf_dir)
    out = service.admitted(lines)
    return out.select("call_id", F.size(F.split("transcript", "\n")).cast("long").alias("lines"), "bad_line", "admitted")


@query("""SELECT o_orderkey AS id, 'mail [EMAIL]' AS note, o_orderpriority AS speaker, 'id [NATIONAL_ID]' AS first_tag, o_orderpriority AS second_tag, 'card [CARD]' AS held, o_custkey AS n FROM orders""")
def scrubbed_documents(spark, sf_dir):
    """PRJ-11: every string of a nested document, in structs, arrays and maps; numbers and keys stay."""
    o = fx.read(spark, sf_dir, "orders")
    digits = lambda n: F.lpad((F.col("o_orderkey") % 10**9).cast("string"), n, "1")
    note = F.concat(F.lit("mail user"), F.col("o_custkey").cast("string"), F.lit("@example.com"))
    tags = F.array(F.struct(F.concat(F.lit("id "), digits(10)).alias("t")), F.struct(F.col("o_orderpriority").alias("t")))
    doc = F.struct(note.alias("note"), F.struct(F.col("o_orderpriority").alias("speaker"), F.col("o_custkey").alias("n")).alias("quote"), tags.alias("tags"), F.create_map(F.lit("12345678901"), F.concat(F.lit("card "), digits(16))).alias("held"))
    o = o.select(F.col("o_orderkey").alias("id"), doc.alias("doc"))
    o = o.withColumn("doc", service.scrubbed(o, "doc"))
    return o.select("id", "doc.note", "doc.quote.speaker", F.col("doc.tags")[0]["t"].alias("first_tag"), F.col("doc.tags")[1]["t"].alias("second_tag"), F.col("doc.held")["12345678901"].alias("held"), "doc.quote.n")


@query(f"""WITH {fx.CLAIMS_SQL} SELECT call_id, 'claims[' || pos || '].evidence' AS path, 'part ' || l_partkey AS text, l_suppkey AS start_char FROM c WHERE l_returnflag <> 'R'
    UNION ALL SELECT o_orderkey, 'summary.by[0][1]', o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def document_quotes(spark, sf_dir):
    """JSN-05: every quote of documents of any shape with its path; a torn document has none, nor have objects that lack a part."""
    c = fx.claims(spark, sf_dir)
    half = F.col("l_returnflag") == "R"  # to_json leaves out what is null
    text = F.when(half, "no quote").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    quote = F.struct(text.alias("text"), F.lit("Agent").alias("speaker"), F.when(~half, F.col("l_suppkey")).alias("start_char"), F.when(~half, 9).alias("end_char"))
    claims = F.transform(F.array_sort(F.collect_list(F.struct("pos", quote.alias("evidence")))), lambda x: F.struct(x["evidence"].alias("evidence")))
    per = c.groupBy("call_id").agg(F.to_json(claims).alias("claims"))
    said = F.to_json(F.struct(F.col("o_orderpriority").alias("text"), F.lit("Agent").alias("speaker"), F.col("o_custkey").alias("start_char"), F.lit(1).alias("end_char")))
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 7 != 0, said).alias("said"))
    doc = F.concat(F.lit('{"claims":'), "claims", F.lit(',"summary":{"by":[[1,'), F.coalesce("said", F.lit("null")), F.lit("]]}}"))
    torn = F.struct((-F.col("call_id")).alias("call_id"), F.concat(F.lit('{"claims":'), F.rtrim("claims", F.lit("]"))).alias("doc"))
    both = per.join(o, "call_id", "left").select(F.inline(F.array(F.struct("call_id", doc.alias("doc")), torn)))
    return documents.quotes_in(both, "call_id", "doc")


@query("""WITH q AS (SELECT doc_id, coalesce(text, '') AS t, list_filter([left(coalesce(text, ''), 10), substr(coalesce(text, ''), 20, 8), CASE WHEN doc_id % 6 = 0 THEN 'nowhere~~' END, CASE WHEN doc_id % 9 = 0 THEN ' ' END], lambda x: x IS NOT NULL) AS q FROM documents),
    b AS (SELECT doc_id, t, q, list_filter(q, lambda x: regexp_full_match(x, '\\s*') OR NOT contains(t, x)) AS bad FROM q)
    SELECT doc_id, len(bad)::INT AS bad, md5(array_to_string(bad, '|')) AS bad_md5, CASE WHEN len(bad) = 0 THEN array_to_string(list_transform(q, lambda x: strpos(t, x) - 1), ',') END AS starts FROM b""".replace("\\\\", "\\"))
def assembled_references(spark, sf_dir):
    """EXT-04: every quote is placed by the transcript; all bad ones are told together, and then nothing is assembled."""
    text = F.coalesce("text", F.lit(""))
    quotes = F.array_compact(F.array(F.substring(text, 1, 10), F.substring(text, 20, 8), F.when(F.col("doc_id") % 6 == 0, "nowhere~~"), F.when(F.col("doc_id") % 9 == 0, " ")))
    d = fx.read(spark, sf_dir, "documents").select("doc_id", text.alias("t"), quotes.alias("q"))
    d = d.select("doc_id", service.located(F.col("t"), F.col("q")).alias("x"))
    starts = F.array_join(F.transform("x.starts", lambda x: x.cast("string")), ",")
    return d.select("doc_id", F.size("x.bad").alias("bad"), F.md5(F.array_join("x.bad", "|")).alias("bad_md5"), F.when(F.size("x.bad") == 0, starts).alias("starts"))


@query(f"""WITH {fx.CLAIMS_SQL}, u AS (SELECT call_id, sum(l_partkey)::BIGINT AS prompt_tokens, sum(l_suppkey)::BIGINT AS completion_tokens, count(*) AS requests, string_agg(l_returnflag, ',' ORDER BY pos) FILTER (WHERE l_linenumber > 1) AS finish FROM c WHERE l_orderkey % 11 <> 0 GROUP BY 1)
    SELECT o_orderkey AS call_id, CASE o_orderstatus WHEN 'F' THEN 'truncated' WHEN 'P' THEN 'error' ELSE 'ok' END AS outcome, prompt_tokens, completion_tokens, coalesce(requests, 0) AS requests, coalesce(finish, '') AS finish, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'broke' END AS error,
    CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_orderpriority END AS prediction FROM orders LEFT JOIN u ON call_id = o_orderkey""")
def call_records(spark, sf_dir):
    """EXT-05: outcome, tokens, requests and ends of a measured call; without usage the tokens are unknown, not zero."""
    o = fx.read(spark, sf_dir, "orders")
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderstatus").isin("F", "P"), "broke").alias("error"), F.when(F.col("o_orderstatus") == "F", "truncated").alias("failure"), (F.col("o_totalprice") / 1e5).alias("seconds"), F.col("o_orderpriority").alias("prediction"))
    c = fx.claims(spark, sf_dir).filter("l_orderkey % 11 <> 0")
    usages = c.select("call_id", "pos", F.col("l_partkey").alias("prompt"), F.col("l_suppkey").alias("completion"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("finish"))
    return service.call_records(calls, usages).select("call_id", "outcome", "prompt_tokens", "completion_tokens", "requests", F.array_join("finish_reasons", ",").alias("finish"), "error", "prediction")


@query("""WITH b AS (SELECT l_partkey AS candidate, string_agg(DISTINCT lpad(l_suppkey::VARCHAR, 9, '0'), ',' ORDER BY lpad(l_suppkey::VARCHAR, 9, '0')) AS conflicts FROM lineitem WHERE l_tax > 0.06 AND l_quantity > 40 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) GROUP BY 1)
    SELECT p_partkey AS candidate, conflicts IS NULL AS inserted, conflicts FROM part LEFT JOIN b ON candidate = p_partkey""")
def inserted_rules(spark, sf_dir):
    """STR-17: a candidate becomes a rule unless a judge holds an active rule against it; neither side is preferred then."""
    judged = fx.read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("candidate"), F.col("l_suppkey").alias("rule_id"), (F.col("l_tax") > 0.06).alias("conflict"))
    active = fx.read(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("rule_id"))
    out = service.inserted(fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate")), active, judged)
    return out.select("candidate", "inserted", F.array_join(F.transform("conflicts", lambda x: F.lpad(x.cast("string"), 9, "0")), ",").alias("conflicts"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS rule_id, list_cosine_similarity(q.v, r.v) AS c FROM e q JOIN e r ON q.vec_id % 20 = 0 AND r.vec_id // 10 <> q.vec_id // 10)
    SELECT query_id, rule_id, round(c, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, rule_id) <= 5""")
def rules_of_others(spark, sf_dir):
    """FLT-06: the five most similar rules that do not come from the call itself, which owns ten; calls are the ids divisible by 20."""
    v = _vectors(spark, sf_dir)
    source = (F.col("vec_id") - F.col("vec_id") % 10).alias("s")
    known = v.select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec", F.array(source).alias("source_call_ids"))
    calls = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return service.retrieved_from_others(calls, known, 5, 4).select("query_id", "rule_id", "similarity")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.label, a.vec_id, round(sum(list_cosine_similarity(a.v, b.v)), 6) AS s FROM e a JOIN e b ON a.label = b.label GROUP BY 1, 2)
    SELECT label, count(*) AS size, arg_max(s, s) AS similarity FROM s GROUP BY 1""")
def cluster_medoids(spark, sf_dir):
    """AGG-39, in part: the member of a cluster that is most similar to all members."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec", "label")
    found = service.medoids(v, v.select("rule_id", F.col("label").alias("cluster")))
    unit = F.transform("vec", lambda x: x / F.sqrt(rules.dot(F.col("vec"), F.col("vec"))))
    units = v.select("rule_id", unit.alias("u"), "label")
    sums = units.select("label", F.posexplode("u").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    return found.join(units.drop("label"), "rule_id").join(sums, F.col("cluster") == F.col("label")).select("label", "size", F.round(rules.dot(F.col("u"), F.col("total")), 6).alias("similarity"))


@query()
def replayed_batches(spark, sf_dir):
    """AGG-39: three batches of rules, consolidated one after the other, each cluster by its medoid. No SQL: the clustering is a loop; tested against brute force."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("rule_id"), F.col("vec_id").alias("pos"), "vec", (F.col("vec_id") % 3).alias("batch"))
    return service.replayed(v, "batch", 3)


def _features(texts: list[str]) -> np.ndarray:
    """Stands for an outside model: letters, a's and spaces of a text."""
    return np.array([[len(t), t.count("a"), t.count(" ")] for t in texts], float).reshape(-1, 3)


@query("""SELECT doc_id, [length(coalesce(text, '')), len(string_split(coalesce(text, ''), 'a')) - 1, len(string_split(coalesce(text, ''), ' ')) - 1]::VARCHAR AS vec FROM documents""")
def embedded_documents(spark, sf_dir):
    """SIM-04: a batch of texts at a time goes to a model from outside."""
    d = service.embedded(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _features)
    return d.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ", "), F.lit("]")).alias("vec"))


def _sometimes(key: int, attempt: int) -> str:
    """Stands for an outside service: some keys need more attempts than others."""
    if attempt < key % 5:
        raise TimeoutError(f"try {attempt + 1}")
    return f"done {key}"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 'done ' || c_custkey END AS answer, least(c_custkey % 5 + 1, 3)::INT AS tries, CASE WHEN c_custkey % 5 >= 3 THEN 'TimeoutError: try 3' END AS error FROM customer""")
def retried_calls(spark, sf_dir):
    """STR-22: what an outside call could not do in three attempts is a row with its error."""
    return service.retried(fx.read(spark, sf_dir, "customer"), "c_custkey", _sometimes, 3, 0.0)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def published_orders(spark, sf_dir):
    """STR-21, STR-10, SRC-11: one writer stages a table, checks it, renames it; readers see all of it or nothing."""
    home = files.shared_folder(spark, "published")
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    with published.only_writer(spark, f"{home}/lock"):
        published.publish(o, f"{home}/orders", lambda t: t.filter("o_custkey is null").limit(5))
    return published.stored(spark, f"{home}/orders")


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def strict_lines(spark, sf_dir):
    """SRC-07, SNK-02: lines as they were written, read by a schema that stops at the first bad one."""
    home = files.shared_folder(spark, "lines")
    s = fx.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    tables.write_jsonl(s, home)
    return tables.strict_log(spark, home, "s_suppkey long, s_name string, s_nationkey " + s.schema["s_nationkey"].dataType.simpleString() + ", s_acctbal double")


@query("""WITH k AS (SELECT p_partkey, p_partkey % 7 AS s, p_size % 7 AS c, p_retailprice > 1500 AS big FROM part) SELECT p_partkey, CASE WHEN s > 4 THEN 415 WHEN big THEN 413 WHEN s <> c THEN 422 ELSE 200 END AS status FROM k""")
def admitted_uploads(spark, sf_dir):
    """SRC-15: a suffix that is not audio, too many bytes, or first bytes of another format refuse an upload, in that order."""
    kinds = [*tables.AUDIO, "txt", "wave"]
    first = [("00" * (at - 1)) + magic + "00" for at, magic in tables.AUDIO.values()] + ["", "00"]
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % 7 + 1).cast("int"))
    p = fx.read(spark, sf_dir, "part")
    path = F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit("."), F.upper(pick(kinds, F.col("p_partkey"))))
    rows = p.select("p_partkey", path.alias("path"), F.when(F.col("p_retailprice") > 1500, 100).otherwise(10).cast("long").alias("length"), F.unhex(pick(first, F.col("p_size"))).alias("content"))
    return tables.admitted_audio(rows, 50).select("p_partkey", "status")


@query("""WITH n AS (SELECT r_name, count(n_nationkey) AS nations, avg(n_nationkey) FILTER (WHERE n_nationkey > 20) AS mean FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)
    SELECT '| region | nations | mean |' AS value UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || r_name || ' | ' || nations || ' | ' || CASE WHEN mean IS NULL THEN '—' ELSE printf('%.3f', mean) END || ' |' FROM n""")
def report_lines(spark, sf_dir):
    """SNK-03: a report of a few rows as a table of Markdown; what is not known is a dash."""
    r, n = fx.read(spark, sf_dir, "region"), fx.read(spark, sf_dir, "nation")
    mean = F.avg(F.when(F.col("n_nationkey") > 20, F.col("n_nationkey")))
    rows = r.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("region")).agg(F.count("n_nationkey").alias("nations"), mean.alias("mean")).sort("region")
    path = f"{files.shared_folder(spark, 'report')}/report.md"
    files.put(spark, path, tables.markdown([x.asDict() for x in rows.collect()], ["region", "nations", "mean"]))
    return spark.read.text(path).filter("value <> ''")
