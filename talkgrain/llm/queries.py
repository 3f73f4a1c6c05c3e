"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.llm.collocations import collocations
from talkgrain.llm.common import Scratch
from talkgrain.llm.decontaminate import contaminated
from talkgrain.llm.exact_dedup import exact_dedup
from talkgrain.llm.html import extract_pages
from talkgrain.llm.language_id import fit, held_out, identify
from talkgrain.llm.near_dedup import near_duplicates
from talkgrain.llm.packing import pack_documents
from talkgrain.llm.pii import pseudonymise
from talkgrain.llm.runs import looped, periodic_runs, run_digests
from talkgrain.llm.sharding import shard
from talkgrain.llm.token_counts import token_counts
from talkgrain.llm.training_order import verify, write_shards
from talkgrain.llm.warc import round_trip


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, reads them back sequentially, and gives each sequence's place with both checksums."""
    index = write_shards(table(spark, sf_dir, "documents"), vocabulary(), "epoch-0", Scratch(spark, "order"))
    return verify(spark, index).drop("path")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "talkgrain")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), edit=looped))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, longest=3, drop_percent=50, top=2000).withColumnRenamed("category", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_training_order, op4_pii, op5_warc, op6_token_counts, op7_packing, op8_sharding, op9_near_duplicates, op10_decontamination, op11_periodic_runs, op12_main_text, op13_collocations)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op5_warc": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
        h AS (SELECT *, octet_length(encode(t)) AS n, array_to_string(list_transform(string_split(lower(sha1(t)), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b,
                     min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url
        FROM h""",
    "op9_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
        c AS (SELECT g, min(doc_id) AS c, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g),
        e AS (SELECT c, n, unnest(g) AS h FROM c),
        l AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.h = b.h AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT c AS node, c AS label FROM c UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node),
        m AS (SELECT node, min(label) AS label FROM r GROUP BY 1)
        SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.label, s.doc_id) AS component_id, s.doc_id = coalesce(m.label, s.doc_id) AS kept
        FROM s LEFT JOIN c ON c.g = list_sort(s.g) LEFT JOIN m ON m.node = c.c""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
        g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
              UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
              UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
        f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
        c AS (SELECT lang, k, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a // (x.f::HUGEINT * y.f))::BIGINT AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT lang, u AS phrase, max(f) AS most FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS u FROM f WHERE k = 3) GROUP BY 1, 2)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
        FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
        WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000""",
}
