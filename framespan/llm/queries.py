"""The registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.llm import (
    op1_secrets,
    op2_toxicity,
    op3_embedding_dedup,
    op4_ngram_join,
    op5_sentence_spans,
    op6_decontaminate,
    op7_html_trees,
    op8_mixing,
    op9_line_dedup,
    op10_warc,
    op11_token_counts,
    op12_whitening,
    op13_divergence,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_secrets", op1_secrets.report_sql())
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    return op1_secrets.report(op1_secrets.scan(table(spark, sf, "documents"))).withColumnRenamed("path", "doc_id")


@query("op2_toxicity")
def toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return op2_toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
         AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(v.vec_id, m), v.vec_id) AS component_id, coalesce(least(v.vec_id, m), v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN least ON v.vec_id = least.vec_id LEFT JOIN n ON v.vec_id = n.vec_id
"""


@query("op3_embedding_dedup", OP3_SQL)
def embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op3_embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query("op4_ngram_join")
def ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    links = op4_ngram_join.join(table(spark, sf, "documents"))
    return links.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", "kept")


@query("op5_sentence_spans")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return op5_sentence_spans.dedup(table(spark, sf, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, list_slice(ws, i, i + least(13, len(ws)) - 1) AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS win
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, sizes WHERE len(ws) >= k)),
hits AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""


@query("op6_decontaminate", OP6_SQL)
def decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = op6_decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("_k0", "_k1")


#: The given pages mark their article themselves, so plain text work on them must give what the trees give.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


@query("op7_html_trees", OP7_SQL)
def html_trees(spark: SparkSession, sf: str) -> DataFrame:
    return op7_html_trees.main_text(table(spark, sf, "pages"))


@query("op8_mixing")
def mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    keyed = docs.select("doc_id", "source", *op8_mixing.source_and_key("source", "doc_id", "text"))
    return keyed.join(op8_mixing.schedule(docs), ["_k0", "_k1"]).select("doc_id", "source", "block", "slot", "offset")


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
frequent AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, f.key IS NOT NULL AS lost FROM l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op9_line_dedup.line_report(table(spark, sf, "documents"))


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n
"""


@query("op10_warc", OP10_SQL)
def warc(spark: SparkSession, sf: str) -> DataFrame:
    return op10_warc.archive(table(spark, sf, "pages"))


@query("op11_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    counted = op11_token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op12_whitening")
def whitening(spark: SparkSession, sf: str) -> DataFrame:
    return op12_whitening.whitening_report(table(spark, sf, "embeddings"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
n AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS total FROM n GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, k.c AS all_c, v.v, v.total AS all_total,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.c, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p
      FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * (all_c + 1)) // (all_total + v) AS q FROM p WHERE c > 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM q WHERE p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op13_divergence", OP13_SQL)
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    return op13_divergence.audit(table(spark, sf, "documents"))
