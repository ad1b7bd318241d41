"""The registered queries of this subpackage, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import (
    bpe, centroids, context_tree, embed_dedup, hard_negatives, lang_id, line_dedup, ngram_join, packing, secret_scan, token_counts, topk_search, warc,
)
from lathework.llm.common import tokenizer_path
from lathework.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_language_id")
def op8_language_id(spark, folder):
    return lang_id.held_out_predictions(_table(spark, folder, "documents"))


@query("op9_bpe_codec")
def op9_bpe_codec(spark, folder):
    return bpe.token_digests(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_token_counts")
def op10_token_counts(spark, folder):
    return token_counts.count_tokens(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


LINES = """
WITH lines AS (
  SELECT doc_id, i - 1 AS i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)),
shared AS (SELECT * FROM lines WHERE line IN (SELECT line FROM lines GROUP BY line HAVING count(*) > 1)),
pairs AS (
  SELECT b.doc_id, b.i, b.w, a.doc_id AS other, b.i - a.i AS shift
  FROM shared a JOIN shared b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM pairs),
gone AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id, other, shift, run) AS words FROM runs)
  WHERE words >= 50)
"""


@query(
    "op7_line_dedup",
    LINES
    + """
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
  md5(CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
           FROM lines l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
""",
)
def op7_line_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    out = line_dedup.drop_repeated_runs(sized, removed_count="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@query("op1_ngram_join")
def op1_ngram_join(spark, folder):
    return ngram_join.ngram_components(_table(spark, folder, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark, folder):
    docs = _table(spark, folder, "documents")
    return secret_scan.find_secrets(docs, secret_scan.train(docs))


@query(
    "op6_warc",
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits,
    min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT
    + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
)
def op6_warc(spark, folder):
    archives = scratch_path(spark, "warc")
    manifest = warc.write_archives(_table(spark, folder, "pages"), archives)
    return warc.read_archives(manifest, archives).drop("url")


@query(
    "op2_topk_search",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v)::BIGINT DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
WHERE rank <= 10
""",
)
def op2_topk_search(spark, folder):
    return topk_search.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark, folder):
    return embed_dedup.near_duplicates(_table(spark, folder, "embeddings"))


@query(
    "op11_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
)
def op11_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def _round(n: int) -> str:
    """SQL of one round: vectors to the nearest of the centroids ``c<n>``, and the moved centroids."""
    return f"""
a{n} AS (
  SELECT vec_id, v, k AS cluster, d AS distance FROM (
    SELECT vec_id, v, k, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v CROSS JOIN c{n})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
m{n} AS (
  SELECT cluster, list(x ORDER BY i) AS c FROM (
    SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i) GROUP BY cluster),
c{n + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m ON m.cluster = o.k)"""


@query(
    "op12_centroid_clusters",
    f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16),
{",".join(_round(n) for n in range(4))}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.k = a3.cluster
""",
)
def op12_centroid_clusters(spark, folder):
    return centroids.summary(*centroids.cluster(_table(spark, folder, "embeddings")))


@query("op13_lm_scores")
def op13_lm_scores(spark, folder):
    docs = _table(spark, folder, "documents")
    fold = lang_id.fold_of("doc_id")
    scored = context_tree.score(docs, fold != 1)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), *scored.columns[1:])
