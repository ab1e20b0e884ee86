"""Registered queries of the operators, one each, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import bpe, decontaminate, html, merkle, ngram_join, prefix_trie, quality, secret_scan, sharding, sql, suffix_array, suffix_tree, topk, warc
from tsengine.llm.common import shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every text that holds a benchmark item, with the edits and the place."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), low_share=2.0).select("doc_id", "n_shingles", "component_id")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup_words(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup_bytes(table(spark, sf_dir, "documents"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    return found.select("doc_id", *[secret_scan.count(k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(secret_scan.listing(secret_scan.BASE), 256).alias("base_sha256"),
                        secret_scan.listing(secret_scan.KINDS).alias("spans"), secret_scan.count("random").alias("n_random"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)


_WORD = r"'[^\x20\x09-\x0D]+'"

SQL = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w
 FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op5_suffix_tree_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s SEMI JOIN r USING (h)),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
 FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) q ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op8_warc_segments": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
 CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, TRUE AS complete FROM m""",
    "op9_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op11_merkle_manifest": sql.merkle(),
    "op13_prefix_trie": sql.trie(),
}

QUERIES = {f.__name__: f for f in (
    op1_extract_main_text, op2_decontaminate, op3_ngram_jaccard_join, op4_minimax_shards, op5_suffix_tree_dedup, op6_byte_bpe,
    op7_suffix_array_dedup, op8_warc_segments, op9_pivot_top_k, op10_byte_cnn_quality,
    op11_merkle_manifest, op12_secret_scan, op13_prefix_trie)}
