"""Queries of the training-data operators, and their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import contain, html, lm, packing, passages, quality, simhash, topk, toxicity, warc
from tessera.llm.common import table


def tokenizer_path() -> str:
    """The public 49k word tokenizer, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_pivots(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, directory, "documents"))


def op2_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), tokenizer_path())


def op3_quality_fourier(spark: SparkSession, directory: str) -> DataFrame:
    return quality.score(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op4_toxicity_compression(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op5_warc_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    records = warc.archive_pages(table(spark, directory, "pages"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_mincut(spark: SparkSession, directory: str) -> DataFrame:
    return html.extract(table(spark, directory, "pages"))


def op7_kdtree_topk(spark: SparkSession, directory: str) -> DataFrame:
    return topk.top_k(table(spark, directory, "embeddings"))


def op8_eliasfano_lm(spark: SparkSession, directory: str) -> DataFrame:
    return lm.score(table(spark, directory, "documents"))


def op9_benchmark_containment(spark: SparkSession, directory: str) -> DataFrame:
    return contain.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op10_passage_chains(spark: SparkSession, directory: str) -> DataFrame:
    return passages.repeated_passages(table(spark, directory, "documents"))


def pipeline(spark: SparkSession, directory: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, directory)


ORACLES = {
    "op5_warc_roundtrip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, max(page_id) AS rep FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS bigint) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < rep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < rep THEN rep END AS refers_to
FROM p LEFT JOIN r ON p.d = r.d AND p.n >= 1000
""",
    "op7_kdtree_topk": """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS bigint) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_benchmark_containment": """
WITH rows AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM rows WHERE id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
t AS (SELECT id, count(*) AS total FROM s WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, t.total, round(count(*) / t.total, 6) AS containment
FROM s d, s b, t WHERE d.side = 0 AND b.side = 1 AND d.shingle = b.shingle AND t.id = b.id
GROUP BY d.id, b.id, t.total HAVING count(*) * 100 >= t.total * 80
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_pivots, op2_best_fit_packing, op3_quality_fourier, op4_toxicity_compression, op5_warc_roundtrip, op6_html_mincut, op7_kdtree_topk,
        op8_eliasfano_lm, op9_benchmark_containment, op10_passage_chains, pipeline,
    )
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
