"""The corpus operators as queries: each over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, histogram_sort, lm_score, multi_index, probminhash, quality, secret_scan, token_count, toxicity, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each secret of each document. Byte offsets are left out: SQL's matches have none."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "rule", "nth", "secret")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.histogram_sort(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.accepted_scores(table(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's class of near-duplicates and the number of vectors near it."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that documents share with benchmark items."""
    return winnow.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that deduplication drops, each with the one that stays for it."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scan, op2_lm_score, op3_histogram_sort, op4_quality, op5_token_count,
            op6_embedding_dedup, op7_toxicity, op8_bpe, op9_decontamination, op10_minhash_dedup,
        )
    }


def _secrets_sql() -> str:
    quoted = [(r.name, r.pattern.replace("'", "''")) for r in secret_scan.RULES]
    found = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{pattern}') AS m FROM documents" for name, pattern in quoted)
    return f"SELECT doc_id, rule, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS nth, unnest(m) AS secret FROM ({found}) WHERE len(m) > 0"


_SHARDS_SQL = """
WITH sized AS (SELECT *, coalesce(strlen(text), 0) AS b FROM documents),
     keys AS (SELECT doc_id, sum(b) AS b FROM sized GROUP BY doc_id),
     placed AS (SELECT doc_id, coalesce(sum(b) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys),
     whole AS (SELECT sum(b) AS total, greatest(16, CAST(ceil(sum(b) / 67108864.0) AS BIGINT)) AS shards FROM sized)
SELECT s.doc_id, s.text, s.lang, s.source, s.n_chars,
       CAST(CASE WHEN total = 0 THEN 0 ELSE least(shards - 1, (before * shards) // total) END AS INTEGER) AS shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id, whole
"""

_NEAR_VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {multi_index.SIMILARITY}),
r AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other)
SELECT node AS vec_id, min(other) AS class_id, (SELECT count(*) FROM p WHERE p.a = node) AS links FROM r GROUP BY node
"""

_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_SPANS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
     dg AS (SELECT doc_id, i, w[i:i + {winnow.SPAN_WORDS - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {winnow.SPAN_WORDS - 2})) AS i FROM d)),
     bg AS (SELECT item_id, i AS j, w[i:i + {winnow.SPAN_WORDS - 1}] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {winnow.SPAN_WORDS - 2})) AS i FROM b)),
     hits AS (SELECT doc_id, item_id, i, j FROM dg JOIN bg USING (g)),
     runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM hits)
SELECT doc_id, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + {winnow.SPAN_WORDS - 1} AS n_words
FROM runs GROUP BY doc_id, item_id, i - j, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secrets_sql(), "op3_histogram_sort": _SHARDS_SQL, "op6_embedding_dedup": _NEAR_VECTORS_SQL, "op9_decontamination": _SPANS_SQL}
