"""The queries of this subpackage: op1 to op10, and the pipeline's entry is in corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import html_text, mixing, neardup, ngram_lm, packing, pii, quality, sharding, suffix_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place: bucket, slot, batch and row."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs).drop("text")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, of 64."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source")
    return sharding.place(docs, [f"shard-{k:02d}" for k in range(64)])


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture, with its key in the global order."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), "n_copies", "copy", "shuffle_key")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base matches, and all spans with those that contexts add."""
    found = pii.detect(_table(spark, sf_dir, "documents", "doc_id", "text"), carry_text=False)
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("all_spans").alias("spans"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and model scores, from all pairs and triples of words."""
    return ngram_lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"), order=3, least=1)


OP8_SQL = """
WITH RECURSIVE sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), weighted AS (
    SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS weight FROM sizes
), rates AS (
    SELECT source, weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(size) FROM weighted) / size AS rate FROM weighted WHERE size > 0
), cdf(source, rate, k, lp, c) AS (
    SELECT source, rate, 0, -rate, exp(-rate) FROM rates
    UNION ALL
    SELECT source, rate, k + 1, lp + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), c + exp(lp + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
    FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 25)
), drawn AS (
    SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars,
           (CAST(CAST('0x' || substr(md5('mix-v1:count:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
    FROM documents
), counted AS (
    SELECT d.doc_id, d.source, d.n_chars, CAST(count(*) AS INTEGER) AS n_copies
    FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u
    GROUP BY d.doc_id, d.source, d.n_chars, d.u
), copies AS (
    SELECT doc_id, source, n_chars, n_copies, CAST(unnest(generate_series(1, n_copies)) AS INTEGER) AS copy FROM counted
)
SELECT doc_id, source, n_chars, n_copies, copy,
       CAST('0x' || substr(md5('mix-v1:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM copies
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judge(docs, carry_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 400-byte strings that also start elsewhere."""
    rows, kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    kept = kept.select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    nothing = F.lit(0).cast("long")
    return rows.join(kept, F.col("__mr_sha") == F.col("sha"), "left").select(
        "doc_id",
        F.col("__mr_bytes").alias("n_bytes"),
        F.coalesce("n_removed", nothing).alias("n_removed"),
        F.coalesce("n_spans", nothing).alias("n_spans"),
        F.coalesce("kept_sha", "__mr_sha").alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_shard": op2_shard,
    "op3_html": op3_html,
    "op4_topk": op4_topk,
    "op5_minhash": op5_minhash,
    "op6_pii": op6_pii,
    "op7_lm": op7_lm,
    "op8_mix": op8_mix,
    "op9_quality": op9_quality,
    "op10_suffix": op10_suffix,
}
ORACLES = {"op4_topk": OP4_SQL, "op8_mix": OP8_SQL}
