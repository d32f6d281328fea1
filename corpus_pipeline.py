"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as Parquet
before the next one reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, neardup, packing, pii, quality
from millrace.session import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is good; the others go."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the least id.

    Of repeated rows with one id and text, one stays. Rows without an id can't be named as a component's own: of
    those, one with each text stays if some row without an id is kept.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    kept = neardup.near_duplicates(docs).where("kept").select(key.alias("__mr_key")).distinct()
    keyed = docs.withColumn("__mr_key", key).withColumn("__mr_th", F.xxhash64("text"))
    return keyed.join(kept, "__mr_key", "left_semi").dropDuplicates(["__mr_key", "__mr_th"]).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted again."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their sources' rates, in a random order."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their bucket, batch and row."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, components and bootstrapping are beyond SQL. Tests hold the stages' operators against brute force; of
#: the pipeline as a whole they only check columns and ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is read back from the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
