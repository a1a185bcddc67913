"""From raw documents to packed training sequences, stage by stage.

Good documents, without toxic ones, one of each group of near-duplicates, secrets masked, packed into sequences of tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from clearway.llm import near_copies, packing, quality, secret_scan, toxicity
from clearway.llm.common import bound_batches, table
from clearway.llm.queries import QUALITY_THRESHOLD, TOXIC_THRESHOLD, fold, tokenizer_path
from clearway.session import new_shared_path

# SQL has neither the fitted models nor the tokenizer.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """Stages exchange whole texts, tiles and sets of shingles with Python workers; what a task holds of them does not grow with the rows."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


@in_small_batches
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.keep_clean(docs, model, TOXIC_THRESHOLD)


@in_small_batches
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    return near_copies.keep_one(docs)


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, with their new length."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything that is left, in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("SimHash near-dedup", keep_one),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
