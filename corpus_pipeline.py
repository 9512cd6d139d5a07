"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and mixing, each reading what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common, decontaminate, linededup, minhash, mixing, quality


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, score_col="__score", predicted_col="__predicted").where("__predicted = 1").select(_names(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; one of which nothing is left goes."""
    out = linededup.dedup_lines(docs).where("__removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(_names(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): that of the smallest id."""
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return common.without_ids(docs, gone, "doc_id")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(_names(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each time a document is drawn."""
    return mixing.mix_sources(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage), ("benchmark decontamination", leak_stage), ("source mixing", mix_stage)]

#: SQL can express neither the classifier's fit nor edit distance to any part of a text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each one's rows are written and read again, so a lost executor repeats one stage at most.

    What a stage needed in between is deleted when its rows are written, and those when the next stage's are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with common.own_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.remove(spark, f"{folder}/{k - 1}")
    return docs
