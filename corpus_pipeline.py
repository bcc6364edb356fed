"""From raw documents to packed sequences: language, exact and near duplicates, mixture, packing.

Each stage works on all that its predecessor kept and returns the columns of ``documents``, the last one the
placed pieces. ``run`` stores the result of a stage and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stintworks.llm import dedup, langid, mixing, neardup, packing
from stintworks.workspace import new_path, remove, scope

# A document is rejected if no window of it reaches this probability for any language, and if it has no letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text or letters, or of no language that the labels know.

    A text in several languages stays: one window that is sure is enough. Without a labelled row to learn from,
    every document with a letter stays.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score", "surest": "__surest"})
    found = langid.predict(named, model)
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("surest") >= LEAST_SCORE)
    return found.filter(known).select(*[F.col(f"`{c}`") for c in named.columns]).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixture", mixture),
    ("packing", packed),
]

# Learned and random decisions have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):  # what a stage wrote on its way goes when its result is stored
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, [last])
        last = path
    return docs
