"""From raw documents to a training mix, in five stages; each one's result is written and read by the next.

1. language ID: documents that are mostly in no learned language go.
2. quality: documents that the weakly trained scorer rejects go.
3. near duplicates: one document of each group stays.
4. decontamination: documents that hold benchmark passages go.
5. mixing: sources are brought to their target weights; a document comes once for every time the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeflow.llm import decontam, langid, mixing, neardup, quality
from changeflow.llm.shared import small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small(stage: Stage) -> Stage:
    """The stage, its rows handed to Python in small batches: executors keep their memory from stage to stage."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_some_language(docs, langid.learned(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    (name, small(stage)) for name, stage in (
        ("language ID", language), ("quality classifier", good), ("near duplicates", distinct), ("benchmark decontamination", clean), ("source mixing", mix))]

#: Trained models and linked components have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
