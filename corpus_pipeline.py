"""The training-data pipeline: each stage's rows are written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.exact_dedup import drop_exact_duplicates
from lodestone.llm.language_id import drop_unidentified
from lodestone.llm.minhash_dedup import drop_near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.quality import drop_low_quality
from lodestone.session import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return drop_unidentified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no more surprising than trusted ones of their language."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the largest doc_id of each text."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each component of near-duplicates."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents left lies in the training sequences."""
    return pack(docs)


STAGES = [("language", language), ("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: SQL can't train or apply the models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. An empty table goes through all stages and gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
