"""The corpus pipeline: five operators applied to ``documents``, one after the other.

Each stage works on everything its predecessor kept. Its output is written as
Parquet in the shared checkpoint folder and read again by the next one. All
but the last return the columns of ``documents``; the last returns the packed
pieces. Each operator's docstring says what it does with nulls, empty and
repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendframe.llm import decontaminate, exact_dedup, packing, simhash_dedup
from trendframe.llm import toxicity as tox
from trendframe.llm.common import shipped, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; the machine is fitted on the given tables."""
    machine = tox.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return tox.drop_toxic(docs, machine)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, keep the document with the smallest doc_id."""
    shipped(spark)
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents' tokens into sequences of 1024."""
    shipped(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_dedup", near),
          ("decontamination", decontamination), ("packing", pack)]

#: SQL can express neither the machine nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
