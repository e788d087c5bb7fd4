"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixing.

Every stage takes what its predecessor kept as a table of documents.  Between stages the documents
are written as Parquet to the shared folder and read again, so a lost executor repeats one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm.common import materialise
from quadloom.llm.op2_jaccard_join import keep_one
from quadloom.llm.op3_pii import mask_pii
from quadloom.llm.op5_mixing import mix
from quadloom.llm.op6_decontamination import without_leaks
from quadloom.llm.op8_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mix(docs)


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("benchmark decontamination", decontaminate),
          ("personal data", mask), ("mixing", mixture)]

#: The stages estimate robust statistics, close links and hash an order: no SQL expresses that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
