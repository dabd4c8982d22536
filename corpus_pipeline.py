"""Corpus pipeline: quality rules, exact dedup, near dedup, source mix, packing.

Each stage works on all that the one before kept and is written and read again in between.
Stages but the last return the columns of ``documents``; the last returns packed pieces.

Defined results: rows with a null or empty text fail the quality rules and go; null ids and sources are kept; repeated rows are
copies, one of which stays; the mix repeats rows that it takes more than once; an empty table gives no pieces; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakfree.llm import exact_dedup, mixing, near_dedup, packing, quality
from leakfree.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near),
          ("source mix", source_mix), ("packing", pack)]

#: No stage after the second can be stated in SQL (signatures, tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
