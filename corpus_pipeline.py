"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Every stage takes the documents that the one before kept and returns documents
with the same columns; the last returns where each document's pieces go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendlens.llm import best_fit_packing, catalog, line_dedup, quality_rules, simhash_dedup
from lendlens.llm.common import documents, staged

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy of the rule ledger keeps."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, exactly or within two edits.
    A document with no line left goes."""
    return line_dedup.drop_repeated_lines(docs, max_loss=None).filter("text IS NULL OR text <> ''")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group linked by fingerprints."""
    return simhash_dedup.keep_first(docs, shingle=4, radius=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of CAPACITY words."""
    return best_fit_packing.pack(catalog.packing_input(docs), capacity=CAPACITY).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("best_fit_packing", packing)]

# packing depends on the order in which bins fill up, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
