"""From documents to training sequences: quality rules, exact and near duplicates, packing.

Each stage takes all rows its predecessor kept and returns them with the
columns of ``documents``; the last returns the packed pieces.  ``run`` writes
every stage as Parquet in the shared folder and hands the reread table on, so
a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinse.llm import exact_dedup, jaccard_join, packing, quality_rules
from rinse.llm.common import durable, table
from rinse.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("best-fit packing", packed)]

#: SQL has neither the rules' expectation-maximisation nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
