"""A corpus pipeline over documents: quality rules, toxicity, near duplicates, secrets, packing.

Nulls and edges: every row is judged by itself, whether its doc_id is null or repeated. A null text counts as empty and fails the quality rules;
an unknown language is judged by the pooled rules and thresholds; without labels no cutoff is proven and no row is toxic. Copies and near copies
leave one row, that of the least doc_id (nulls last). Very long texts are judged whole and packed in pieces. An empty table gives an empty result,
and columns of documents pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, packing, quality, secret_scan, toxicity
from tessera.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return jaccard.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies: bin, capacity, position."""
    return packing.best_fit(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
