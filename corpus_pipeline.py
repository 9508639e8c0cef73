"""The corpus pipeline: reject poor documents, drop exact copies and near copies, mix the sources, and encode what is left.

Null counts as an empty text and a null source as a source of its own; a null doc_id takes no part in training and comes
last where one row of a group stays. Rows that repeat are copies like others. Empty tables pass every stage without rows.
All stages but the last keep the columns they find, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetide.llm import bpe, exact_dedup, mixing, quality, simhash
from pagetide.llm.common import removed, scratch, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest doc_id."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for each row of the mix."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

#: A classifier, connected components, sampling and BPE aren't SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents.

    A stage's own tables go when its rows are written, and its documents when the next one's are: only what the last stage
    reads stays.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            path = shared_dir(spark)
            rows.write.parquet(path)
        removed(spark, before)
        docs, before = spark.read.schema(rows.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
