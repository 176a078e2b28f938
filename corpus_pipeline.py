"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage is one training-data operator with its production parameters. Stages take
(spark, docs, sf_dir) and return a DataFrame; run() writes each result as Parquet in the
shared folder and the next stage reads it. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import common, mixing, packing, quality, repeats, setjoin


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    common.ready(spark)
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of the n-gram Jaccard join."""
    common.ready(spark)
    return setjoin.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of long strings that start earlier; a character that is cut in part goes."""
    common.ready(spark)
    return repeats.stripped(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    common.ready(spark)
    return mixing.resampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    common.ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]

#: The stages are not SQL (compression, hashed paths, tokenizers); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
