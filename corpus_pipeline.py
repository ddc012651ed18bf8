"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing to target weights, packing.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages lies a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm import exact, jaccard, mixing, packing, quality
from bytelake.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs' rows, doesn't reject."""
    net = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, net, carry=docs.columns).where("predicted = 1").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest identifier."""
    return exact.content_sort_dedup(docs, carry=docs.columns).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one at the end of a source's budget in part, with its own n_chars."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix), ("pack", pack)]

#: The classifier, hash-based tokens and tokenised lengths are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
