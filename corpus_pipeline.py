"""The corpus pipeline: stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pmtspark.llm.decontaminate import drop_leaks
from pmtspark.llm.mixing import mix_documents
from pmtspark.llm.near_duplicates import keep_one
from pmtspark.llm.quality import keep_good, learn
from pmtspark.llm.quality_rules import keep_documents
from pmtspark.sources import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from this stage's input, accepts."""
    return keep_good(docs, learn(docs))


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds."""
    return keep_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document that is left."""
    return mix_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", within_rules),
    ("near duplicates", one_of_each),
    ("decontamination", without_leaks),
    ("mixing", mixed),
]

#: Not expressible: a trained model, a MinHash join and random draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
