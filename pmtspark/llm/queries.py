"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pmtspark.llm.chat import digest_conversations, format_turns
from pmtspark.llm.decontaminate import find_leaks
from pmtspark.llm.divergence import audit_sources
from pmtspark.llm.langid import identify_languages
from pmtspark.llm.license_scan import scan_licenses
from pmtspark.llm.mixing import mix_documents
from pmtspark.llm.near_duplicates import near_duplicates
from pmtspark.llm.quality import classify_quality
from pmtspark.llm.quality_rules import apply_rules
from pmtspark.llm.ranked_search import ranked_search
from pmtspark.llm.secret_scan import scan_secrets
from pmtspark.llm.toxicity import detect_toxicity
from pmtspark.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"))


@query
def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame(
        [(-7, 0, "user", saying), (-7, 1, "assistant", saying)],
        "conv_id long, turn long, role string, text string",
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest_conversations(format_turns(turns.unionByName(probe)))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))
