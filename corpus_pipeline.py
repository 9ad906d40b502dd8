"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Quality rules drop documents, the n-gram join keeps one document of each group of near copies, the
passage step cuts repeated passages, the mix takes documents (whole, up to three times) towards the
weights of their sources, and the last stage encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from convlens.llm import bpe, jaccard, mixing, passages, quality
from convlens.sources.staging import drop, staged
from convlens.sources.staging import stage as written

_scratch: list[str] = []


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Drops what earlier stages have staged for themselves, unless docs still reads it: written
    results do not."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles()) if _scratch else ""
        drop(spark, [p for p in _scratch if p.rsplit("/", 1)[-1] not in read])
        known = set(staged()) - set(_scratch)
        out = function(spark, docs, sf_dir)
        _scratch[:] = [p for p in staged() if p not in known]
        return out

    return run_stage


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_passages(docs)


@tidy
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@tidy
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL cannot express the fitted rules, the passage search and the tokenizer; tests/llm compares the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
