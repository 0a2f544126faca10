"""A corpus from raw documents to token ids: the stages in order, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epithet.llm import byte_bpe, mixing, ngram_join, quality_ranker, quality_rules
from epithet.llm.common import stage


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return quality_rules.keep_clean(docs)


def _quality_ranker(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold go.  The ranker learns from the raw labelled documents: the
    stage before has removed most of those marked bad, and a ranking needs both sides."""
    raw, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_ranker.keep_good(docs, quality_ranker.learn(raw, labels))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes; a document stands once for each time it is drawn."""
    return mixing.mix(docs)


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document."""
    return byte_bpe.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality_rules", _quality_rules),
    ("quality_ranker", _quality_ranker),
    ("near_duplicates", _near_duplicates),
    ("mixing", _mixing),
    ("byte_bpe", _byte_bpe),
]

# The ranker is a trained model and byte pairs are merged by rank: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
