"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epithet.llm import (
    byte_bpe,
    chat_format,
    conversation_repair,
    lexical_search,
    lm_scoring,
    mixing,
    ngram_join,
    order_minhash,
    quality_ranker,
    quality_rules,
    token_counts,
    url_filters,
    warc,
)
from epithet.llm.statements import STATEMENTS

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_ranker.quality_scores(docs, labels)


def _lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search.search(docs, items)


QUERIES: dict[str, Query] = {
    "op1_ngram_join": _over("documents", ngram_join.jaccard_components),
    "op2_url_filters": _over("pages", url_filters.judge_pages),
    "op3_quality_ranker": _quality_ranker,
    "op4_order_minhash": _over("documents", order_minhash.fingerprint_report),
    "op5_mixing": _over("documents", mixing.mixing_report),
    "op6_quality_rules": _over("documents", quality_rules.quality_report),
    "op7_byte_bpe": _over("documents", byte_bpe.round_trip),
    "op8_token_counts": _over("documents", token_counts.document_token_counts),
    "op9_lm_scoring": _over("documents", lm_scoring.held_out_scores),
    "op10_chat_format": _over("conversations", chat_format.conversation_report),
    "op11_warc": _over("pages", warc.round_trip),
    "op12_lexical_search": _lexical_search,
    "op13_conversation_repair": _over("conversations", conversation_repair.repair_report),
}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in STATEMENTS.items() if name in QUERIES}
