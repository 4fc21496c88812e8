"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import chat_format, decontamination, line_dedup, lm_scoring, mixing, ngram_jaccard, quality_rules, token_counts, url_filter, warc

_QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
}
_SQL = {
    "op1_lm_scoring": lm_scoring.ORACLE_SQL,
    "op2_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_chat_format": chat_format.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
