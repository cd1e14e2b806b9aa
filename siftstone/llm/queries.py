"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, mixing, quality, repair, segment, sharding, simhash, spotsigs, substring, tokenfile, tokens, toxicity, yinyang

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_query,
    "op2_substring_dedup": substring.op2_query,
    "op3_toxicity": toxicity.op3_query,
    "op4_segment_sampling": segment.op4_query,
    "op5_token_file": tokenfile.op5_query,
    "op6_spotsigs": spotsigs.op6_query,
    "op7_simhash_dedup": simhash.op7_query,
    "op8_source_mixing": mixing.op8_query,
    "op9_token_counts": tokens.op9_query,
    "op10_quality_rules": quality.op10_query,
    "op11_conversation_repair": repair.op11_query,
    "op12_minimax_sharding": sharding.op12_query,
    "op13_yinyang_clusters": yinyang.op13_query,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_substring_dedup": substring.OP2_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_minimax_sharding": sharding.OP12_SQL,
    "op13_yinyang_clusters": yinyang.OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
