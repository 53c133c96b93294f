"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import chat, conversation_repair, decontaminate, near_dedup, packing, quality, sharding, source_divergence, suffix_dedup, token_counts, token_index, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_packing": packing.op2_packing,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_quality": quality.op6_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_sharding": sharding.op8_sharding,
        "op9_chat_format": chat.op9_chat_format,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_token_index": token_index.op11_token_index,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_source_divergence": source_divergence.op13_source_divergence,
    }


def oracle_sql() -> dict:
    return {
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op13_source_divergence": source_divergence.OP13_SQL,
    }
