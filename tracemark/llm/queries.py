"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from tracemark.llm import chat_format, decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, mixing, pii, substring_dedup, token_alignment, token_counts, warc
from tracemark.llm.common import table


def queries() -> dict:
    return {
        "op1_language_id": lambda spark, d: language_id.op1(table(spark, d, "documents")),
        "op2_chat_format": lambda spark, d: chat_format.op2(table(spark, d, "conversations")),
        "op3_jaccard_join": lambda spark, d: jaccard_join.op3(table(spark, d, "documents")),
        "op4_decontaminate": lambda spark, d: decontaminate.op4(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op5_exact_dedup": lambda spark, d: exact_dedup.op5(table(spark, d, "documents")),
        "op6_html_extract": lambda spark, d: html_extract.op6(table(spark, d, "pages")),
        "op7_pii": lambda spark, d: pii.op7(table(spark, d, "documents")),
        "op8_mixing": lambda spark, d: mixing.op8(table(spark, d, "documents")),
        "op9_warc": lambda spark, d: warc.op9(table(spark, d, "pages")),
        "op10_token_counts": lambda spark, d: token_counts.op10(table(spark, d, "documents")),
        "op11_token_alignment": lambda spark, d: token_alignment.op11(table(spark, d, "documents")),
        "op12_substring_dedup": lambda spark, d: substring_dedup.op12(table(spark, d, "documents")),
        "op13_hard_negatives": lambda spark, d: hard_negatives.op13(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict:
    return {
        "op2_chat_format": chat_format.OP2_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_warc": warc.OP9_SQL,
        "op12_substring_dedup": substring_dedup.OP12_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
