"""Queries of this subpackage for the entry module."""

from __future__ import annotations

from quernel.llm import language_id, media, near_duplicates, packing, pieces, quality_crf, quality_rules, suffix_dedup, token_counts, toxicity


def queries():
    return {
        f.__name__: f
        for f in (
            token_counts.op1_token_counts,
            language_id.op2_language_id,
            pieces.op3_sentencepiece,
            quality_crf.op4_quality_crf,
            suffix_dedup.op5_suffix_dedup,
            near_duplicates.op6_near_duplicates,
            media.op7_media_columns,
            toxicity.op8_toxicity,
            packing.op9_packing,
            quality_rules.op10_quality_rules,
        )
    }


def oracle_sql():
    return {}
