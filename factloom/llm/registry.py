"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, embeddings, jaccard, language, lines, packing, pii, quality, substrings, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_embedding_dedup": embeddings.op1_embedding_dedup,
        "op2_pii": pii.op2_pii,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_packing": packing.op6_packing,
        "op7_language_id": language.op7_language_id,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_quality_rules": quality.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    """Personal data, tokens, classifiers and packing have none.

    The tests hold personal data, packing and the classifiers' kernels and noisy-or against brute force, tokens against the
    library of the vocabulary's format, and the classifiers' quality against held-out rows.
    """
    return {
        "op1_embedding_dedup": embeddings.SQL,
        "op3_substring_dedup": substrings.SQL,
        "op8_line_dedup": lines.SQL,
        "op9_jaccard_join": jaccard.SQL,
        "op10_quality_rules": quality.SQL,
    }
