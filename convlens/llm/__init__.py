"""Operators for training-data pipelines. Nothing else in the library imports this package.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` adds to its own.
"""

from __future__ import annotations

from convlens.llm import bpe, conversations, exactdup, extraction, jaccard, licenses, merkle, mixing, oracle, passages, quality, topk, toxicity, vectors


def queries():
    return {
        "op1_main_text": extraction.op1_main_text,
        "op2_permutation_knn": vectors.op2_permutation_knn,
        "op3_exact_substrings": exactdup.op3_exact_substrings,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_bpe_roundtrip": bpe.op7_bpe_roundtrip,
        "op8_licenses": licenses.op8_licenses,
        "op9_passages": passages.op9_passages,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
        "op11_repair_conversations": conversations.op11_repair_conversations,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_maxscore": topk.op13_maxscore,
    }


def oracle_sql():
    return dict(oracle.ORACLE)
