"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, checks, decontaminate, divergence, jaccard, langid, mixing, pieces, pii, quality, search, secrets, toxicity, warc


def queries():
    return {
        "op1_pii": pii.op1,
        "op2_ngram_jaccard": jaccard.op2,
        "op3_quality_rules": quality.op3,
        "op4_mixing": mixing.op4,
        "op5_chat_format": chat.op5,
        "op6_secret_scan": secrets.op6,
        "op7_language_id": langid.op7,
        "op8_toxicity": toxicity.op8,
        "op9_decontamination": decontaminate.op9,
        "op10_warc": warc.op10,
        "op11_sentencepiece": pieces.op11,
        "op12_ranked_search": search.op12,
        "op13_source_divergence": divergence.op13,
        "pii_base_spans": checks.pii_base_spans,
        "quality_statistics": checks.quality_statistics,
        "mixing_targets": mixing.target_rows,
    }


def oracle_sql():
    return {
        "op2_ngram_jaccard": checks.NGRAM_JACCARD,
        "op5_chat_format": chat.ORACLE,
        "op9_decontamination": checks.DECONTAMINATION,
        "op10_warc": warc.ORACLE,
        "op12_ranked_search": search.ORACLE,
        "op13_source_divergence": divergence.ORACLE,
        "pii_base_spans": checks.PII_BASE,
        "quality_statistics": checks.QUALITY,
        "mixing_targets": mixing.TARGETS_SQL,
    }
