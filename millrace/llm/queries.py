"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_quality_classifier, op10_bpe, op11_fill_in_middle, op12_source_divergence, op13_simhash, op2_toxicity, op3_chat_format, op4_ngram_join, op5_decontamination, op6_language_id, op7_token_output, op8_secret_scans, op9_quality_rules

from .oracles import SQL


def queries():
    return {
        "op1_quality_classifier": op1_quality_classifier.query,
        "op2_toxicity": op2_toxicity.query,
        "op3_chat_format": op3_chat_format.query,
        "op4_ngram_join": op4_ngram_join.query,
        "op5_decontamination": op5_decontamination.query,
        "op6_language_id": op6_language_id.query,
        "op7_token_output": op7_token_output.query,
        "op8_secret_scans": op8_secret_scans.query,
        "op9_quality_rules": op9_quality_rules.query,
        "op10_bpe": op10_bpe.query,
        "op11_fill_in_middle": op11_fill_in_middle.query,
        "op12_source_divergence": op12_source_divergence.query,
        "op13_simhash": op13_simhash.query,
    }


def oracle_sql():
    return dict(SQL)
