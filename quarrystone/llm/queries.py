"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from quarrystone.llm import bpe, fill_in_middle, filter_audit, fingerprint, jaccard_join, licenses, maxent_lm, metric_join, mixing, pii, quality, secret_scan, substring_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_lm_scoring": maxent_lm.op6_lm_scoring,
    "op7_mixing": mixing.op7_mixing,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_bpe": bpe.op9_bpe,
    "op10_licenses": licenses.op10_licenses,
    "op11_embedding_dedup": metric_join.op11_embedding_dedup,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_pii": pii.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_embedding_dedup": metric_join.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
