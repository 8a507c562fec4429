"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from velum.llm import (
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    source_audit,
    spelling,
    substring_dedup,
    topk,
    warc,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_topk_search": topk.op6_topk_search,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op6_topk_search": topk.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_source_audit": source_audit.ORACLE_SQL,
    "op13_secret_scan": secret_scan.ORACLE_SQL,
}
