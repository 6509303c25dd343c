"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import fingerprints, mixing, packing, pitman_yor, quality_lines, quality_rules, secrets, simhash, token_counts, toxicity

QUERIES = {
    "op1_pitman_yor": pitman_yor.op1_pitman_yor,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_lines": quality_lines.op8_quality_lines,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.OP3_SQL,
}
