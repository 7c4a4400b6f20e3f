"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from millrace.llm import (
    decontaminate, hard_negatives, language_id, line_dedup, mixing, near_dedup, piece_codec, quality_gam, quality_rules, secrets, suffix_dedup, token_store, variants,
)

QUERIES = {
    "op1_quality": quality_gam.op1_quality,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_piece_codec": piece_codec.op12_piece_codec,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_store": token_store.op3_token_store,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
}
ORACLES = {"op6_quality_rules": quality_rules.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
