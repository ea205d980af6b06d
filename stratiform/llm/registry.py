"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from stratiform.llm import (
    op1_embedding_neardup,
    op2_line_dedup,
    op3_packing,
    op4_token_counts,
    op5_mixing,
    op6_language_id,
    op7_jaccard_join,
    op8_fingerprints,
    op9_passages,
    op10_secrets,
    op11_fill_in_middle,
    op12_merkle,
    op13_exact_topk,
)

QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup.query,
    "op2_line_dedup": op2_line_dedup.query,
    "op3_best_fit_packing": op3_packing.query,
    "op4_token_counts": op4_token_counts.query,
    "op5_mixing": op5_mixing.query,
    "op6_language_id": op6_language_id.query,
    "op7_jaccard_join": op7_jaccard_join.query,
    "op8_fingerprints": op8_fingerprints.query,
    "op9_repeated_passages": op9_passages.query,
    "op10_secret_scan": op10_secrets.query,
    "op11_fill_in_middle": op11_fill_in_middle.query,
    "op12_merkle_manifest": op12_merkle.query,
    "op13_exact_topk": op13_exact_topk.query,
}

ORACLES = {"op5_mixing": op5_mixing.ORACLE, "op11_fill_in_middle": op11_fill_in_middle.ORACLE, "op12_merkle_manifest": op12_merkle.ORACLE, "op13_exact_topk": op13_exact_topk.ORACLE}
