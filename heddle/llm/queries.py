"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, html_tree, lz, minhash, mixing, oracles, quality_rules, substring, token_store, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_token_ids": token_store.op3_token_ids,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lz_fingerprints": lz.op6_lz_fingerprints,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_repeated_passages": substring.op8_repeated_passages,
    "op9_main_text": html_tree.op9_main_text,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE: dict[str, str] = oracles.ORACLE
