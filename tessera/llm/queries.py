"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import alignment, embedding_dedup, exact_dedup, language_id, lm_scoring, merkle, minhash_dedup, mixing, packing, quality, substring_dedup, token_counts, url_filters

QUERIES = {
    "op1_quality": quality.query,
    "op3_lm_scoring": lm_scoring.query,
    "op5_substring_dedup": substring_dedup.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op2_minhash_dedup": minhash_dedup.query,
    "op4_source_mixing": mixing.query,
    "op6_language_id": language_id.query,
    "op8_best_fit_packing": packing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_token_counts": token_counts.query,
    "op11_alignment": alignment.query,
    "op12_url_filters": url_filters.query,
    "op13_merkle_manifest": merkle.query,
}
SQL = {
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op2_minhash_dedup": minhash_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_url_filters": url_filters.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
