"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import anisotropic, bpe, cover_tree, langid, near_dup, ngram_lm, packing, suffix_dedup, token_counts, url_cascade

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filters": url_cascade.op2_url_filters,
    "op3_language_id": langid.op3_language_id,
    "op4_embedding_near_dup": cover_tree.op4_embedding_near_dup,
    "op5_nearest_neighbours": anisotropic.op5_nearest_neighbours,
    "op6_minhash_near_dup": near_dup.op6_minhash_near_dup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_bpe": bpe.op8_bpe,
    "op9_lm_scoring": ngram_lm.op9_lm_scoring,
    "op10_packing": packing.op10_packing,
}
ORACLE_SQL = {
    "op2_url_filters": url_cascade.OP2_SQL,
    "op4_embedding_near_dup": cover_tree.OP4_SQL,
}
