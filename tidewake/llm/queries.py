"""The corpus operators' queries and their SQL, for the repository's entry file."""

from __future__ import annotations

from tidewake.llm import exact_dedup, hard_negatives, html_text, licence_scan, mixing, near_join, oracles, ordinal_quality, pattern_packing, prefix_trie, projection_forest, suffix_dedup, token_matrix, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_pattern_packing": pattern_packing.op3_pattern_packing,
    "op4_licence_scan": licence_scan.op4_licence_scan,
    "op5_ordinal_quality": ordinal_quality.op5_ordinal_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_projection_forest": projection_forest.op7_projection_forest,
    "op8_ngram_jaccard": near_join.op8_ngram_jaccard,
    "op9_token_matrix": token_matrix.op9_token_matrix,
    "op10_mixing": mixing.op10_mixing,
    "op11_html_text": html_text.op11_html_text,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_suffix_dedup": oracles.OP2_SQL,
    "op8_ngram_jaccard": oracles.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_html_text": html_text.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
