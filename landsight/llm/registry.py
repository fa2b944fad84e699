"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import ball_search, bpe, exact_dedup, hard_negatives, langid, lexical_search, near_dedup, packing, quality, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": langid.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_exact_top_k": ball_search.op11_exact_top_k,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_ranked_lexical": lexical_search.op13_ranked_lexical,
}

ORACLE = {
    "op1_quality_rules": quality.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_minhash_near_dedup": near_dedup.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_exact_top_k": ball_search.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_ranked_lexical": lexical_search.OP13_SQL,
}
