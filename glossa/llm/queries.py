"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from glossa.llm import ann, exact_dedup, exact_topk, hmm_lm, jaccard_join, language_id, merkle, mixing, quality, sentencepiece_codec, suffix_dedup, token_count, vector_codes

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_learned_partitions": ann.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_quality": quality.query,
    "op5_token_counts": token_count.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_language_id": language_id.query,
    "op8_mix_sources": mixing.query,
    "op9_hmm_lm": hmm_lm.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_vector_codes": vector_codes.query,
    "op12_merkle_manifest": merkle.query,
    "op13_exact_topk": exact_topk.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_exact_topk": exact_topk.ORACLE,
}
