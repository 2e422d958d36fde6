"""The operators' queries and SQL, for the entry module."""

from __future__ import annotations

from . import alignment, embedding_dedup, language_id, language_model, merkle, mixing, oracle, packing, quality_classifier, quality_rules, simhash, spotsigs, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op3_best_fit_packing": packing.query,
    "op2_bloom_lm": language_model.query,
    "op4_spotsigs": spotsigs.query,
    "op5_language_id": language_id.query,
    "op6_simhash": simhash.query,
    "op7_token_counts": token_counts.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_quality_rules": quality_rules.query,
    "op10_source_mixing": mixing.query,
    "op11_token_alignment": alignment.query,
    "op12_embedding_dedup": embedding_dedup.query,
    "op13_merkle_manifest": merkle.query,
}

#: Trained, iterative and hash-defined results have no SQL; tests hold those against brute force.
ORACLE_SQL = {"op1_substring_dedup": oracle.SUBSTRING_DEDUP, "op9_quality_rules": oracle.QUALITY_RULES, "op12_embedding_dedup": oracle.EMBEDDING_DEDUP, "op13_merkle_manifest": oracle.MERKLE}
