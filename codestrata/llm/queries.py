"""The registered queries of this folder: name -> query, name -> SQL for DuckDB."""

from __future__ import annotations

from codestrata.llm import (
    language_id,
    lattice_lm,
    lexical_search,
    merkle,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    substring_dedup,
    token_counts,
    token_files,
    topk_search,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.repeats_of_documents,
    "op2_language_id": language_id.languages_of_documents,
    "op3_toxicity": toxicity.toxicity_of_documents,
    "op4_token_files": token_files.token_files_of_documents,
    "op5_quality_rules": quality_rules.quality_of_documents,
    "op6_topk_search": topk_search.nearest_embeddings,
    "op7_mix_sources": mixing.mixed_documents,
    "op8_lattice_lm": lattice_lm.scores_of_documents,
    "op9_near_dedup": near_dedup.near_duplicates_of_documents,
    "op10_packing": packing.packed_table,
    "op11_lexical_search": lexical_search.best_documents_of_items,
    "op12_token_counts": token_counts.token_counts_of_documents,
    "op13_merkle_manifest": merkle.manifest_of_documents,
}

ORACLES = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_topk_search": topk_search.ORACLE_SQL,
    "op7_mix_sources": mixing.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
