"""Registered queries of the package: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import (decontamination, html_extraction, jaccard_join, line_dedup, packing, phrases, prefix_trie, quality_classifier, quality_rules, substring_dedup, suffix_dedup,
               token_count, toxicity)

QUERIES = {
    "op1_token_counts": token_count.query,
    "op2_toxicity": toxicity.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_line_dedup": line_dedup.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_best_fit_packing": packing.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_decontamination": decontamination.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_phrases": phrases.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_html_extraction": html_extraction.query,
}

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
