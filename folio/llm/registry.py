"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from folio.llm import ball_kmeans, chat_format, decontaminate, html_extract, language_id, lexical_search, mixing, ngram_join, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_bradley_terry": quality_classifier.op1_bradley_terry,
    "op2_offset_masks": chat_format.op2_offset_masks,
    "op6_induced_dedup": suffix_dedup.op6_induced_dedup,
    "op7_combination_prefixes": ngram_join.op7_combination_prefixes,
    "op8_cross_parsing": language_id.op8_cross_parsing,
    "op4_block_labeller": html_extract.op4_block_labeller,
    "op10_cgk_decontaminate": decontaminate.op10_cgk_decontaminate,
    "op5_host_rules": quality_rules.op5_host_rules,
    "op9_mixed": mixing.op9_mixed,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op11_weak_supervision": toxicity.op11_weak_supervision,
    "op12_sorted_accumulation": lexical_search.op12_sorted_accumulation,
    "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
}
ORACLES: dict[str, str] = {
    "op5_host_rules": quality_rules.OP5_SQL,
    "op12_sorted_accumulation": lexical_search.OP12_SQL,
    "op13_ball_kmeans": ball_kmeans.OP13_SQL,
}
