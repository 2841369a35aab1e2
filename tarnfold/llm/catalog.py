"""Registry of the corpus operators' queries and their reference SQL."""

from __future__ import annotations

from tarnfold.llm import decontaminate, filter_audit, hmm_lm, language_id, merkle, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, topk_search, url_filter

QUERIES = {
    "op5_ngram": ngram_join.op5_ngram,
    "op7_dedup": suffix_dedup.op7_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op1_urls": url_filter.op1_urls,
    "op8_mixing": mixing.op8_mixing,
    "op4_lm": hmm_lm.op4_lm,
    "op6_pii": pii.op6_pii,
    "op2_language": language_id.op2_language,
    "op3_topk": topk_search.op3_topk,
    "op10_shards": sharding.op10_shards,
    "op11_quality": quality_rules.op11_quality,
    "op12_filters": filter_audit.op12_filters,
    "op13_manifest": merkle.op13_manifest,
}
ORACLES = {
    "op1_urls": url_filter.ORACLE_SQL,
    "op3_topk": topk_search.ORACLE_SQL,
    "op11_quality": quality_rules.ORACLE_SQL,
    "op12_filters": filter_audit.ORACLE_SQL,
    "op13_manifest": merkle.ORACLE_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
