"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from lanternmill.llm import classifier, divergence, embed_dedup, exact_search, line_dedup, mixing, packing, quality_rules, simhash, token_files, url_filter, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_warc": warc.query,
        "op3_mixing": mixing.query,
        "op4_embedding_dedup": embed_dedup.query,
        "op5_url_filter": url_filter.query,
        "op6_quality_rules": quality_rules.query,
        "op7_line_dedup": line_dedup.query,
        "op8_quality_classifier": classifier.query,
        "op9_best_fit_packing": packing.query,
        "op10_token_files": token_files.query,
        "op11_source_divergence": divergence.query,
        "op12_exact_search": exact_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.SQL,
        "op5_url_filter": url_filter.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_exact_search": exact_search.SQL,
    }
