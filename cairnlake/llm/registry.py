"""Queries of this subpackage by name, and SQL where it can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage that defines it.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_mixing": "mixing",
    "op3_warc": "warc",
    "op4_ngram_jaccard_join": "ngram_join",
    "op5_weak_quality": "weak_quality",
    "op6_url_filters": "url_filters",
    "op7_line_dedup": "line_dedup",
    "op8_language_id": "language_id",
    "op9_decontamination": "decontamination",
    "op10_suffix_array_dedup": "suffix_dedup",
    "op11_periodic_runs": "runs",
    "op12_source_divergence": "source_divergence",
    "op13_line_dedup": "frequent_lines",
}


def queries() -> dict:
    return {name: getattr(import_module(f"cairnlake.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from cairnlake.llm import frequent_lines, line_dedup, source_divergence, url_filters, warc

    return {
        "op3_warc": warc.op3_sql(),
        "op6_url_filters": url_filters.op6_sql(),
        "op7_line_dedup": line_dedup.op7_sql(),
        "op12_source_divergence": source_divergence.op12_sql(),
        "op13_line_dedup": frequent_lines.op13_sql(),
    }
