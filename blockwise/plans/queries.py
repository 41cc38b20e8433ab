"""Registered queries of the core library and their SQL."""

from __future__ import annotations

from blockwise.plans import q_fields, q_hot, q_labels, q_runs, q_similarity, q_studies

QUERIES: dict = {}
SQL: dict = {}
for _m in (q_hot, q_fields, q_labels, q_similarity, q_runs, q_studies):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL

_REPAIR = ["fixed_false_splits", "fixed_false_merges", "introduced_false_splits", "introduced_false_merges", "unchanged_pairs"]
#: Counts that DuckDB sums up in 128 bits, given back in 64 as Spark has them.
_COUNTS = {
    "a24_status_counts": ["completed", "failed", "not_run"], "v01_validate": ["n_unknown", "n_repeated", "n_duplicate", "n_missing"], "j04_contingency": ["ts", "ps"], "a01_pairwise_metrics": ["papers"], "a02_pairwise_last_label": ["papers"],
    "a04_cluster_analysis": ["missing_papers", "unknown_papers", "cross_cluster_duplicates", "fully_covered_authors"], "a07_complete_author_coverage": ["fully_covered_authors"], "a08_coarse_report": ["real_authors_fully_covered"],
    "a14_partial_evaluation": ["papers"], "a14_partial_counts": ["evaluated", "incomplete"], "a17_total_rows": _REPAIR, "a20_a21_condition_summary": ["improved", "degraded", "unchanged"], "w06_threshold_sweep": ["accepted_authors"],
    "w06_chosen_threshold": ["accepted_authors"], "a27_failure_modes": ["low_precision_only", "low_recall_only", "both_low", "neither"], "a28_selection_metrics": ["accepted_authors"],
}
for _n, _cols in _COUNTS.items():
    SQL[_n] = "SELECT * REPLACE (" + ", ".join(f"{c}::BIGINT AS {c}" for c in _cols) + f") FROM (\n{SQL[_n]}\n) counted"
