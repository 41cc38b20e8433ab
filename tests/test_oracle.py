"""Every core query with an SQL form against DuckDB on the smallest tables."""

import pytest
from oracle import compare

from blockwise.plans import queries

SLOW = {"a20_a21_condition_summary", "f04_preferred_pool", "a16_macro_rows", "j07_baseline_delta", "w15_largest_changes", "a32_standardized", "a15_combination_summary", "w13_w14_combination_ranking", "a28_selection_metrics", "a27_failure_modes", "w06_threshold_sweep", "w05_coverage_checkpoints"}


@pytest.mark.parametrize("name", [n for n in queries.SQL if n not in SLOW])
def test_query_equals_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.SQL[name])


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
