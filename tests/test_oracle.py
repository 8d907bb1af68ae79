"""Every query against its DuckDB counterpart on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from holdfast import oracle

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle.comparable_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.LLM_QUERIES}
ROWS_ONLY = {
    "churn_train_logistic_balanced", "churn_train_boosted_trees",
    "churn_train_no_cancel_sensitivity", "churn_score_customers", "churn_permutation_importance",
    "churn_model_comparison", "valid_cancel_signal_sensitivity_trained",
    "valid_feature_importance_governance",
}


def _plain(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(str(r[i])[:10] if hasattr(r[i], "year") else r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_a_counterpart_or_is_listed():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, name):
    cursor = duck.execute(SQL[name])
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = QUERIES[name](spark, SF_DIR).toArrow()
    assert sorted(got.column_names) == sorted(want_names)
    got_rows = [tuple(r.values()) for r in got.to_pylist()]
    assert _plain(got.column_names, got_rows) == _plain(want_names, want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
