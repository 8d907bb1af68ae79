"""Physical plans: what must not be in them at scale."""

from __future__ import annotations

import itertools

import pytest

import __spark_entry__ as entry
from holdfast.operators import clean, customer_month, lifecycle, save
from holdfast.plans.engine import RetentionEngine

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return entry.engine_for(spark, SF_DIR)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CUSTOMER_GRAIN = (
    "members", "transactions", "logs_monthly", "customer_month", "snapshot", "clv", "scored", "lifecycle",
    "saves", "population", "split", "model_frame",
)


@pytest.mark.parametrize("name", CUSTOMER_GRAIN)
def test_no_single_task_and_no_python(engine, name):
    plan = _plan(getattr(engine, name))
    assert "SinglePartition" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan


def test_clv_table_is_not_shuffled(engine):
    """Deciles are literal comparisons: no exchange and no join on the wide table."""
    plan = _plan(engine.clv)
    assert "Exchange" not in plan and "Join" not in plan


def test_split_and_scores_are_narrow(engine):
    assert "Exchange" not in _plan(engine.split)
    assert "Exchange" not in _plan(engine.scored)


@pytest.mark.parametrize("name", ["snapshot", "lifecycle"])
def test_customer_layers_meet_without_a_shuffle(spark, engine, name):
    """Even when no side is small enough to be broadcast."""
    for needed in ("labels", "customer_month", "members", "latest_transaction", "scored"):
        engine.table(needed)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if name == "snapshot":
            df = customer_month.modeling_customer_snapshot(
                engine.table("labels"), customer_month.latest_customer_month(engine.table("customer_month")),
                engine.table("members"), engine.table("latest_transaction"), engine.p,
            )
        else:
            df = lifecycle.survival_base(engine.table("scored"), lifecycle.month_bounds(engine.table("customer_month")))
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_ranking_offers_does_not_sort_wide_rows(spark, engine):
    engine.table("saves")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(save.customer_save_worthiness_scores(
            engine.store, save.from_lifecycle(engine.table("lifecycle")), engine.p, engine.buckets
        ))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "rangepartitioning" not in plan and "recommended_retention_action" in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange" in line:  # what lies below it is moved: the ranked numbers, not the wide rows
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            below = list(itertools.takewhile(
                lambda x: len(x) - len(x.lstrip(" :+-*()0123456789")) > depth, lines[at + 1:]
            ))
            assert below and not any("recommended_retention_action" in x for x in below)


def test_raw_payments_are_filtered_in_the_scan(spark, engine):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(clean.clean_transactions(engine.raw.transactions, engine.table("labels"), engine.label_count))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(joins) == 2 and "SortMergeJoin" in joins[0] and "_salt" in joins[0] and "BroadcastHashJoin" in joins[1]


def test_month_bounds_need_no_shuffle(engine):
    assert "Exchange" not in _plan(engine.month_bounds)


def test_filters_and_columns_reach_the_reader(engine):
    plan = _plan(engine.month_bounds)
    assert "PushedFilters: [IsNotNull(is_latest_month), EqualTo(is_latest_month,true)]" in plan
    assert "monthly_revenue" not in plan


def test_cohort_cells_use_no_join_on_customers(engine):
    plan = _plan(engine.cohort_long)
    assert plan.count("FileScan") <= 2 and "customer_id#" not in plan.split("Join")[0].split("Exchange")[0]


def test_shared_folder_comes_from_the_session(spark, engine):
    assert engine.store.root.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


@pytest.mark.parametrize("name", ["members", "transactions", "logs_monthly", "customer_month", "snapshot", "lifecycle", "saves"])
def test_customers_are_not_broadcast(engine, monkeypatch, name):
    """Files below the threshold of broadcasts can be a table far larger than the driver."""
    monkeypatch.setattr(clean, "MOST_LISTED", 0)
    fresh = RetentionEngine(engine.spark, engine.raw, engine.p, engine.store)
    plan = _plan(getattr(fresh, name))
    # The words of the label filter are bounded.
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_word" not in line and "_part" not in line]
    assert "SortMergeJoin" in plan and not sides
