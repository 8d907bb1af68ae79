"""Hand-made rows for the rules that the generated data cannot reach."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import REFERENCE
from holdfast.operators import abtest, clean, cohort, customer_month, evaluate, lifecycle, roi, save
from holdfast.sources import raw


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 1)], "customer_id string, is_churn int")


def test_members_last_registration_wins_and_age_is_bounded(spark, labels):
    members = spark.createDataFrame(
        [("a", 1, 30, None, 3, 20160101), ("a", None, 130, "male", None, 20170101), ("b", 2, 0, "female", 4, 20171301),
         ("x", 1, 20, "male", 3, 20150101)],
        "customer_id string, city int, bd int, gender string, registered_via int, registration_init_time int",
    )
    got = _rows(clean.clean_members(members, labels), "customer_id", "city", "age", "gender", "registered_via",
                F.col("registration_date").cast("string"))
    assert got == [("a", 0, None, "male", 0, "2017-01-01"), ("b", 2, None, "female", 4, None)]


@pytest.fixture(scope="module")
def transactions(spark, labels):
    rows = [
        # customer, method, days, list, paid, auto, date, expiry, cancel
        ("a", 1, 30, 100.0, 90.0, 1, 20170105, 20170204, 0),
        ("a", 2, 0, 100.0, 100.0, 0, 20170105, 20170204, 1),
        ("a", 1, 30, 200.0, 200.0, 1, 20170301, 20170331, 0),
        ("b", 1, 30, 50.0, 50.0, 0, 20171301, None, 0),
        ("x", 1, 30, 50.0, 50.0, 0, 20170101, 20170131, 0),
    ]
    df = spark.createDataFrame(
        rows, "customer_id string, payment_method_id int, payment_plan_days int, plan_list_price double, "
        "actual_amount_paid double, is_auto_renew int, transaction_date int, membership_expire_date int, is_cancel int",
    )
    return clean.clean_transactions(df, labels)


def test_transactions(transactions):
    got = _rows(transactions.filter("customer_id = 'a'"), "payment_method_id", "paid_per_day", "is_discounted",
                "transaction_month", "expire_month")
    assert got == [(1, 3.0, 1, "2017-01", "2017-02"), (1, 200 / 30, 0, "2017-03", "2017-03"), (2, 0.0, 0, "2017-01", "2017-02")]
    bad = transactions.filter("customer_id = 'b'").first()
    assert bad["transaction_month"] is None and bad["membership_expire_date_dt"] is None


def test_latest_transaction_tie_break(transactions):
    same_day = transactions.filter("transaction_month = '2017-01'")
    got = customer_month.latest_transaction(same_day).filter("customer_id = 'a'").first()
    assert (got["payment_method_id"], got["latest_is_cancel"]) == (2, 1)


@pytest.fixture(scope="module")
def activity(spark, labels):
    logs = spark.createDataFrame(
        [("a", 20170301, 1, 0, 0, 0, 3, 4, 60.0), ("a", 20170301, 0, 0, 0, 0, 1, 1, 40.0),
         ("a", 20170302, 0, 0, 0, 0, 0, 0, 0.0), ("c", 20170201, 0, 0, 0, 0, 0, 0, 0.0),
         ("x", 20170301, 9, 9, 9, 9, 9, 9, 9.0)],
        "customer_id string, date int, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, num_unq int, "
        "total_secs double",
    )
    return clean.user_logs_monthly(logs, labels)


def test_activity_counts_each_day_once(activity):
    got = {r["customer_id"]: r for r in activity.collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"]["active_days"], got["a"]["total_plays"], got["a"]["completion_rate_proxy"]) == (2, 5, 0.8)
    want = np.log1p(100) + 0.25 * np.log1p(5) + 0.5 * np.log1p(2)
    assert abs(got["a"]["engagement_score"] - want) < 1e-8
    assert got["c"]["completion_rate_proxy"] == 0.0


@pytest.fixture(scope="module")
def months(spark, labels, transactions, activity):
    members = spark.createDataFrame([("a", 1, 30.0, "male", 3)], "customer_id string, city int, age double, "
                                    "gender string, registered_via int").withColumn(
        "registration_date", F.to_date(F.lit("2016-12-31")))
    payments = customer_month.transaction_monthly(transactions)
    return customer_month.customer_month_table(payments, activity, members, labels, REFERENCE), members


def test_customer_months_union_gap_and_trends(months):
    table, _ = months
    got = {(r["customer_id"], r["snapshot_month"]): r for r in table.collect()}
    assert set(got) == {("a", "2017-01"), ("a", "2017-03"), ("c", "2017-02")}
    march = got["a", "2017-03"]
    assert march["tenure_months"] == 3 and march["lifecycle_stage"] == "Early lifecycle"
    assert march["prior_month_revenue"] == 190.0 and march["trailing_3mo_revenue"] == 390.0
    assert march["engagement_change_pct"] is None  # the prior month had no activity
    assert march["revenue_change_pct"] == pytest.approx(10 / 190)
    assert march["revenue_tier"] == "High revenue" and march["engagement_tier"] == "Medium engagement"
    february = got["c", "2017-02"]
    assert february["revenue_tier"] == k.NO_REVENUE and february["lifecycle_stage"] == k.UNKNOWN_TENURE


def test_snapshot_keeps_customers_without_any_month(spark, labels, transactions, months):
    table, members = months
    snap = customer_month.modeling_customer_snapshot(
        labels, customer_month.latest_customer_month(table), members,
        customer_month.latest_transaction(transactions), REFERENCE,
    )
    got = {r["customer_id"]: r for r in snap.collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["d"]["snapshot_month"] == k.NO_MONTH and got["d"]["monthly_revenue"] == 0
    assert got["d"]["tenure_months"] is None and got["d"]["no_recent_activity_flag"] == 1
    assert got["a"]["cancellation_signal_flag"] == 0 and got["a"]["snapshot_month"] == "2017-03"


# --- Evaluation against brute force -------------------------------------------------------------

def _brute_auc(y, s):
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    return ((pos > neg) + 0.5 * (pos == neg)).mean()


def _brute_average_precision(y, s):
    total, out, seen_recall = y.sum(), 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        chosen = s >= cut
        recall = y[chosen].sum() / total
        out += (recall - seen_recall) * y[chosen].mean()
        seen_recall = recall
    return out


def test_score_metrics_with_ties(spark, store):
    rng = random.Random(7)
    rows = [(f"c{i:04d}", round(rng.random(), 1), int(rng.random() < 0.3), 10.0, 1.0, 2.0) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id string, predicted_churn_probability double, actual_churn int, "
                               "profit_adjusted_clv_proxy double, future_churned_clv_proxy double, "
                               "monthly_value_baseline double").repartition(5)
    got = evaluate.score_metrics(evaluate.rank_scores(store, "brute", df)).first()
    y = np.array([r[2] for r in rows])
    s = np.array([r[1] for r in rows])
    safe = np.clip(s, 1e-6, 1 - 1e-6)
    assert got["roc_auc"] == pytest.approx(_brute_auc(y, s))
    assert got["pr_auc"] == pytest.approx(_brute_average_precision(y, s))
    assert got["brier_score"] == pytest.approx(((s - y) ** 2).mean())
    assert got["log_loss"] == pytest.approx(-(y * np.log(safe) + (1 - y) * np.log(1 - safe)).mean())
    assert got["accuracy_at_0_50"] == pytest.approx(((s >= 0.5) == y).mean())
    tp = ((s >= 0.5) & (y == 1)).sum()
    assert got["precision_at_0_50"] == pytest.approx(tp / (s >= 0.5).sum())
    assert got["f1_at_0_50"] == pytest.approx(2 * tp / ((s >= 0.5).sum() + y.sum()))


# --- Cohorts ---------------------------------------------------------------------------------------

def test_cohorts_keep_every_age(spark):
    months = spark.range(20).select(
        F.lit("c").alias("customer_id"), F.lit(1.0).alias("monthly_revenue"), F.lit(1).alias("churn_next_period"),
        F.lit(2.0).alias("engagement_score"), F.to_date(F.lit("2015-01-01")).alias("first_observed_month_date"),
        F.add_months(F.to_date(F.lit("2015-01-01")), F.col("id").cast("int")).alias("snapshot_month_date"),
    )
    long = cohort.cohort_retention_long(months)
    assert [r["months_since_first_observed"] for r in long.collect()] == list(range(20))
    assert cohort.cohort_heatmap(long).count() == 20
    assert cohort.cohort_retention_matrix(long, [0, 19]).columns == ["first_observed_month", "month_0", "month_19"]


# --- Survival ------------------------------------------------------------------------------------

def test_survival_reaches_zero_and_small_groups_are_left_out(spark):
    rows = [("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("g", 3, 1), ("h", 1, 0), ("g", 50, 0)]
    df = spark.createDataFrame(rows, "grp string, lifecycle_duration_months int, churn_event int")
    curve = lifecycle.survival_curve(df.filter("lifecycle_duration_months < 50"), ["grp"], REFERENCE, 2)
    got = [(r["month_index"], r["customers_at_risk"], round(r["survival_probability"], 6)) for r in curve.collect()]
    assert got == [(1, 4, 0.75), (2, 3, 0.75), (3, 2, 0.0)]
    long = lifecycle.survival_curve(df, ["grp"], REFERENCE, 2).collect()
    assert len(long) == 50  # the longest duration
    assert long[-1]["customers_at_risk"] == 1 and long[-1]["survival_probability"] == pytest.approx(0.8 * 1 / 3)
    hazard = lifecycle.monthly_hazard(df, REFERENCE).collect()
    assert len(hazard) == 50 and hazard[0]["customers_at_risk"] == 6 and hazard[49]["monthly_hazard_rate"] == 0


# --- Save-worthiness --------------------------------------------------------------------------------

ACTION_CASES = [
    # risk, value, budget, group, quadrant, clv, action
    (k.CRITICAL, k.ELITE_VALUE, k.NO_BUDGET, "x", k.QUADRANT_HH, 10.0, k.SUPPRESS),
    (k.CRITICAL, k.ELITE_VALUE, k.PREMIUM_BUDGET, "x", k.QUADRANT_HH, 0.0, k.SUPPRESS),
    (k.CRITICAL, k.HIGH_VALUE, k.PREMIUM_BUDGET, "Premium win-back", k.QUADRANT_HH, 10.0, k.PREMIUM_SAVE),
    (k.HIGH_RISK, k.ELITE_VALUE, k.PREMIUM_BUDGET, "Premium win-back", k.QUADRANT_HH, 10.0, k.WIN_BACK),
    (k.HIGH_RISK, k.ELITE_VALUE, k.PREMIUM_BUDGET, "x", k.QUADRANT_HH, 10.0, k.TARGETED),
    (k.HIGH_RISK, k.CORE_VALUE, k.MODERATE_BUDGET, "x", k.QUADRANT_REST, 10.0, k.NURTURE),
    (k.CRITICAL, k.LOW_VALUE, k.AUTOMATION_BUDGET, "x", k.QUADRANT_HL, 10.0, k.AUTOMATED),
    (k.LOW_RISK, k.ELITE_VALUE, k.PREMIUM_BUDGET, "x", k.QUADRANT_LH, 10.0, k.PROTECT),
    (k.MEDIUM_RISK, k.CORE_VALUE, k.LOW_COST_BUDGET, "x", k.QUADRANT_REST, 10.0, k.MONITOR),
]


def test_every_action_branch(spark):
    df = spark.createDataFrame(
        [(i, *case) for i, case in enumerate(ACTION_CASES)],
        "i int, churn_risk_tier string, clv_value_tier string, retention_budget_tier string, "
        "value_based_action_group string, value_risk_quadrant string, profit_adjusted_clv_proxy double, want string",
    )
    got = df.select("i", "want", save.recommended_action().alias("got")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def _saves(spark, rows):
    """(id, action, net, cost, p): the columns that the ranking and ROI steps read."""
    df = spark.createDataFrame(rows, "customer_id string, recommended_retention_action string, "
                               "net_save_value_proxy double, intervention_cost_proxy double, "
                               "predicted_churn_probability double")
    return df.withColumns({
        "expected_saved_clv_proxy": F.col("net_save_value_proxy") + F.col("intervention_cost_proxy"),
        "gross_value_at_risk_proxy": (F.col("net_save_value_proxy") + F.col("intervention_cost_proxy")) * 10,
        "expected_intervention_response_rate": F.lit(0.1),
        "profit_adjusted_clv_proxy": F.lit(100.0), "future_churned_clv_proxy": F.lit(1.0),
        "actual_future_churn_label": F.lit(1), "churn_risk_tier": F.lit(k.CRITICAL),
        "clv_value_tier": F.lit(k.ELITE_VALUE), "retention_budget_tier": F.lit(k.PREMIUM_BUDGET),
        "lifecycle_stage": F.lit("Established"), "engagement_tier": F.lit("x"), "revenue_tier": F.lit("x"),
        "should_receive_paid_offer": save.offer_eligibility(),
        "final_targeting_readout": F.lit("x"),
    })


def test_ranks_scores_and_ties(spark, store):
    df = _saves(spark, [("b", k.TARGETED, 5.0, 1.0, 0.5), ("a", k.TARGETED, 5.0, 1.0, 0.5),
                        ("c", k.PROTECT, 9.0, 2.0, 0.5), ("d", k.MONITOR, 0.0, 0.0, 0.5), ("e", k.TARGETED, -1.0, 4.0, 0.5)])
    out = save.rank_offers(store, df).withColumn("save_priority_tier", save.save_priority_tier())
    got = {r["customer_id"]: r for r in out.collect()}
    assert [got[c]["save_worthiness_rank"] for c in "cabde"] == [1, 2, 3, None, None]
    assert [got[c]["save_worthiness_score"] for c in "cabde"] == [100.0, 50.0, 0.0, 0.0, 0.0]
    assert [got[c]["cumulative_cost"] for c in "cab"] == [2.0, 3.0, 4.0]
    assert got["c"]["save_priority_tier"] == k.TIER_PROTECT  # wins over its first rank
    assert got["a"]["save_priority_tier"] == k.TIER_POOL and got["d"]["save_priority_tier"] == k.TIER_NONE


def test_single_and_empty_eligible_set(spark, store):
    one = save.rank_offers(store, _saves(spark, [("a", k.TARGETED, 5.0, 1.0, 0.5), ("b", k.MONITOR, 0.0, 0.0, 0.5)]))
    assert {r["customer_id"]: r["save_worthiness_score"] for r in one.collect()} == {"a": 100.0, "b": 0.0}
    none = save.rank_offers(store, _saves(spark, [("b", k.MONITOR, 0.0, 0.0, 0.5)]))
    ranked = none.withColumn("save_priority_tier", save.save_priority_tier())
    assert save.save_worthiness_deciles(ranked).count() == 0
    frontier = roi.budget_cap_frontier(ranked, REFERENCE).collect()
    assert [r["targeted_customers"] for r in frontier] == [0] * 7
    # One readout for caps that buy nothing, another as soon as one buys.
    bought = roi.budget_cap_frontier(one.withColumn("save_priority_tier", save.save_priority_tier()), REFERENCE).collect()
    assert {r["marginal_readout"] for r in frontier}.isdisjoint(r["marginal_readout"] for r in bought)
    assert [r["targeted_customers"] for r in bought] == [1] * 7
    matrix = roi.strategy_scenario_matrix(ranked, REFERENCE)
    assert {r["budget_status"] for r in matrix.collect()} == {"No targets"}
    assert matrix.count() == 12 * 5
    assert roi.efficient_budget(roi.budget_cap_frontier(ranked, REFERENCE)).first()["budget_cap"] == 100_000


def test_response_is_clipped_and_costs_scale(spark, store):
    df = _saves(spark, [("a", k.TARGETED, 5.0, 1.0, 0.5)]).withColumn("expected_intervention_response_rate", F.lit(0.5))
    cells = roi.strategy_cells(
        save.rank_offers(store, df).withColumn("save_priority_tier", F.lit("x")), [("s", F.lit(True))])
    plans = spark.createDataFrame([("s", 1.5, 2.0, 1.0)], "strategy_name string, response_multiplier double, "
                                  "cost_multiplier double, budget_cap double")
    got = roi.roi_metrics(cells, ["strategy_name"], plans).first()
    assert got["adjusted_expected_response_rate"] == 0.6
    assert got["expected_saved_clv_proxy"] == pytest.approx(36.0) and got["campaign_cost_proxy"] == 2.0
    assert got["budget_status"] == "Positive ROI but over budget"


# --- Experiment -----------------------------------------------------------------------------------------

def test_assignment_halves_every_stratum_and_repeats(spark, store):
    rows = [(f"c{i:03d}", k.TARGETED, float(1000 - i), 1.0, 0.5) for i in range(60)]
    saves = save.rank_offers(store, _saves(spark, rows)).withColumn(
        "save_priority_tier", F.when(F.col("save_worthiness_rank") == 1, "alone").otherwise("crowd"))
    budget = spark.createDataFrame([(40.0, 1.0, 40)], "budget_cap double, net_value_capture_vs_max double, targeted_customers int")
    first = abtest.candidate_population(store, saves, budget, REFERENCE)
    again = abtest.candidate_population(store, saves.repartition(3), budget, REFERENCE)
    assert _rows(first, "customer_id", "experiment_group") == _rows(again, "customer_id", "experiment_group")
    counts = {tuple(r)[:2]: r["count"] for r in first.groupBy("save_priority_tier", "experiment_group").count().collect()}
    assert counts == {("alone", k.TREATMENT): 1, ("crowd", k.TREATMENT): 20, ("crowd", k.CONTROL): 19}
    broke = spark.createDataFrame([(0.5, 0.0, 0)], budget.schema)
    assert abtest.experiment_population(saves, broke, REFERENCE).count() == 0
    assert abtest.experiment_population(saves, broke, replace(REFERENCE, fallback_test_rows=7)).count() == 7


# --- Sources ------------------------------------------------------------------------------------------

def test_raw_csv_reader(spark, tmp_path):
    (tmp_path / "train_v2.csv").write_text("msno,is_churn\na,1\nb,0\n")
    (tmp_path / "members_v3.csv").write_text("msno,city,bd,gender,registered_via,registration_init_time\na,1,20,,3,20160101\n")
    (tmp_path / "transactions_v2.csv").write_text(
        "msno,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,is_auto_renew,transaction_date,"
        "membership_expire_date,is_cancel\na,1,30,149,149,1,20170301,20170331,0\n")
    (tmp_path / "user_logs_v2.csv").write_text(
        "msno,date,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs\na,20170302,1,0,0,0,5,6,100.5\n")
    tables = raw.read_raw_csv(spark, str(tmp_path))
    from holdfast.plans.engine import RetentionEngine

    engine = RetentionEngine(spark, tables, REFERENCE)
    got = {r["customer_id"]: r for r in engine.table("snapshot").collect()}
    assert got["a"]["monthly_revenue"] == 149.0 and got["a"]["active_days"] == 1
    assert got["b"]["snapshot_month"] == k.NO_MONTH


@pytest.mark.parametrize("most_words", [1 << 22, 1])
def test_payments_of_a_hot_customer_are_kept_whole(spark, monkeypatch, most_words):
    """A filter that is far too small only lets more through."""
    monkeypatch.setattr(clean, "MOST_WORDS", most_words)
    rows = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 5 = 0 then null else concat('c', id % 200) end as customer_id", "id as n"
    ).repartition(9)
    labels = spark.createDataFrame([("hot", 1), *((f"c{i}", 0) for i in range(0, 200, 3)), ("absent", 0)], "customer_id string, is_churn int")
    kept = clean.keep_labelled_spread(rows, labels, labels.count())
    want = clean.keep_labelled(rows, labels)
    assert kept.columns == want.columns
    assert kept.count() == want.count() > 1000 and kept.exceptAll(want).count() == 0
    through = clean.maybe_labelled(rows, labels, labels.count()).count()
    assert kept.count() <= through and (most_words == 1 or through < 1.2 * kept.count())
    assert kept.withColumn("part", F.spark_partition_id()).filter("customer_id = 'hot'").select("part").distinct().count() > 1
