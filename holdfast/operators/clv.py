"""Profit-adjusted customer lifetime value and its summaries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import clip, first_match, mean, summarise, total, top_pick
from holdfast.operators.ranking import Key, ntile_edges, number_rows
from holdfast.plans.store import TableStore, run_together

SEGMENT = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier"]
FULL_SEGMENT = [*SEGMENT, "value_based_action_group", "retention_budget_tier"]

OUTPUT_COLUMNS = (
    "customer_id", "churn_next_period", "snapshot_month", "snapshot_month_date",
    "city", "age", "gender", "registered_via", "registration_date", "tenure_months", "lifecycle_stage",
    "transaction_count", "monthly_revenue", "monthly_list_price", "monthly_discount_amount",
    "avg_plan_days", "max_plan_days", "avg_paid_per_day", "is_auto_renew", "had_cancel", "had_discount",
    "latest_payment_plan_days", "latest_plan_list_price", "latest_actual_amount_paid",
    "latest_is_auto_renew", "latest_is_cancel", "latest_transaction_date_raw",
    "latest_membership_expire_date_raw",
    "active_days", "total_secs", "total_plays", "num_unq", "completion_rate_proxy", "engagement_score",
    "trailing_3mo_engagement_score", "trailing_3mo_revenue", "trailing_3mo_active_days",
    "engagement_change_pct", "activity_change_pct", "revenue_change_pct",
    "engagement_tier", "revenue_tier",
    "no_recent_activity_flag", "cancellation_signal_flag", "major_activity_drop_flag",
    "monthly_value_baseline", "engagement_value_baseline", "auto_renew_signal", "cancellation_signal",
    "monthly_value_decile", "engagement_decile", "gross_margin_rate", "expected_active_months_proxy",
    "monthly_margin_baseline", "annual_revenue_run_rate_proxy", "annual_margin_run_rate_proxy",
    "profit_adjusted_clv_proxy", "future_churned_clv_proxy",
    "clv_value_tier", "value_based_action_group", "retention_budget_tier",
)


def value_baselines(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumns({
        "monthly_value_baseline": F.greatest(
            "monthly_revenue", F.col("trailing_3mo_revenue") / 3, "latest_actual_amount_paid"
        ),
        "engagement_value_baseline": F.greatest("engagement_score", "trailing_3mo_engagement_score"),
        "auto_renew_signal": F.greatest("is_auto_renew", "latest_is_auto_renew"),
        "cancellation_signal": F.greatest("had_cancel", "latest_is_cancel", "cancellation_signal_flag"),
    })


def value_deciles(store: TableStore, baselines: DataFrame) -> DataFrame:
    """Global deciles of monthly value and of engagement; the wide table is never shuffled."""
    def decile(measure: str) -> Column:
        ranked = number_rows(
            store, measure, baselines.select(measure, "customer_id"), [Key(measure), Key("customer_id")]
        )
        return ranked.bucket(ntile_edges(ranked.rows, 10))

    value, engagement = run_together([
        partial(decile, "monthly_value_baseline"), partial(decile, "engagement_value_baseline")
    ])
    return baselines.withColumns({"monthly_value_decile": value, "engagement_decile": engagement})


def expected_active_months(p: Profile) -> Column:
    a = p.clv
    tenure = F.coalesce("tenure_months", F.lit(0))
    loyalty = first_match(
        [(tenure >= 24, a.long_tenure_bonus), (tenure >= 6, a.established_bonus)], 0.0
    )
    months = (
        F.lit(a.base_months)
        + F.lit(a.engagement_weight) * F.col("engagement_decile")
        + F.when(F.col("auto_renew_signal") == 1, a.auto_renew_bonus).otherwise(0.0)
        + loyalty
        + F.when(F.col("cancellation_signal") == 1, a.cancellation_penalty).otherwise(0.0)
        + F.when(F.col("major_activity_drop_flag") == 1, a.activity_drop_penalty).otherwise(0.0)
    )
    return clip(months, 1.0, a.max_months)


def with_clv(df: DataFrame, p: Profile) -> DataFrame:
    margin, baseline = F.lit(p.clv.margin), F.col("monthly_value_baseline")
    clv = baseline * margin * F.col("expected_active_months_proxy")
    return df.withColumn("expected_active_months_proxy", expected_active_months(p)).withColumns({
        "gross_margin_rate": margin,
        "monthly_margin_baseline": baseline * margin,
        "annual_revenue_run_rate_proxy": baseline * 12,
        "annual_margin_run_rate_proxy": baseline * 12 * margin,
        "profit_adjusted_clv_proxy": clv,
        "future_churned_clv_proxy": F.when(F.col("churn_next_period") == 1, clv).otherwise(0.0),
    })


def _worthless() -> Column:
    return F.col("monthly_value_baseline") <= 0


def clv_value_tier() -> Column:
    decile = F.col("monthly_value_decile")
    return first_match(
        [(_worthless(), k.NO_VALUE), (decile >= 9, k.ELITE_VALUE), (decile >= 7, k.HIGH_VALUE),
         (decile >= 4, k.CORE_VALUE)],
        k.LOW_VALUE,
    )


def value_based_action_group() -> Column:
    decile = F.col("monthly_value_decile")
    return first_match(
        [
            (_worthless(), "Suppress paid offer"),
            ((decile >= 9) & (F.col("cancellation_signal") == 1), "Premium win-back"),
            ((decile >= 9) & (F.col("no_recent_activity_flag") == 1), "High-value reactivation"),
            (decile >= 9, "Protect high-value customer"),
            ((decile >= 7) & (F.col("major_activity_drop_flag") == 1), "Save intervention candidate"),
            (decile >= 7, "Targeted retention nurture"),
            (decile <= 3, "Low-cost automated retention"),
        ],
        "Standard lifecycle nurture",
    )


def retention_budget_tier() -> Column:
    decile = F.col("monthly_value_decile")
    return first_match(
        [(_worthless(), k.NO_BUDGET), (decile >= 9, k.PREMIUM_BUDGET), (decile >= 7, k.MODERATE_BUDGET),
         (decile >= 4, k.LOW_COST_BUDGET)],
        k.AUTOMATION_BUDGET,
    )


def with_value_tiers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "clv_value_tier": clv_value_tier(),
        "value_based_action_group": value_based_action_group(),
        "retention_budget_tier": retention_budget_tier(),
    })


def customer_clv_scores(deciled: DataFrame, p: Profile) -> DataFrame:
    return with_value_tiers(with_clv(deciled, p)).select(*OUTPUT_COLUMNS)


# --- Summaries ----------------------------------------------------------------------------

def _core() -> dict:
    return {
        "customers": F.count("*"),
        "future_churn_rate": mean("churn_next_period"),
        "total_profit_adjusted_clv_proxy": total("profit_adjusted_clv_proxy"),
        "future_churned_clv_proxy": total("future_churned_clv_proxy"),
    }


def _signals() -> dict:
    return {
        "avg_engagement_score": mean("engagement_score"),
        "auto_renew_rate": mean("auto_renew_signal"),
        "cancellation_signal_rate": mean("cancellation_signal"),
    }


AVG_VALUE = {"avg_monthly_value_baseline": "monthly_value_baseline",
             "avg_profit_adjusted_clv_proxy": "profit_adjusted_clv_proxy"}


def _averages(names: dict[str, str]) -> dict:
    return {alias: mean(c) for alias, c in names.items()}


def portfolio_clv_summary(clv: DataFrame) -> DataFrame:
    return summarise(clv, [], {
        **_core(),
        "total_monthly_value_baseline": total("monthly_value_baseline"),
        "total_monthly_margin_baseline": total("monthly_margin_baseline"),
        "annual_revenue_run_rate_proxy": total("annual_revenue_run_rate_proxy"),
        "annual_margin_run_rate_proxy": total("annual_margin_run_rate_proxy"),
        "avg_profit_adjusted_clv_proxy": mean("profit_adjusted_clv_proxy"),
        "avg_expected_active_months_proxy": mean("expected_active_months_proxy"),
    })


def clv_value_tier_summary(clv: DataFrame) -> DataFrame:
    return summarise(clv, ["clv_value_tier"], {
        **_core(), **_averages(AVG_VALUE), **_signals(),
        "avg_monthly_margin_baseline": mean("monthly_margin_baseline"),
        "avg_expected_active_months_proxy": mean("expected_active_months_proxy"),
    }).orderBy(F.desc("total_profit_adjusted_clv_proxy"), "clv_value_tier")


def clv_segment_summary(clv: DataFrame, p: Profile) -> DataFrame:
    return summarise(clv, SEGMENT, {
        **_core(), **_averages(AVG_VALUE), **_signals(), "avg_active_days": mean("active_days"),
    }, p.min_segment_rows).orderBy(F.desc("future_churned_clv_proxy"), *SEGMENT)


def value_based_action_group_summary(clv: DataFrame) -> DataFrame:
    keys = ["value_based_action_group", "retention_budget_tier"]
    return summarise(clv, keys, {**_core(), **_averages(AVG_VALUE), **_signals()}).orderBy(
        F.desc("future_churned_clv_proxy"), *keys
    )


def high_value_recovery_targets(clv: DataFrame, p: Profile) -> DataFrame:
    return clv.filter(F.col("clv_value_tier").isin(*k.TOP_VALUE)).select(
        "customer_id", "churn_next_period", "snapshot_month", "lifecycle_stage", "engagement_tier",
        "revenue_tier", "clv_value_tier", "value_based_action_group", "retention_budget_tier",
        "monthly_value_baseline", "monthly_margin_baseline", "expected_active_months_proxy",
        "profit_adjusted_clv_proxy", "future_churned_clv_proxy", "engagement_score", "active_days",
        "auto_renew_signal", "cancellation_signal", "no_recent_activity_flag", "major_activity_drop_flag",
    ).orderBy(
        F.desc("future_churned_clv_proxy"), F.desc("profit_adjusted_clv_proxy"), "customer_id"
    )


def clv_segment_matrix(clv: DataFrame, p: Profile) -> DataFrame:
    return summarise(clv, FULL_SEGMENT, {
        **_core(), **_signals(), "total_monthly_value_baseline": total("monthly_value_baseline"),
    }, p.min_export_rows).orderBy(F.desc("future_churned_clv_proxy"), *FULL_SEGMENT)


def clv_top_sample(clv: DataFrame, p: Profile) -> DataFrame:
    return clv.orderBy(F.desc("profit_adjusted_clv_proxy"), "customer_id").limit(p.sample_rows)


def clv_headline(portfolio: DataFrame, tiers: DataFrame, actions: DataFrame, clv: DataFrame) -> DataFrame:
    top_tier = top_pick(tiers, "total_profit_adjusted_clv_proxy", {
        "top_value_tier_by_total_clv": "clv_value_tier",
        "top_value_tier_customers": "customers",
        "top_value_tier_future_churn_rate": "future_churn_rate",
    })
    top_action = top_pick(actions, "future_churned_clv_proxy", {
        "top_action_group_by_future_churned_clv": "value_based_action_group",
        "top_action_group_customers": "customers",
        "top_action_group_future_churned_clv_proxy": "future_churned_clv_proxy",
    })
    target = clv.filter(F.col("clv_value_tier").isin(*k.TOP_VALUE)).orderBy(
        F.desc("future_churned_clv_proxy"), F.desc("profit_adjusted_clv_proxy"), "customer_id"
    ).limit(1).select(*(F.col(c).alias(f"top_target_{c}") for c in (
        "customer_id", "clv_value_tier", "value_based_action_group", "profit_adjusted_clv_proxy",
        "future_churned_clv_proxy",
    )))
    base = portfolio.select(
        "customers", "future_churn_rate", "annual_revenue_run_rate_proxy", "annual_margin_run_rate_proxy",
        "total_profit_adjusted_clv_proxy", "future_churned_clv_proxy",
    )
    return base.crossJoin(top_tier).crossJoin(top_action).crossJoin(target)  # one-row sides
