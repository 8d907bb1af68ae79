"""Descriptive cohort and segment views of churn and revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import Profile
from holdfast.functions.columns import (
    calendar_months, first_match, mean, month_text, ratio, summarise, total, total_where, top_pick,
)

#: Columns of the wide form; the long form and the heat map hold every age.
MATRIX_AGES = tuple(range(13))


def _churned():
    return F.col("churn_next_period") == 1


def _revenue_metrics() -> dict:
    return {
        "customers": F.count("*"),
        "churn_rate": mean("churn_next_period"),
        "total_monthly_revenue_proxy": total("monthly_revenue"),
        "avg_monthly_revenue_proxy": mean("monthly_revenue"),
        "future_churned_revenue_proxy": total_where(_churned(), "monthly_revenue"),
        "avg_engagement_score": mean("engagement_score"),
    }


def monthly_revenue_leakage(customer_month: DataFrame) -> DataFrame:
    """The table has one row per customer and month, so a plain count counts customers."""
    return summarise(customer_month, ["snapshot_month"], {
        "observed_customers": F.count("customer_id"),
        "total_monthly_revenue_proxy": total("monthly_revenue"),
        "avg_monthly_revenue_proxy": mean("monthly_revenue"),
        "future_churn_label_rate": mean("churn_next_period"),
        "future_churned_revenue_proxy": total_where(_churned(), "monthly_revenue"),
        "avg_engagement_score": mean("engagement_score"),
        "avg_active_days": mean("active_days"),
        "auto_renew_rate": mean("is_auto_renew"),
        "cancel_signal_rate": mean("had_cancel"),
    }).orderBy("snapshot_month")


def customer_first_month(customer_month: DataFrame) -> DataFrame:
    """One row per customer: the month row that is its own first observed month."""
    first = customer_month.filter(F.col("snapshot_month_date") == F.col("first_observed_month_date"))
    return first.select(
        "customer_id", "first_observed_month_date",
        F.col("snapshot_month").alias("first_observed_month"),
    )


def cohort_sizes(customer_month: DataFrame) -> DataFrame:
    return customer_first_month(customer_month).groupBy(
        "first_observed_month", "first_observed_month_date"
    ).agg(F.count("customer_id").alias("cohort_size"))


def cohort_retention_long(customer_month: DataFrame) -> DataFrame:
    """Cohort x months since first seen, in one aggregate: every member of a cohort is observed in
    month 0, so the cohort size is that cell, spread over the (small) aggregated table."""
    age = calendar_months("first_observed_month_date", "snapshot_month_date")
    cells = summarise(
        customer_month.withColumn("months_since_first_observed", age)
        .withColumn("first_observed_month", month_text("first_observed_month_date")),
        ["first_observed_month", "months_since_first_observed"],
        {
            "observed_users": F.count("customer_id"),
            "cohort_monthly_revenue_proxy": total("monthly_revenue"),
            "future_churned_revenue_proxy": total_where(_churned(), "monthly_revenue"),
            "future_churn_label_rate": mean("churn_next_period"),
            "avg_engagement_score": mean("engagement_score"),
        },
    )
    sizes = cells.filter(F.col("months_since_first_observed") == 0).select(
        "first_observed_month", F.col("observed_users").alias("cohort_size")
    )
    return cells.join(sizes, "first_observed_month").select(
        "first_observed_month",
        "months_since_first_observed",
        "cohort_size",
        "observed_users",
        ratio("observed_users", "cohort_size").alias("observed_retention_rate"),
        "cohort_monthly_revenue_proxy",
        "future_churned_revenue_proxy",
        "future_churn_label_rate",
        "avg_engagement_score",
    ).orderBy("first_observed_month", "months_since_first_observed")


def cohort_retention_matrix(cohort_long: DataFrame, ages: Sequence[int] = MATRIX_AGES) -> DataFrame:
    """One column per age in ``ages``, which the caller lists as a fixed schema."""
    months = list(ages)
    wide = cohort_long.groupBy("first_observed_month").pivot(
        "months_since_first_observed", months
    ).agg(F.avg("observed_retention_rate"))
    return wide.select(
        "first_observed_month", *(F.col(str(m)).alias(f"month_{m}") for m in months)
    ).orderBy("first_observed_month")


def cohort_heatmap(cohort_long: DataFrame) -> DataFrame:
    return cohort_long.select(
        F.col("first_observed_month").alias("cohort_month"), "months_since_first_observed",
        "cohort_size", "observed_users", "observed_retention_rate",
    )


def _by(snapshot: DataFrame, keys: list[str], extra: dict, min_rows: int | None = None) -> DataFrame:
    return summarise(snapshot, keys, {**_revenue_metrics(), **extra}, min_rows)


def engagement_tier_churn_revenue(snapshot: DataFrame) -> DataFrame:
    return _by(snapshot, ["engagement_tier"], {
        "avg_active_days": mean("active_days"),
        "no_recent_activity_rate": mean("no_recent_activity_flag"),
        "major_activity_drop_rate": mean("major_activity_drop_flag"),
    }).orderBy(F.desc("future_churned_revenue_proxy"), "engagement_tier")


def revenue_tier_churn_revenue(snapshot: DataFrame) -> DataFrame:
    return _by(snapshot, ["revenue_tier"], {
        "discount_exposure_rate": mean("had_discount"),
        "auto_renew_rate": mean("is_auto_renew"),
    }).orderBy(F.desc("future_churned_revenue_proxy"), "revenue_tier")


def lifecycle_stage_churn_revenue(snapshot: DataFrame) -> DataFrame:
    return _by(snapshot, ["lifecycle_stage"], {
        "avg_tenure_months": mean("tenure_months"),
        "cancellation_signal_rate": mean("cancellation_signal_flag"),
    }).orderBy(F.desc("future_churned_revenue_proxy"), "lifecycle_stage")


def registered_channel_churn_revenue(snapshot: DataFrame) -> DataFrame:
    return _by(snapshot, ["registered_via"], {
        "auto_renew_rate": mean("is_auto_renew"),
    }).orderBy(F.desc("future_churned_revenue_proxy"), "registered_via")


def retention_risk_segment_matrix(snapshot: DataFrame, p: Profile) -> DataFrame:
    keys = ["lifecycle_stage", "engagement_tier", "revenue_tier"]
    return _by(snapshot, keys, {
        "avg_active_days": mean("active_days"),
        "cancellation_signal_rate": mean("cancellation_signal_flag"),
        "major_activity_drop_rate": mean("major_activity_drop_flag"),
    }, p.min_segment_rows).orderBy(F.desc("future_churned_revenue_proxy"), F.desc("churn_rate"), *keys)


def retention_focus():
    revenue, engagement = F.col("revenue_tier"), F.col("engagement_tier")
    cancelled, churn = F.col("latest_is_cancel"), F.col("churn_rate")
    return first_match(
        [
            ((cancelled == 1) & revenue.isin("High revenue", "Medium revenue"),
             "Win-back recovery candidate"),
            ((revenue == "High revenue") & (churn >= 0.10) & (cancelled == 0),
             "High-priority retention candidate"),
            ((engagement == "No observed activity") & (churn >= 0.10),
             "Low-cost reactivation candidate"),
            (F.col("lifecycle_stage").isin("New customer", "Early lifecycle")
             & engagement.isin("No observed activity", "Low engagement"),
             "Onboarding intervention candidate"),
            ((churn < 0.05) & (revenue == "High revenue"), "Monitor and protect"),
        ],
        "Standard retention monitoring",
    )


def high_value_at_risk_segments(snapshot: DataFrame, p: Profile) -> DataFrame:
    keys = ["lifecycle_stage", "engagement_tier", "revenue_tier", "latest_is_auto_renew", "latest_is_cancel"]
    segments = _by(snapshot, keys, {
        "major_activity_drop_rate": mean("major_activity_drop_flag"),
        "cancellation_signal_rate": mean("cancellation_signal_flag"),
    }, p.min_segment_rows)
    score = F.col("future_churned_revenue_proxy") * (1 + F.col("cancellation_signal_rate"))
    return segments.withColumns({
        "revenue_recovery_priority_score": score,
        "recommended_retention_focus": retention_focus(),
    }).orderBy(F.desc("revenue_recovery_priority_score"), *keys).limit(p.top_segments)


def cohort_headline(monthly: DataFrame, by_engagement: DataFrame, by_stage: DataFrame,
                    segments: DataFrame) -> DataFrame:
    """Top picks of the cohort tables; each side is a handful of rows reduced to one."""
    latest = monthly.agg(F.max_by(F.struct("*"), "snapshot_month").alias("m")).select(
        F.col("m.snapshot_month").alias("latest_observed_month"),
        F.col("m.observed_customers").alias("latest_observed_customers"),
        F.col("m.future_churn_label_rate").alias("latest_month_future_churn_label_rate"),
        F.col("m.future_churned_revenue_proxy").alias("latest_month_future_churned_revenue_proxy"),
    )
    lost = "future_churned_revenue_proxy"
    tier = top_pick(by_engagement, lost, {"highest_future_churned_revenue_engagement_tier": "engagement_tier"})
    stage = top_pick(by_stage, lost, {"highest_future_churned_revenue_lifecycle_stage": "lifecycle_stage"})
    top = top_pick(segments, "revenue_recovery_priority_score", {f"top_segment_{c}": c for c in (
        "lifecycle_stage", "engagement_tier", "revenue_tier", "customers", "churn_rate", lost,
        "recommended_retention_focus",
    )})
    return latest.crossJoin(tier).crossJoin(stage).crossJoin(top)
