"""Customer x month table and the one-row-per-customer snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import (
    bands, calendar_months, flag, large_side, month_start, ratio,
)

KEYS = ["customer_id", "snapshot_month"]
PAYMENT_COLUMNS = (
    "transaction_count", "monthly_revenue", "monthly_list_price", "monthly_discount_amount",
    "avg_plan_days", "max_plan_days", "avg_paid_per_day", "is_auto_renew", "had_cancel", "had_discount",
)
PAYMENT_DATES = ("latest_transaction_date", "latest_membership_expire_date")
ACTIVITY_COLUMNS = (
    "active_days", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs",
    "total_plays", "completion_rate_proxy", "engagement_score",
)
MEMBER_COLUMNS = ("city", "age", "gender", "registered_via", "registration_date")
TREND_COLUMNS = (
    "prior_month_engagement_score", "prior_month_total_secs", "prior_month_revenue",
    "trailing_3mo_engagement_score", "trailing_3mo_revenue", "trailing_3mo_active_days",
    "engagement_change_pct", "activity_change_pct", "revenue_change_pct",
)
# Per-customer facts that come out of the same window shuffle and spare later self-joins.
HELPER_COLUMNS = ("is_latest_month", "first_observed_month_date", "observed_month_number")
LATEST_PAYMENT = (
    ("payment_method_id", "payment_method_id"),
    ("payment_plan_days", "latest_payment_plan_days"),
    ("plan_list_price", "latest_plan_list_price"),
    ("actual_amount_paid", "latest_actual_amount_paid"),
    ("is_auto_renew", "latest_is_auto_renew"),
    ("is_cancel", "latest_is_cancel"),
)


def transaction_monthly(transactions: DataFrame) -> DataFrame:
    dated = transactions.filter(F.col("transaction_month").isNotNull())
    return dated.groupBy("customer_id", F.col("transaction_month").alias("snapshot_month")).agg(
        F.count("*").alias("transaction_count"),
        F.sum("actual_amount_paid").alias("monthly_revenue"),
        F.sum("plan_list_price").alias("monthly_list_price"),
        F.sum("discount_amount").alias("monthly_discount_amount"),
        F.avg("payment_plan_days").alias("avg_plan_days"),
        F.max("payment_plan_days").alias("max_plan_days"),
        F.avg("paid_per_day").alias("avg_paid_per_day"),
        F.max("is_auto_renew").alias("is_auto_renew"),
        F.max("is_cancel").alias("had_cancel"),
        F.max("is_discounted").alias("had_discount"),
        F.max("transaction_date_dt").alias("latest_transaction_date"),
        F.max("membership_expire_date_dt").alias("latest_membership_expire_date"),
    )


def customer_month_keys(payments: DataFrame, activity: DataFrame) -> DataFrame:
    active = activity.filter(F.col("activity_month").isNotNull()).select(
        "customer_id", F.col("activity_month").alias("snapshot_month")
    )
    return payments.select(*KEYS).union(active).distinct()


def customer_month_base(payments: DataFrame, activity: DataFrame, members: DataFrame, labels: DataFrame,
                        dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Every month with a payment or activity, with member attributes and the label.

    The full outer join of the two monthly aggregates replaces "union of keys, then two left
    joins": both sides are already hashed on its keys by their own aggregation.  ``dealt`` brings the months to
    their customers once, as the tables of members and labels are; joins and windows then find them there.
    """
    active = activity.filter(F.col("activity_month").isNotNull()).withColumnRenamed(
        "activity_month", "snapshot_month"
    )
    months = dealt(payments.join(active, KEYS, "full_outer"))
    per_customer = months.join(large_side(members), "customer_id", "left").join(
        large_side(labels.withColumnRenamed("is_churn", "churn_next_period")), "customer_id", "left"
    )
    month_date = month_start("snapshot_month")
    return per_customer.select(
        *KEYS,
        month_date.alias("snapshot_month_date"),
        *MEMBER_COLUMNS,
        calendar_months("registration_date", month_date).alias("tenure_months"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in PAYMENT_COLUMNS),
        *PAYMENT_DATES,
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ACTIVITY_COLUMNS),
        "churn_next_period",
    )


def customer_month_features(base: DataFrame) -> DataFrame:
    """Previous and trailing-three *observed* months; one shuffle serves all windows.

    A window group holds the months of one customer, so its size is bounded by the calendar.
    """
    months = Window.partitionBy("customer_id").orderBy("snapshot_month_date")
    last_three = months.rowsBetween(-2, 0)
    return base.withColumns({
        "prior_month_engagement_score": F.lag("engagement_score").over(months),
        "prior_month_total_secs": F.lag("total_secs").over(months),
        "prior_month_revenue": F.lag("monthly_revenue").over(months),
        "trailing_3mo_engagement_score": F.avg("engagement_score").over(last_three),
        "trailing_3mo_revenue": F.sum("monthly_revenue").over(last_three),
        "trailing_3mo_active_days": F.sum("active_days").over(last_three),
        "is_latest_month": F.lead("snapshot_month_date").over(months).isNull(),
        "first_observed_month_date": F.first("snapshot_month_date").over(months),
        "observed_month_number": F.row_number().over(months),
    })


def change_ratio(current: str, prior: str) -> Column:
    return ratio(F.col(current) - F.col(prior), prior)


def engagement_tier(p: Profile) -> Column:
    score = F.col("engagement_score")
    return F.when(score == 0, k.NO_ACTIVITY).otherwise(bands(score, p.engagement_cuts, k.ENGAGEMENT_TIERS))


def revenue_tier(p: Profile) -> Column:
    paid = F.col("monthly_revenue")
    return F.when(paid == 0, k.NO_REVENUE).otherwise(bands(paid, p.revenue_cuts, k.REVENUE_TIERS))


def lifecycle_stage(p: Profile) -> Column:
    tenure = F.col("tenure_months")
    return F.when(tenure.isNull(), k.UNKNOWN_TENURE).otherwise(bands(tenure, p.tenure_cuts, k.LIFECYCLE_STAGES))


def with_change_and_tiers(features: DataFrame, p: Profile) -> DataFrame:
    return features.withColumns({
        "engagement_change_pct": change_ratio("engagement_score", "prior_month_engagement_score"),
        "activity_change_pct": change_ratio("total_secs", "prior_month_total_secs"),
        "revenue_change_pct": change_ratio("monthly_revenue", "prior_month_revenue"),
        "engagement_tier": engagement_tier(p),
        "revenue_tier": revenue_tier(p),
        "lifecycle_stage": lifecycle_stage(p),
    })


def customer_month_table(payments: DataFrame, activity: DataFrame, members: DataFrame,
                         labels: DataFrame, p: Profile) -> DataFrame:
    base = customer_month_base(payments, activity, members, labels)
    return with_change_and_tiers(customer_month_features(base), p)


def latest_customer_month(customer_month: DataFrame) -> DataFrame:
    return customer_month.filter("is_latest_month").drop(*HELPER_COLUMNS)


def latest_transaction(transactions: DataFrame) -> DataFrame:
    """Latest payment per customer; ties fall to the remaining columns, all descending.

    ``max`` over a struct combines map-side, unlike a per-customer row number, so one very
    active customer cannot overload a task.
    """
    row = F.struct("transaction_date_dt", "membership_expire_date_dt", *(c for c, _ in LATEST_PAYMENT))
    last = transactions.groupBy("customer_id").agg(F.max(row).alias("row"))
    return last.select(
        "customer_id",
        *(F.col(f"row.{c}").alias(name) for c, name in LATEST_PAYMENT),
        F.col("row.transaction_date_dt").alias("latest_transaction_date_raw"),
        F.col("row.membership_expire_date_dt").alias("latest_membership_expire_date_raw"),
    )


def snapshot_flags() -> dict[str, Column]:
    """Evaluated on the defaulted columns of the snapshot."""
    return {
        "no_recent_activity_flag": flag(F.col("engagement_score") == 0),
        "cancellation_signal_flag": flag((F.col("had_cancel") == 1) | (F.col("latest_is_cancel") == 1)),
        "major_activity_drop_flag": flag(F.col("activity_change_pct") <= -0.5),
    }


def modeling_customer_snapshot(labels: DataFrame, latest_month: DataFrame, members: DataFrame,
                               latest_payment: DataFrame, p: Profile) -> DataFrame:
    """One row per labelled customer, observed or not.  All joins share the customer key."""
    month = latest_month.drop(*MEMBER_COLUMNS, "churn_next_period", *PAYMENT_DATES)
    joined = (
        labels.withColumnRenamed("is_churn", "churn_next_period")
        .join(large_side(month), "customer_id", "left")
        .join(large_side(members), "customer_id", "left")
        .join(large_side(latest_payment), "customer_id", "left")
    )
    fallback = calendar_months("registration_date", F.to_date(F.lit(p.snapshot_date)))
    zeros = (*PAYMENT_COLUMNS, *ACTIVITY_COLUMNS, *TREND_COLUMNS)
    latest_zeros = [name for _, name in LATEST_PAYMENT if name != "payment_method_id"]
    filled = joined.select(
        "customer_id",
        "churn_next_period",
        F.coalesce("snapshot_month", F.lit(k.NO_MONTH)).alias("snapshot_month"),
        "snapshot_month_date",
        *MEMBER_COLUMNS,
        F.coalesce("tenure_months", fallback).alias("tenure_months"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in zeros),
        F.coalesce("engagement_tier", F.lit(k.NO_ACTIVITY)).alias("engagement_tier"),
        F.coalesce("revenue_tier", F.lit(k.NO_REVENUE)).alias("revenue_tier"),
        F.coalesce("lifecycle_stage", F.lit(k.UNKNOWN_TENURE)).alias("lifecycle_stage"),
        "payment_method_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in latest_zeros),
        "latest_transaction_date_raw",
        "latest_membership_expire_date_raw",
    )
    return filled.withColumns(snapshot_flags())


def customer_month_summary(customer_month: DataFrame) -> DataFrame:
    return customer_month.groupBy("snapshot_month").agg(
        F.count("*").alias("customer_month_rows"),
        # The table has one row per customer and month, so rows are customers.
        F.count("customer_id").alias("unique_customers"),
        F.avg("churn_next_period").alias("churn_rate"),
        F.sum("monthly_revenue").alias("total_monthly_revenue"),
        F.avg("monthly_revenue").alias("avg_monthly_revenue"),
        F.avg("engagement_score").alias("avg_engagement_score"),
        F.avg("active_days").alias("avg_active_days"),
    ).orderBy("snapshot_month")


def build_summary(customer_month: DataFrame, snapshot: DataFrame) -> DataFrame:
    months = customer_month.agg(
        F.count("*").alias("customer_month_rows"),
        F.count_if("is_latest_month").alias("customer_month_unique_users"),
        F.min("snapshot_month").alias("customer_month_min_month"),
        F.max("snapshot_month").alias("customer_month_max_month"),
    )
    customers = snapshot.agg(
        F.count("*").alias("modeling_snapshot_rows"),
        F.avg("churn_next_period").alias("modeling_snapshot_churn_rate"),
        F.count_if(F.col("snapshot_month") == k.NO_MONTH).alias("users_without_observed_month"),
    )
    return months.crossJoin(customers)  # two one-row aggregates
