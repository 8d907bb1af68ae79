"""Observed lifecycle, value-risk quadrants, hazards and survival curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import (
    calendar_months, first_match, large_side, lookup, mean, month_text, share_or_zero, summarise, total,
    total_where, top_pick,
)

P, CLV, LOST = "predicted_churn_probability", "profit_adjusted_clv_proxy", "future_churned_clv_proxy"
DURATION = "lifecycle_duration_months"
SEGMENT = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "churn_risk_tier",
           "value_risk_quadrant", "lifecycle_strategy_readout", "retention_budget_tier"]


def month_bounds(customer_month: DataFrame) -> DataFrame:
    """First, last and number of observed months: all known on the customer's latest month row."""
    return customer_month.filter("is_latest_month").select(
        "customer_id",
        "first_observed_month_date",
        F.col("snapshot_month_date").alias("last_observed_month_date"),
        month_text("first_observed_month_date").alias("first_observed_month"),
        F.col("snapshot_month").alias("last_observed_month"),
        F.col("observed_month_number").cast("bigint").alias("observed_active_months"),
    )


def value_risk_quadrant() -> Column:
    risk, value = F.col("churn_risk_tier"), F.col("clv_value_tier")
    top = value.isin(*k.TOP_VALUE)
    return first_match(
        [
            (risk.isin(*k.ELEVATED_RISK) & top, k.QUADRANT_HH),
            (risk.isin(*k.ELEVATED_RISK) & value.isin(k.LOW_VALUE, k.NO_VALUE), k.QUADRANT_HL),
            ((risk == k.LOW_RISK) & top, k.QUADRANT_LH),
            ((risk == k.MEDIUM_RISK) & top, k.QUADRANT_MH),
        ],
        k.QUADRANT_REST,
    )


def lifecycle_readout() -> Column:
    risk, budget = F.col("churn_risk_tier"), F.col("retention_budget_tier")
    top = F.col("clv_value_tier").isin(*k.TOP_VALUE)
    return first_match(
        [
            ((risk == k.CRITICAL) & top, "Immediate save-worthiness review"),
            (risk.isin(*k.ELEVATED_RISK) & (budget == k.PREMIUM_BUDGET), "Premium save timing analysis"),
            (risk.isin(*k.ELEVATED_RISK) & budget.isin(k.AUTOMATION_BUDGET, k.NO_BUDGET), "Do not overspend"),
            ((risk == k.LOW_RISK) & top, "Protect without discount"),
        ],
        "Monitor lifecycle trend",
    )


def survival_base(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    span = F.coalesce(
        calendar_months("first_observed_month_date", "last_observed_month_date") + 1, F.lit(1)
    )
    joined = scored.drop("model_stage_note").withColumnRenamed(
        "actual_future_churn_label", "churn_event"
    ).join(large_side(bounds), "customer_id", "left")
    return joined.withColumns({
        "observed_active_months": F.coalesce("observed_active_months", F.lit(0)),
        "observation_span_months": span,
    }).withColumns({
        DURATION: F.greatest("observation_span_months", F.lit(1)),
        "observed_month_coverage_rate": share_or_zero("observed_active_months", "observation_span_months"),
        "value_risk_quadrant": value_risk_quadrant(),
        "lifecycle_strategy_readout": lifecycle_readout(),
    })


def _core() -> dict:
    return {
        "customers": F.count("*"),
        "future_churn_rate": mean("churn_event"),
        "avg_predicted_churn_probability": mean(P),
        "avg_lifecycle_duration_months": mean(DURATION),
        CLV: total(CLV),
        LOST: total(LOST),
    }


def _median() -> dict:
    """Exact: the state holds one counter per distinct duration, which the calendar bounds."""
    return {"median_lifecycle_duration_months": F.median(DURATION)}


def _coverage() -> dict:
    return {"avg_observed_month_coverage_rate": mean("observed_month_coverage_rate")}


def _value() -> dict:
    return {"avg_monthly_value_baseline": mean("monthly_value_baseline")}


def portfolio_lifecycle_summary(base: DataFrame) -> DataFrame:
    exposed = F.col("value_risk_quadrant") == k.QUADRANT_HH
    return summarise(base, [], {
        **_core(), **_median(), **_coverage(),
        "avg_observed_active_months": mean("observed_active_months"),
        "high_risk_high_value_customers": F.count_if(exposed),
        "high_risk_high_value_future_churned_clv_proxy": total_where(exposed, LOST),
    })


def lifecycle_stage_summary(base: DataFrame) -> DataFrame:
    return summarise(base, ["lifecycle_stage"], {
        **_core(), **_median(), **_coverage(), **_value(),
    }).orderBy(F.desc(LOST), "lifecycle_stage")


def _exits(base: DataFrame, keys: list[str]) -> DataFrame:
    """Customers leaving observation by duration: the only pass over the customer table."""
    return base.groupBy(*keys, F.col(DURATION).alias("month_index")).agg(
        F.count_if(F.col("churn_event") == 1).alias("churn_events"),
        F.count_if(F.col("churn_event") == 0).alias("censored_customers"),
        F.count("*").alias("leaving"),
    )


def monthly_hazard(base: DataFrame, p: Profile) -> DataFrame:
    """Hazard for every month up to the longest duration, over customers observed at least a month."""
    exits = _exits(base.filter(F.col(DURATION) >= 1), [])
    months = exits.agg(F.max("month_index").alias("last")).filter("last IS NOT NULL").select(
        F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("month_index")
    )
    ahead = Window.partitionBy(F.lit(1)).orderBy("month_index").rowsBetween(0, Window.unboundedFollowing)
    filled = months.join(exits, "month_index", "left").fillna(0)  # one row per month
    return filled.select(
        "month_index",
        F.sum("leaving").over(ahead).alias("customers_at_risk"),
        "churn_events",
        "censored_customers",
    ).withColumn("monthly_hazard_rate", share_or_zero("churn_events", "customers_at_risk")).orderBy("month_index")


def value_risk_quadrant_summary(base: DataFrame) -> DataFrame:
    keys = ["value_risk_quadrant", "lifecycle_strategy_readout"]
    return summarise(base, keys, {**_core(), **_value()}).orderBy(F.desc(LOST), *keys)


def model_priority_segments(base: DataFrame, p: Profile) -> DataFrame:
    quadrant, lost = F.col("value_risk_quadrant"), F.col(LOST)
    segments = summarise(base, SEGMENT, {
        **_core(), **_median(), **_coverage(), **_value(),
    }, p.min_segment_rows)
    weight = lookup(quadrant, k.QUADRANT_WEIGHTS, k.QUADRANT_DEFAULT_WEIGHT)
    advice = first_match(
        [
            ((quadrant == k.QUADRANT_HH) & (lost >= p.large_value), "Highest priority lifecycle segment"),
            ((quadrant == k.QUADRANT_MH) & (lost >= p.large_value), "Secondary lifecycle segment"),
            (quadrant == k.QUADRANT_HL, "Do not spend premium budget"),
            (quadrant == k.QUADRANT_LH, "Protect, but avoid discounting"),
        ],
        "Lifecycle monitoring segment",
    )
    return segments.withColumns({
        "lifecycle_model_priority_score": lost * (1 + F.col("avg_predicted_churn_probability")) * weight,
        "lifecycle_model_recommendation": advice,
    }).orderBy(F.desc("lifecycle_model_priority_score"), *SEGMENT)


def lifecycle_base_export(base: DataFrame, p: Profile) -> DataFrame:
    return summarise(base, SEGMENT, {**_core(), **_value()}, p.min_export_rows).orderBy(F.desc(LOST), *SEGMENT)


def survival_curve(base: DataFrame, keys: list[str], p: Profile, min_group: int = 0) -> DataFrame:
    """Product-limit curve per group, months 1 to the longest duration of the group.

    The customer table is reduced to a histogram of durations first; everything after that works
    on at most (groups x months) rows.
    """
    exits = _exits(base, keys)
    group = [F.col(c) for c in keys] or [F.lit(1)]
    groups = exits.groupBy(*keys).agg(
        F.sum("leaving").alias("group_size"),
        F.max("month_index").alias("last_month"),
    ).filter(F.col("group_size") >= min_group)
    months = groups.withColumn("month_index", F.explode(F.when(
        F.col("last_month") >= 1, F.sequence(F.lit(1), F.col("last_month").cast("int"))
    )))
    dense = months.join(exits, [*keys, "month_index"], "left").fillna(
        0, ["churn_events", "censored_customers", "leaving"]
    )
    w = Window.partitionBy(*group).orderBy("month_index")
    left_before = F.coalesce(F.sum("leaving").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hazards = F.collect_list("hazard_rate").over(w.rowsBetween(Window.unboundedPreceding, 0))
    label = F.concat_ws(" / ", *keys) if keys else F.lit("Overall")
    return (
        dense.withColumn("customers_at_risk", F.col("group_size") - left_before)
        .withColumn("hazard_rate", share_or_zero("churn_events", "customers_at_risk"))
        .withColumn("survival_probability", F.aggregate(hazards, F.lit(1.0), lambda s, h: s * (1 - h)))
        .select(
            *keys, "month_index", "customers_at_risk", "churn_events", "censored_customers", "hazard_rate",
            "survival_probability", "group_size", label.alias("group_label"),
        )
        .orderBy(*keys, "month_index")
    )


def survival_at(curve: DataFrame, keys: list[str], months: tuple[int, ...]) -> DataFrame:
    """Last known survival at or before each month, 1 when the curve has not started."""
    return curve.groupBy(*keys).agg(*(
        F.coalesce(
            F.max_by(
                "survival_probability", F.when(F.col("month_index") <= m, F.col("month_index"))
            ), F.lit(1.0)
        ).alias(f"survival_at_month_{m}")
        for m in months
    ))


def survival_timepoint_summary(base: DataFrame, quadrant_curve: DataFrame) -> DataFrame:
    keys = ["value_risk_quadrant"]
    return summarise(base, keys, _core()).join(
        survival_at(quadrant_curve, keys, (3, 6, 12)), keys, "left"
    ).orderBy(F.desc(LOST), *keys)


def lifecycle_top_sample(base: DataFrame, p: Profile) -> DataFrame:
    return base.orderBy(F.desc(P), F.desc(CLV), "customer_id").limit(p.sample_rows)


def lifecycle_headline(portfolio: DataFrame, stages: DataFrame, hazard: DataFrame, quadrants: DataFrame,
                       priorities: DataFrame, overall_curve: DataFrame) -> DataFrame:
    def best(df: DataFrame, by: str, prefix: str, names: list[str]) -> DataFrame:
        return top_pick(df, by, {f"{prefix}_{n}": n for n in names})

    counts = ["customers", "future_churn_rate", LOST]
    peak_names = ["month_index", "monthly_hazard_rate", "customers_at_risk", "churn_events"]
    earliest = F.struct("monthly_hazard_rate", -F.col("month_index"))  # the first month wins a tie
    peak = hazard.agg(F.max_by(F.struct(*peak_names), earliest).alias("_top")).select(
        *(F.col(f"_top.{n}").alias(f"peak_hazard_{n}") for n in peak_names)
    )
    parts = [
        survival_at(overall_curve, [], (6, 12)),
        best(stages, LOST, "top_stage", ["lifecycle_stage", *counts]),
        peak,
        best(quadrants, LOST, "top_quadrant",
             ["value_risk_quadrant", "lifecycle_strategy_readout", *counts]),
        best(priorities, "lifecycle_model_priority_score", "top_segment",
             ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "churn_risk_tier",
              "customers", LOST, "lifecycle_model_recommendation"]),
    ]
    out = portfolio.select(
        "customers", "future_churn_rate", "avg_lifecycle_duration_months",
        "median_lifecycle_duration_months", LOST, "high_risk_high_value_customers",
        "high_risk_high_value_future_churned_clv_proxy",
    )
    for part in parts:  # one-row sides
        out = out.crossJoin(part)
    return out
