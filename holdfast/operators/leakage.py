"""Where customer value leaks: portfolio, segments, concentration and recovery sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import (
    first_match, large_side, lookup, mean, positive_ratio, ratio, summarise, total, total_where, top_pick,
)
from holdfast.functions.literals import literal_rows
from holdfast.operators.clv import FULL_SEGMENT
from holdfast.operators.ranking import (
    Key, NumberedRows, ntile_edges, number_rows, running_bands, share_edges,
)
from holdfast.plans.store import TableStore

CLV, LOST = "profit_adjusted_clv_proxy", "future_churned_clv_proxy"


def _core() -> dict:
    return {
        "customers": F.count("*"),
        "future_churn_rate": mean("churn_next_period"),
        CLV: total(CLV),
        LOST: total(LOST),
    }


def _baselines() -> dict:
    return {
        "monthly_revenue_baseline_proxy": total("monthly_value_baseline"),
        "monthly_margin_baseline_proxy": total("monthly_margin_baseline"),
    }


def _signals() -> dict:
    return {
        "avg_engagement_score": mean("engagement_score"),
        "auto_renew_rate": mean("auto_renew_signal"),
        "cancellation_signal_rate": mean("cancellation_signal"),
    }


def _behaviour() -> dict:
    return {
        "no_recent_activity_rate": mean("no_recent_activity_flag"),
        "major_activity_drop_rate": mean("major_activity_drop_flag"),
    }


def _with_leakage_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("clv_leakage_rate", positive_ratio(LOST, CLV))


def _ranked_by_loss(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(F.desc(LOST), *keys)


def portfolio_summary(clv: DataFrame) -> DataFrame:
    churned = F.col("churn_next_period") == 1
    return _with_leakage_rate(summarise(clv, [], {
        **_core(), **_baselines(),
        "annual_revenue_run_rate_proxy": total("annual_revenue_run_rate_proxy"),
        "annual_margin_run_rate_proxy": total("annual_margin_run_rate_proxy"),
        "future_churned_monthly_revenue_proxy": total_where(churned, "monthly_value_baseline"),
        "future_churned_monthly_margin_proxy": total_where(churned, "monthly_margin_baseline"),
    }))


def by_clv_tier(clv: DataFrame) -> DataFrame:
    keys = ["clv_value_tier", "retention_budget_tier"]
    return _ranked_by_loss(
        _with_leakage_rate(summarise(clv, keys, {**_core(), **_baselines(), **_signals()})), keys
    )


def by_action_group(clv: DataFrame) -> DataFrame:
    keys = ["value_based_action_group", "retention_budget_tier"]
    metrics = {**_core(), **_baselines(), **_signals(), **_behaviour()}
    return _ranked_by_loss(_with_leakage_rate(summarise(clv, keys, metrics)), keys)


def _segments(clv: DataFrame, min_rows: int) -> DataFrame:
    metrics = {
        **_core(), **_signals(), **_behaviour(),
        "monthly_revenue_baseline_proxy": total("monthly_value_baseline"),
        "avg_active_days": mean("active_days"),
    }
    return _with_leakage_rate(summarise(clv, FULL_SEGMENT, metrics, min_rows))


def segment_matrix(clv: DataFrame, p: Profile) -> DataFrame:
    return _ranked_by_loss(_segments(clv, p.min_segment_rows), FULL_SEGMENT)


def leakage_base(clv: DataFrame, p: Profile) -> DataFrame:
    return _ranked_by_loss(_segments(clv, p.min_export_rows), FULL_SEGMENT)


def rank_by_clv(store: TableStore, clv: DataFrame) -> NumberedRows:
    """Customers by value, highest first: only (value, id) is sorted."""
    return number_rows(
        store, "clv_rank", clv.select(CLV, "customer_id"), [Key(CLV, descending=True), Key("customer_id")]
    )


def concentration_deciles(clv: DataFrame, ranked: NumberedRows) -> DataFrame:
    decile = ranked.bucket(ntile_edges(ranked.rows, 10))
    out = summarise(clv.withColumn("clv_rank_decile", decile), ["clv_rank_decile"], {
        **_core(), **_signals(),
        "avg_profit_adjusted_clv_proxy": mean(CLV),
        "avg_monthly_value_baseline": mean("monthly_value_baseline"),
    })
    # Ten rows from here on.
    everything = Window.partitionBy(F.lit(1))
    running = everything.orderBy("clv_rank_decile").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({
        "clv_share": ratio(CLV, F.sum(CLV).over(everything)),
        "future_churned_clv_share": ratio(LOST, F.sum(LOST).over(everything)),
    }).withColumns({
        "cumulative_clv_share": F.sum("clv_share").over(running),
        "cumulative_future_churned_clv_share": F.sum("future_churned_clv_share").over(running),
    }).orderBy("clv_rank_decile")


def concentration_thresholds(clv: DataFrame, ranked: NumberedRows) -> DataFrame:
    """Top 1/5/10/20 %: each customer is counted once, in the narrowest band that holds it, and
    the few bands are then accumulated.  Nothing is multiplied by the number of thresholds."""
    permilles = [pm for _, pm in k.CONCENTRATION_PERMILLE]
    edges = share_edges(ranked.rows, permilles, up=True)
    dims = [(label, pm / 1000) for label, pm in k.CONCENTRATION_PERMILLE]
    sums = running_bands(clv, ranked.bucket(edges), dims, "threshold_label string, threshold_pct double", {
        "customers": F.count("*"), CLV: total(CLV), LOST: total(LOST),
        "churned": total("churn_next_period"), "value": total("monthly_value_baseline"),
        "score": total("engagement_score"),
    })
    return sums.select(
        "threshold_label",
        "threshold_pct",
        "customers",
        CLV,
        LOST,
        ratio(CLV, f"all_{CLV}").alias("clv_share"),
        ratio(LOST, f"all_{LOST}").alias("future_churned_clv_share"),
        ratio("churned", "customers").alias("future_churn_rate"),
        ratio("value", "customers").alias("avg_monthly_value_baseline"),
        ratio("score", "customers").alias("avg_engagement_score"),
    ).orderBy("threshold_pct")


def leakage_readout() -> Column:
    churn = F.col("future_churn_rate")
    return first_match(
        [
            ((F.col("retention_budget_tier") == k.PREMIUM_BUDGET) & (churn >= 0.10), "Model should prioritize"),
            (F.col("value_based_action_group") == "Suppress paid offer", "Suppress from paid retention"),
            (F.col("cancellation_signal_rate") >= 0.50, "Win-back strategy needed"),
            (F.col("no_recent_activity_rate") >= 0.50, "Reactivation strategy needed"),
            (churn < 0.03, "Monitor, do not overspend"),
        ],
        "Watchlist segment",
    )


def driver_scores(clv: DataFrame, p: Profile) -> DataFrame:
    segments = summarise(clv, FULL_SEGMENT, {
        **_core(), **_signals(), **_behaviour(), "avg_active_days": mean("active_days"),
    }, p.min_segment_rows)
    score = F.col(LOST) * (1 + F.col("cancellation_signal_rate")) * (1 + F.col("major_activity_drop_rate"))
    return segments.withColumns({
        "leakage_priority_score": score, "leakage_strategy_readout": leakage_readout(),
    }).orderBy(F.desc("leakage_priority_score"), *FULL_SEGMENT)


def budget_pressure(clv: DataFrame) -> DataFrame:
    keys = ["retention_budget_tier"]
    metrics = {
        **_core(), **_baselines(),
        "avg_engagement_score": mean("engagement_score"),
        "cancellation_signal_rate": mean("cancellation_signal"),
    }
    return _ranked_by_loss(_with_leakage_rate(summarise(clv, keys, metrics)), keys)


def monthly_value_trend(customer_month: DataFrame, clv: DataFrame) -> DataFrame:
    margins = clv.select("customer_id", "gross_margin_rate")
    joined = customer_month.select(
        "customer_id", "snapshot_month", "monthly_revenue", "churn_next_period", "engagement_score", "had_cancel"
    ).join(large_side(margins), "customer_id", "left")
    churned = F.col("churn_next_period") == 1
    margin = F.col("monthly_revenue") * F.col("gross_margin_rate")
    return summarise(joined, ["snapshot_month"], {
        "observed_customers": F.count("customer_id"),
        "observed_monthly_revenue_proxy": total("monthly_revenue"),
        "observed_monthly_margin_proxy": F.sum(margin),
        "future_churn_label_rate": mean("churn_next_period"),
        "future_churned_monthly_revenue_proxy": total_where(churned, "monthly_revenue"),
        "future_churned_monthly_margin_proxy": total_where(churned, margin),
        "avg_engagement_score": mean("engagement_score"),
        "cancel_signal_rate": mean("had_cancel"),
    }).orderBy("snapshot_month")


def recoverable_scenarios(clv: DataFrame) -> DataFrame:
    budget = F.col("retention_budget_tier")
    pools = {
        "portfolio": F.lit(True),
        "premium_budget": budget == k.PREMIUM_BUDGET,
        "premium_plus_moderate": budget.isin(k.PREMIUM_BUDGET, k.MODERATE_BUDGET),
    }
    sums = clv.agg(*(total_where(cond, LOST).alias(name) for name, cond in pools.items()))
    scenarios = literal_rows(
        clv.sparkSession, k.RECOVERY_SCENARIOS, "scenario_name string, recovery_rate double"
    )
    # One aggregated row times three scenarios.
    crossed = sums.crossJoin(F.broadcast(scenarios))
    outputs = []
    for name in pools:
        outputs.append(F.col(name).alias(f"{name}_future_churned_clv_proxy"))
        outputs.append((F.col(name) * F.col("recovery_rate")).alias(f"recoverable_{name}_clv_proxy"))
    return crossed.select("scenario_name", "recovery_rate", *outputs).orderBy("recovery_rate")


def budget_opportunity(clv: DataFrame, p: Profile) -> DataFrame:
    base = summarise(clv, ["retention_budget_tier"], {
        **_core(),
        "avg_engagement_score": mean("engagement_score"),
        "cancellation_signal_rate": mean("cancellation_signal"),
    })
    plan = literal_rows(
        clv.sparkSession,
        [(b.tier, b.cost_per_customer, b.recovery_rate) for b in p.budget_tiers],
        "retention_budget_tier string, campaign_cost_per_customer double, expected_recovery_rate double",
    )
    cost = F.col("customers") * F.col("campaign_cost_per_customer")
    recovered = F.col(LOST) * F.col("expected_recovery_rate")
    return base.join(F.broadcast(plan), "retention_budget_tier", "left").fillna(
        0.0, ["campaign_cost_per_customer", "expected_recovery_rate"]
    ).withColumns({
        "campaign_cost_proxy": cost,
        "recoverable_clv_proxy": recovered,
        "net_recovery_opportunity_proxy": recovered - cost,
        "break_even_recovery_rate": positive_ratio(cost, LOST),
    }).withColumn(
        "roi_proxy", positive_ratio("net_recovery_opportunity_proxy", "campaign_cost_proxy")
    ).orderBy(F.desc("net_recovery_opportunity_proxy"), "retention_budget_tier")


def model_priority_segments(clv: DataFrame, p: Profile) -> DataFrame:
    budget, group, lost = F.col("retention_budget_tier"), F.col("value_based_action_group"), F.col(LOST)
    segments = summarise(clv, FULL_SEGMENT, {
        **_core(), **_signals(),
        "avg_monthly_value_baseline": mean("monthly_value_baseline"),
        "no_recent_activity_rate": mean("no_recent_activity_flag"),
    }, p.min_segment_rows)
    weight = lookup(budget, [(b.tier, b.model_weight) for b in p.budget_tiers], 0.0)
    advice = first_match(
        [
            ((budget == k.PREMIUM_BUDGET) & (lost > p.large_value), "Highest priority for churn model"),
            ((budget == k.MODERATE_BUDGET) & (lost > p.large_value), "Secondary model priority"),
            (group == "Suppress paid offer", "Exclude from paid-retention model action"),
            (budget == k.AUTOMATION_BUDGET, "Use for low-cost lifecycle automation"),
        ],
        "Monitor segment",
    )
    reason = first_match(
        [
            (budget == k.PREMIUM_BUDGET,
             "Much value at stake: worth telling leavers from stayers."),
            (budget == k.MODERATE_BUDGET,
             "Some value at stake: scores save campaign cost."),
            (budget == k.AUTOMATION_BUDGET, "Little value each: automated messages only."),
            (group == "Suppress paid offer", "Nothing to lose: no paid offers."),
        ],
        "Use as monitoring population.",
    )
    return segments.withColumns({
        "model_priority_score": lost * (1 + F.col("future_churn_rate")) * weight,
        "model_priority_recommendation": advice,
        "modeling_reason": reason,
    }).orderBy(F.desc("model_priority_score"), *FULL_SEGMENT)


def leakage_headline(portfolio: DataFrame, actions: DataFrame, drivers: DataFrame, deciles: DataFrame,
                     thresholds: DataFrame, scenarios: DataFrame, budgets: DataFrame,
                     priorities: DataFrame) -> DataFrame:
    """One row of top picks; every side is an aggregate of a few rows reduced to one."""
    def best(df: DataFrame, by: str, prefix: str, names: list[str]) -> DataFrame:
        return top_pick(df, by, {f"{prefix}_{n}": n for n in names})

    def pick(df: DataFrame, cond: Column, prefix: str, names: list[str]) -> DataFrame:
        return df.filter(cond).select(*(F.col(n).alias(f"{prefix}_{n}") for n in names))

    segment = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier"]
    shares = ["customers", "clv_share", "future_churned_clv_share"]
    parts = [
        best(actions, LOST, "top_action",
             ["value_based_action_group", "retention_budget_tier", "customers", "future_churn_rate", LOST]),
        best(drivers, "leakage_priority_score", "top_driver",
             [*segment, "value_based_action_group", "customers", "future_churn_rate", LOST,
              "leakage_strategy_readout"]),
        pick(deciles, F.col("clv_rank_decile") == 1, "top_decile", [*shares, "future_churn_rate"]),
        pick(thresholds, F.col("threshold_label") == "Top 5%", "top_5", shares),
        pick(thresholds, F.col("threshold_label") == "Top 10%", "top_10", shares),
        pick(scenarios, F.col("scenario_name") == "Base recovery", "base_recovery",
             ["recovery_rate", "recoverable_portfolio_clv_proxy", "recoverable_premium_budget_clv_proxy"]),
        best(budgets, "net_recovery_opportunity_proxy", "best_budget",
             ["retention_budget_tier", "campaign_cost_proxy", "recoverable_clv_proxy",
              "net_recovery_opportunity_proxy", "roi_proxy"]),
        best(priorities, "model_priority_score", "top_priority",
             [*segment, "customers", LOST, "model_priority_recommendation"]),
    ]
    out = portfolio.select(
        "customers", "future_churn_rate", "annual_revenue_run_rate_proxy", "annual_margin_run_rate_proxy",
        CLV, LOST, "clv_leakage_rate",
    )
    for part in parts:
        out = out.crossJoin(part)
    return out
