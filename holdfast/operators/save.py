"""Save-worthiness: which customers are worth a paid offer, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import (
    clip, first_match, large_side, lookup, mean, number_or_zero, positive_ratio, ratio, require_columns,
    share_or_zero, summarise, total, top_pick,
)
from holdfast.operators.ranking import ROW_NO, Key, number_rows, quantile_edges, rank_bucket
from holdfast.plans.store import TableStore

P, CLV, LOST = "predicted_churn_probability", "profit_adjusted_clv_proxy", "future_churned_clv_proxy"
VAR, SAVED, COST, NET = (
    "gross_value_at_risk_proxy", "expected_saved_clv_proxy", "intervention_cost_proxy", "net_save_value_proxy",
)
ACTION = "recommended_retention_action"
OFFER = "should_receive_paid_offer"

OUTPUT_COLUMNS = (
    "customer_id", "snapshot_month", "actual_future_churn_label", P, "churn_risk_decile", "churn_risk_tier",
    "lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "value_risk_quadrant",
    "lifecycle_strategy_readout", "value_based_action_group", "retention_budget_tier",
    "monthly_value_baseline", "monthly_margin_baseline", "annual_revenue_run_rate_proxy",
    "annual_margin_run_rate_proxy", CLV, LOST, VAR, "expected_intervention_response_rate", COST, SAVED, NET,
    "break_even_response_rate", "expected_roi_proxy", ACTION, OFFER, "suppression_reason",
    "save_worthiness_rank", "save_worthiness_score", "save_priority_tier", "final_targeting_readout",
)
# Running totals in rank order, kept for the budget frontier and the experiment population.
HELPER_COLUMNS = ("cumulative_cost", "cumulative_saved")
REQUIRED = (
    "customer_id", "actual_future_churn_label", P, "churn_risk_decile", "churn_risk_tier", "snapshot_month",
    "lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "value_based_action_group",
    "retention_budget_tier", "monthly_value_baseline", "monthly_margin_baseline",
    "annual_revenue_run_rate_proxy", "annual_margin_run_rate_proxy", CLV, LOST,
)


def load_and_clip(scored: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Scores with the lifecycle labels; both tables have one row per customer."""
    extra = lifecycle.select(
        "customer_id", "lifecycle_duration_months", "observed_active_months", "observed_month_coverage_rate",
        "value_risk_quadrant", "lifecycle_strategy_readout",
    )
    return clip_inputs(scored.join(large_side(extra), "customer_id", "left"))


def from_lifecycle(lifecycle: DataFrame) -> DataFrame:
    """The same rows from the lifecycle table alone, which already carries the score columns: no join."""
    return clip_inputs(lifecycle.withColumnRenamed("churn_event", "actual_future_churn_label"))


def clip_inputs(df: DataFrame) -> DataFrame:
    require_columns(df, REQUIRED, "save-worthiness")
    amounts = ("monthly_value_baseline", "monthly_margin_baseline", "annual_revenue_run_rate_proxy",
               "annual_margin_run_rate_proxy", LOST)
    return df.withColumns({
        **{c: number_or_zero(c) for c in amounts},
        P: clip(number_or_zero(P), 0.0, 1.0),
        CLV: clip(number_or_zero(CLV), 0.0),
        "actual_future_churn_label": number_or_zero("actual_future_churn_label", "int"),
        "value_risk_quadrant": F.coalesce("value_risk_quadrant", F.lit("Unknown value-risk quadrant")),
        "lifecycle_strategy_readout": F.coalesce(
            "lifecycle_strategy_readout", F.lit("Lifecycle strategy not available")
        ),
    })


def recommended_action() -> Column:
    risk, value, budget = F.col("churn_risk_tier"), F.col("clv_value_tier"), F.col("retention_budget_tier")
    elevated, top = risk.isin(*k.ELEVATED_RISK), value.isin(*k.TOP_VALUE)
    return first_match(
        [
            ((F.col(CLV) <= 0) | (budget == k.NO_BUDGET), k.SUPPRESS),
            ((risk == k.CRITICAL) & top & (budget == k.PREMIUM_BUDGET), k.PREMIUM_SAVE),
            (elevated & top & (F.col("value_based_action_group") == "Premium win-back"), k.WIN_BACK),
            (elevated & top & (budget == k.PREMIUM_BUDGET), k.TARGETED),
            (elevated & value.isin(*k.TOP_VALUE, k.CORE_VALUE) & (budget == k.MODERATE_BUDGET), k.NURTURE),
            (elevated & (budget == k.AUTOMATION_BUDGET), k.AUTOMATED),
            (F.col("value_risk_quadrant") == k.QUADRANT_LH, k.PROTECT),
        ],
        k.MONITOR,
    )


def with_assumptions(df: DataFrame, p: Profile) -> DataFrame:
    return df.withColumns({
        "expected_intervention_response_rate": lookup(ACTION, [(a.name, a.response_rate) for a in p.actions], 0.0),
        COST: lookup(ACTION, [(a.name, a.cost) for a in p.actions], 0.0),
    })


def with_economics(df: DataFrame) -> DataFrame:
    at_risk = F.col(P) * F.col(CLV)
    saved = F.col(VAR) * F.col("expected_intervention_response_rate")
    return df.withColumn(VAR, at_risk).withColumn(SAVED, saved).withColumn(
        NET, F.col(SAVED) - F.col(COST)
    ).withColumns({
        "break_even_response_rate": ratio(COST, VAR),
        "expected_roi_proxy": positive_ratio(NET, COST),
    })


def offer_eligibility() -> Column:
    return (F.col(COST) > 0) & (F.col(NET) > 0) & ~F.col(ACTION).isin(k.SUPPRESS, k.MONITOR)


def suppression_reason() -> Column:
    suppressed = F.col(ACTION) == k.SUPPRESS
    return first_match(
        [
            (suppressed & (F.col(CLV) <= 0), "No positive CLV proxy"),
            (suppressed & (F.col("retention_budget_tier") == k.NO_BUDGET), "No paid budget tier"),
            ((F.col(COST) > 0) & (F.col(NET) <= 0), "Expected save value does not clear intervention cost"),
            (F.col(ACTION) == k.MONITOR, "Monitor only before ROI testing"),
        ],
        "Not suppressed",
    )


def decide(df: DataFrame, p: Profile) -> DataFrame:
    return with_economics(with_assumptions(df.withColumn(ACTION, recommended_action()), p)).withColumns({
        OFFER: offer_eligibility(), "suppression_reason": suppression_reason(),
    })


def rank_offers(store: TableStore, decided: DataFrame) -> DataFrame:
    """Rank by net value among eligible customers, with running cost and saved value.

    Only what ranks and sums need is sorted; the few numbers of each eligible customer then come back to the wide
    rows, which stay where they are if ``decided`` is a table bucketed by customer.
    """
    narrow = decided.filter(OFFER).select("customer_id", NET, COST, SAVED)
    ranked = number_rows(
        store, "save_rank", narrow, [Key(NET, descending=True), Key("customer_id")],
        running={"cumulative_cost": COST, "cumulative_saved": SAVED},
    )
    n = ranked.rows
    score = F.lit(100.0) if n == 1 else 100 * (1 - (F.col(ROW_NO) - 1) / F.lit(max(n - 1, 1)))
    places = ranked.frame.select("customer_id", ROW_NO, *HELPER_COLUMNS)
    return decided.join(large_side(places), "customer_id", "left").withColumns({
        "save_worthiness_rank": F.col(ROW_NO),
        "save_worthiness_score": F.when(F.col(ROW_NO).isNotNull(), score).otherwise(0.0),
        "percentile_rank": F.col(ROW_NO) / F.lit(max(n, 1)),
    }).drop(ROW_NO)


def save_priority_tier() -> Column:
    """Relationship overrides come after the ranking and win over it."""
    place = F.col("percentile_rank")
    return first_match(
        [
            (F.col(ACTION) == k.PROTECT, k.TIER_PROTECT),
            (F.col(ACTION) == k.SUPPRESS, k.TIER_SUPPRESSED),
            (place <= 0.01, k.TIER_1), (place <= 0.05, k.TIER_2), (place <= 0.10, k.TIER_3),
            (place <= 0.20, k.TIER_4), (place.isNotNull(), k.TIER_POOL),
        ],
        k.TIER_NONE,
    )


def final_targeting_readout() -> Column:
    return lookup("save_priority_tier", [
        (k.TIER_1, "Highest expected economic save opportunity"),
        (k.TIER_2, "Strong paid-retention candidate"),
        (k.TIER_3, "Targeted paid-retention candidate"),
        (k.TIER_4, "Use for controlled campaign testing"),
        (k.TIER_SUPPRESSED, "Do not spend paid retention budget"),
        (k.TIER_PROTECT, "Protect experience, avoid discounting"),
    ], "Monitor until ROI simulation")


def customer_save_worthiness_scores(
    store: TableStore, inputs: DataFrame, p: Profile, buckets: int | None = None
) -> DataFrame:
    """``buckets`` is the layout of ``inputs`` by customer, if it has one."""
    # Written first: the ranking and the result read the same table.
    decided = decide(inputs, p)
    if buckets:
        decided = store.write_bucketed("save_decided", decided, "customer_id", buckets)
    else:
        decided = store.write("save_decided", decided)
    ranked = rank_offers(store, decided).withColumn("save_priority_tier", save_priority_tier())
    return ranked.withColumn("final_targeting_readout", final_targeting_readout()).select(
        *OUTPUT_COLUMNS, *HELPER_COLUMNS
    )


# --- Summaries ----------------------------------------------------------------------------

def _core() -> dict:
    return {
        "customers": F.count("*"),
        "avg_predicted_churn_probability": mean(P),
        "actual_future_churn_rate": mean("actual_future_churn_label"),
        CLV: total(CLV), LOST: total(LOST), SAVED: total(SAVED), COST: total(COST), NET: total(NET),
    }


def _offers() -> dict:
    return {"paid_offer_customers": F.count_if(F.col(OFFER))}


def _roi(df: DataFrame) -> DataFrame:
    return df.withColumn("roi_proxy", positive_ratio(NET, COST))


def portfolio_summary(saves: DataFrame) -> DataFrame:
    def paid(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(OFFER), F.col(c))), F.lit(0.0))

    out = summarise(saves, [], {
        **_core(), **_offers(), VAR: total(VAR),
        "paid_offer_expected_saved_clv_proxy": paid(SAVED),
        "paid_offer_intervention_cost_proxy": paid(COST),
        "paid_offer_net_save_value_proxy": paid(NET),
        "paid_offer_actual_churn_rate": F.coalesce(
            F.avg(F.when(F.col(OFFER), F.col("actual_future_churn_label"))), F.lit(0.0)
        ),
        "paid_offer_future_churned_clv_proxy": paid(LOST),
    })
    return out.withColumns({
        "paid_offer_rate": ratio("paid_offer_customers", "customers"),
        "paid_offer_roi_proxy": positive_ratio(
            "paid_offer_net_save_value_proxy", "paid_offer_intervention_cost_proxy"
        ),
    })


def action_summary(saves: DataFrame) -> DataFrame:
    return _roi(summarise(saves, [ACTION], {
        **_core(), **_offers(), VAR: total(VAR), "avg_expected_roi_proxy": mean("expected_roi_proxy"),
    })).orderBy(F.desc(NET), ACTION)


def priority_tier_summary(saves: DataFrame) -> DataFrame:
    return _roi(summarise(saves, ["save_priority_tier"], {
        **_core(), **_offers(), VAR: total(VAR),
        "avg_save_worthiness_score": mean("save_worthiness_score"),
    })).orderBy(F.desc(NET), "save_priority_tier")


def budget_summary(saves: DataFrame) -> DataFrame:
    return _roi(summarise(saves, ["retention_budget_tier"], {**_core(), **_offers()})).orderBy(
        F.desc(NET), "retention_budget_tier"
    )


def segment_summary(saves: DataFrame, p: Profile) -> DataFrame:
    keys = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "churn_risk_tier",
            "retention_budget_tier", ACTION, "save_priority_tier"]
    readout = first_match(
        [
            (F.col("save_priority_tier") == k.TIER_1, "Executive review segment"),
            (F.col("save_priority_tier") == k.TIER_2, "Premium campaign candidate"),
            (F.col(ACTION) == k.SUPPRESS, "Suppression segment"),
            (F.col(ACTION) == k.PROTECT, "Protect relationship without paid offer"),
        ],
        "Monitor or test",
    )
    return _roi(summarise(saves, keys, {
        **_core(), **_offers(), VAR: total(VAR),
        "avg_save_worthiness_score": mean("save_worthiness_score"),
    }, p.min_export_rows)).withColumn("segment_strategy_readout", readout).orderBy(F.desc(NET), *keys)


def save_worthiness_deciles(saves: DataFrame) -> DataFrame:
    """The score falls strictly with the rank, so its deciles are rank buckets."""
    eligible = saves.filter(OFFER)
    n = eligible.count()
    decile = rank_bucket(quantile_edges(n, 10), "save_worthiness_rank")
    out = summarise(eligible.withColumn("save_worthiness_decile", decile), ["save_worthiness_decile"], {
        **_core(), "avg_save_worthiness_score": mean("save_worthiness_score"),
    })
    everything = Window.partitionBy(F.lit(1))  # ten rows
    running = everything.orderBy("save_worthiness_decile").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({
        "net_save_value_share": share_or_zero(NET, F.sum(NET).over(everything)),
        "expected_saved_clv_share": share_or_zero(SAVED, F.sum(SAVED).over(everything)),
    }).withColumns({
        "cumulative_net_save_value_share": F.sum("net_save_value_share").over(running),
        "cumulative_expected_saved_clv_share": F.sum("expected_saved_clv_share").over(running),
    }).orderBy("save_worthiness_decile")


def suppression_summary(saves: DataFrame) -> DataFrame:
    return summarise(saves, ["suppression_reason"], {**_core(), VAR: total(VAR)}).orderBy(
        F.desc("customers"), "suppression_reason"
    )


def high_priority_save_targets(saves: DataFrame, p: Profile) -> DataFrame:
    return saves.filter(OFFER).select(*OUTPUT_COLUMNS).orderBy(
        F.desc(NET), F.desc(P), "customer_id"
    )


def save_top_sample(saves: DataFrame, p: Profile) -> DataFrame:
    return saves.select(*OUTPUT_COLUMNS).orderBy(
        F.desc(OFFER), F.desc(NET), F.desc(P), "customer_id"
    ).limit(p.sample_rows)


def save_headline(portfolio: DataFrame, actions: DataFrame, tiers: DataFrame, segments: DataFrame,
                  suppressions: DataFrame) -> DataFrame:
    def best(df: DataFrame, by: str, prefix: str, names: list[str]) -> DataFrame:
        return top_pick(df, by, {f"{prefix}_{n}": n for n in names})

    out = portfolio.select(
        "customers", "paid_offer_customers", "paid_offer_rate", "paid_offer_expected_saved_clv_proxy",
        "paid_offer_intervention_cost_proxy", "paid_offer_net_save_value_proxy", "paid_offer_roi_proxy",
    )
    for part in (
        best(actions, NET, "top_action", [ACTION, "customers", NET]),
        best(tiers, NET, "top_tier", ["save_priority_tier", "customers", NET]),
        best(segments, NET, "top_segment",
             ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "churn_risk_tier",
              "retention_budget_tier", ACTION, "customers", NET]),
        best(suppressions, "customers", "largest_suppression", ["suppression_reason", "customers"]),
    ):  # one-row sides
        out = out.crossJoin(part)
    return out
