"""Registry of named queries over an engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.literals import literal_rows
from holdfast.operators import (
    abtest, checks, churn_data, clean, clv, cohort, customer_month, evaluate, leakage, lifecycle, logistic, roi,
    save, training, validation,
)
from holdfast.plans.engine import RetentionEngine
from holdfast.plans.primitives import PRIMITIVES

Query = Callable[[RetentionEngine], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Result form for comparison with another SQL engine.

    Whole numbers become bigint.  Doubles are rounded by size, because the last bits of a sum depend
    on the order in which tasks finish.  The small shift moves the rounding border off the values
    that sums of prices can take, so half-way values go up in every engine.
    """
    def shape(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return stable_double(c.cast("double")).alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*(shape(f) for f in df.schema.fields))


def stable_double(c: Column) -> Column:
    size = F.abs(c)
    return (
        F.when(size >= 1e6, F.round(c + F.lit(1.37e-3), 0))
        .when(size >= 1e3, F.round(c + F.lit(1.37e-5), 2))
        .otherwise(F.round(c + F.lit(1.37e-9), 6))
    )


CLEAN: dict[str, Query] = {
    "clean_labels": lambda e: e.labels,
    "clean_members": lambda e: e.members,
    "clean_transactions": lambda e: e.transactions,
    "clean_user_logs_monthly": lambda e: clean.monthly_activity(e.raw.user_logs, e.table("labels")),
    "clean_completion_rate_proxy": lambda e: e.table("logs_monthly").select(
        "customer_id", "activity_month", "num_100", "total_plays",
        clean.completion_rate_proxy().alias("completion_rate_proxy"),
    ),
    "clean_engagement_score": lambda e: e.table("logs_monthly").select(
        "customer_id", "activity_month", "total_secs", "num_unq", "active_days",
        clean.engagement_score().alias("engagement_score"),
    ),
    "clean_data_quality_summary": lambda e: e.data_quality,
}


def _tiers(e: RetentionEngine, column: Column, name: str, source: str) -> DataFrame:
    return e.table("customer_month").select(
        "customer_id", "snapshot_month", source, column.alias(name)
    )


CUSTOMER_MONTH: dict[str, Query] = {
    "cm_transaction_monthly": lambda e: e.transaction_monthly,
    "cm_customer_month_keys": lambda e: customer_month.customer_month_keys(
        e.transaction_monthly, e.table("logs_monthly")
    ),
    "cm_customer_month_base": lambda e: e.customer_month_base,
    "cm_customer_month_features": lambda e: e.customer_month_features.drop(*customer_month.HELPER_COLUMNS),
    "cm_change_ratios": lambda e: e.table("customer_month").select(
        "customer_id", "snapshot_month",
        *(customer_month.change_ratio(now, before).alias(out) for now, before, out in (
            ("engagement_score", "prior_month_engagement_score", "engagement_change_pct"),
            ("total_secs", "prior_month_total_secs", "activity_change_pct"),
            ("monthly_revenue", "prior_month_revenue", "revenue_change_pct"),
        )),
    ),
    "cm_engagement_tier": lambda e: _tiers(
        e, customer_month.engagement_tier(e.p), "engagement_tier", "engagement_score"),
    "cm_revenue_tier": lambda e: _tiers(e, customer_month.revenue_tier(e.p), "revenue_tier", "monthly_revenue"),
    "cm_lifecycle_stage": lambda e: _tiers(
        e, customer_month.lifecycle_stage(e.p), "lifecycle_stage", "tenure_months"),
    "cm_customer_month_table": lambda e: e.table("customer_month").drop(*customer_month.HELPER_COLUMNS),
    "cm_latest_customer_month": lambda e: customer_month.latest_customer_month(e.table("customer_month")),
    "cm_latest_transaction": lambda e: e.latest_transaction,
    "cm_modeling_customer_snapshot": lambda e: e.snapshot,
    "cm_snapshot_flags": lambda e: e.table("snapshot").select(
        "customer_id", *(c.alias(n) for n, c in customer_month.snapshot_flags().items())
    ),
    "cm_customer_month_summary": lambda e: customer_month.customer_month_summary(e.table("customer_month")),
    "cm_build_summary": lambda e: customer_month.build_summary(e.table("customer_month"), e.table("snapshot")),
}

COHORT: dict[str, Query] = {
    "cohort_monthly_revenue_leakage": lambda e: e.cohort_monthly,
    "cohort_customer_first_month": lambda e: cohort.customer_first_month(e.table("customer_month")),
    "cohort_cohort_sizes": lambda e: cohort.cohort_sizes(e.table("customer_month")),
    "cohort_cohort_retention_long": lambda e: e.cohort_long,
    "cohort_distinct_rollups": lambda e: e.distinct_rollups,
    "cohort_cohort_retention_matrix": lambda e: cohort.cohort_retention_matrix(e.table("cohort_long")),
    "cohort_engagement_tier_churn_revenue": lambda e: e.cohort_by_engagement,
    "cohort_revenue_tier_churn_revenue": lambda e: cohort.revenue_tier_churn_revenue(e.table("snapshot")),
    "cohort_lifecycle_stage_churn_revenue": lambda e: e.cohort_by_stage,
    "cohort_registered_channel_churn_revenue": lambda e: cohort.registered_channel_churn_revenue(e.table("snapshot")),
    "cohort_retention_risk_segment_matrix": lambda e: cohort.retention_risk_segment_matrix(e.table("snapshot"), e.p),
    "cohort_high_value_at_risk_segments": lambda e: e.recovery_segments,
    "cohort_cohort_heatmap": lambda e: cohort.cohort_heatmap(e.cohort_long),
    "cohort_cohort_headline": lambda e: cohort.cohort_headline(
        e.cohort_monthly, e.cohort_by_engagement, e.cohort_by_stage, e.table("recovery_segments")
    ),
}

CLV: dict[str, Query] = {
    "clv_value_baselines": lambda e: clv.value_baselines(e.table("snapshot")).select(
        "customer_id", "monthly_value_baseline", "engagement_value_baseline", "auto_renew_signal",
        "cancellation_signal",
    ),
    "clv_value_deciles": lambda e: e.value_deciles.select(
        "customer_id", "monthly_value_baseline", "engagement_value_baseline", "monthly_value_decile",
        "engagement_decile",
    ),
    "clv_expected_active_months": lambda e: e.table("clv").select(
        "customer_id", clv.expected_active_months(e.p).alias("expected_active_months_proxy")
    ),
    "clv_clv_score": lambda e: e.table("clv").select(
        "customer_id", "gross_margin_rate", "monthly_margin_baseline", "annual_revenue_run_rate_proxy",
        "annual_margin_run_rate_proxy", "profit_adjusted_clv_proxy", "future_churned_clv_proxy",
    ),
    "clv_clv_value_tier": lambda e: e.table("clv").select(
        "customer_id", clv.clv_value_tier().alias("clv_value_tier")),
    "clv_value_based_action_group": lambda e: e.table("clv").select(
        "customer_id", clv.value_based_action_group().alias("value_based_action_group")),
    "clv_retention_budget_tier": lambda e: e.table("clv").select(
        "customer_id", clv.retention_budget_tier().alias("retention_budget_tier")),
    "clv_customer_clv_scores": lambda e: e.table("clv"),
    "clv_portfolio_clv_summary": lambda e: e.clv_portfolio,
    "clv_clv_value_tier_summary": lambda e: e.clv_tiers,
    "clv_clv_segment_summary": lambda e: clv.clv_segment_summary(e.table("clv"), e.p),
    "clv_value_based_action_group_summary": lambda e: e.clv_actions,
    "clv_high_value_recovery_targets": lambda e: clv.high_value_recovery_targets(e.table("clv"), e.p),
    "clv_clv_segment_matrix": lambda e: clv.clv_segment_matrix(e.table("clv"), e.p),
    "clv_clv_top_sample": lambda e: clv.clv_top_sample(e.table("clv"), e.p),
    "clv_clv_headline": lambda e: clv.clv_headline(e.clv_portfolio, e.clv_tiers, e.clv_actions, e.table("clv")),
}

LEAKAGE: dict[str, Query] = {
    "leak_portfolio_summary": lambda e: e.leak_portfolio,
    "leak_by_clv_tier": lambda e: leakage.by_clv_tier(e.table("clv")),
    "leak_by_action_group": lambda e: e.leak_actions,
    "leak_segment_matrix": lambda e: leakage.segment_matrix(e.table("clv"), e.p),
    "leak_clv_concentration_deciles": lambda e: e.leak_deciles,
    "leak_driver_scores": lambda e: e.leak_drivers,
    "leak_budget_pressure": lambda e: leakage.budget_pressure(e.table("clv")),
    "leak_monthly_value_trend": lambda e: leakage.monthly_value_trend(e.table("customer_month"), e.table("clv")),
    "leak_leakage_base": lambda e: leakage.leakage_base(e.table("clv"), e.p),
    "leak_concentration_thresholds": lambda e: e.leak_thresholds,
    "leak_recoverable_scenarios": lambda e: e.leak_scenarios,
    "leak_budget_opportunity": lambda e: e.leak_budgets,
    "leak_model_priority_segments": lambda e: e.leak_priorities,
    "leak_leakage_headline": lambda e: leakage.leakage_headline(
        e.table("leak_portfolio"), e.leak_actions, e.leak_drivers, e.table("leak_deciles"),
        e.table("leak_thresholds"), e.table("leak_scenarios"), e.table("leak_budgets"), e.table("leak_priorities"),
    ),
}


def _metric(e: RetentionEngine, *names: str) -> DataFrame:
    return evaluate.score_metrics(e.test_rank).select(*names)


def _prepared(e: RetentionEngine) -> DataFrame:
    """Filled and coded features of the tree candidates, one row per feature."""
    features = e.candidate(training.BOOSTED).features
    values = F.array(*(e.preparation.column(f) for f in features))
    return e.table("model_frame").select(F.posexplode(values).alias("position", "x")).groupBy("position").agg(
        F.count("x").alias("customers"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean")
    ).select(F.array(*map(F.lit, features))[F.col("position")].alias("feature"), "customers", "low", "high", "mean")


def _scores(e: RetentionEngine, name: str) -> DataFrame:
    return e.model_scores(name).select("customer_id", "in_test", evaluate.P)


def _saved_model(e: RetentionEngine) -> DataFrame:
    """Customers scored before and after saving and loading the best model, and the largest difference."""
    path, frame = e.store.fresh("model"), e.table("model_frame")
    model = e.model(e.best_model)
    training.save_model(e.spark, model, path)
    again = training.load_model(e.spark, path)
    both = training.score(model, frame).select("customer_id", F.col(evaluate.P).alias("before")).join(
        training.score(again, frame).select("customer_id", F.col(evaluate.P).alias("after")), "customer_id"
    )
    return both.agg(F.count("*").alias("customers"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"))


def _logistic_optimality(e: RetentionEngine) -> DataFrame:
    """Whether the loss is level at the weights found, by feature: the condition of its only minimum."""
    model = e.model(training.LOGISTIC)
    rows = training.training_rows(e.table("model_frame"), e.p.model)
    ready = rows.select(*(c.alias(f) for f, c in zip(model.features, model.columns())), churn_data.TARGET, "class_weight")
    slope = logistic.gradient_at(ready, model.fitted, churn_data.TARGET, "class_weight")
    names = [*model.features, "intercept"]
    return literal_rows(e.spark, [(f, abs(g) < 1e-9) for f, g in zip(names, slope.tolist())], "feature string, at_minimum boolean")


CHURN: dict[str, Query] = {
    "churn_feature_leakage_audit": lambda e: e.feature_audit,
    "churn_modeling_frame": lambda e: churn_data.modeling_frame(e.table("clv")),
    "churn_stratified_split": lambda e: e.split.select("customer_id", "churn_next_period", "in_test"),
    "churn_preprocess": _prepared,
    "churn_train_logistic_balanced": lambda e: _scores(e, training.LOGISTIC),
    "churn_train_boosted_trees": lambda e: _scores(e, training.BOOSTED),
    "churn_train_no_cancel_sensitivity": lambda e: _scores(e, training.BOOSTED_NO_CANCEL),
    "churn_score_customers": lambda e: e.model_scores(e.best_model).select("customer_id", evaluate.P),
    "churn_roc_auc": lambda e: _metric(e, "roc_auc"),
    "churn_pr_auc": lambda e: _metric(e, "pr_auc"),
    "churn_brier_log_loss": lambda e: _metric(e, "brier_score", "log_loss"),
    "churn_threshold_metrics": lambda e: _metric(
        e, "accuracy_at_0_50", "precision_at_0_50", "recall_at_0_50", "f1_at_0_50"),
    "churn_risk_decile_table": lambda e: e.risk_deciles,
    "churn_threshold_table": lambda e: e.thresholds,
    "churn_calibration_table": lambda e: e.calibration,
    "churn_risk_deciles_and_tiers": lambda e: e.table("scored").select(
        "customer_id", evaluate.P, "churn_risk_decile", evaluate.churn_risk_tier().alias("churn_risk_tier")),
    "churn_scored_customers": lambda e: e.table("scored"),
    "churn_scored_top_sample": lambda e: evaluate.scored_top_sample(e.table("scored"), e.p),
    "churn_segment_score_summary": lambda e: evaluate.segment_score_summary(e.table("scored"), e.p),
    "churn_permutation_importance": lambda e: e.table("importance"),
    "churn_scorecard_importance": lambda e: e.table("scorecard_importance"),
    "churn_logistic_optimality": _logistic_optimality,
    "churn_model_comparison": lambda e: e.table("trained_comparison"),
    "churn_scorecard_comparison": lambda e: e.scorecard_comparison,
    "churn_model_persist": _saved_model,
    "churn_training_manifest": lambda e: churn_data.split_manifest(e.split),
    "churn_churn_headline": lambda e: evaluate.churn_headline(
        e.table("scorecard_comparison"), e.table("risk_deciles"), e.table("thresholds")),
}

LIFECYCLE: dict[str, Query] = {
    "life_month_bounds": lambda e: e.month_bounds,
    "life_survival_base": lambda e: e.table("lifecycle"),
    "life_value_risk_quadrant": lambda e: e.table("lifecycle").select(
        "customer_id", lifecycle.value_risk_quadrant().alias("value_risk_quadrant")),
    "life_lifecycle_strategy_readout": lambda e: e.table("lifecycle").select(
        "customer_id", lifecycle.lifecycle_readout().alias("lifecycle_strategy_readout")),
    "life_portfolio_lifecycle_summary": lambda e: e.life_portfolio,
    "life_lifecycle_stage_summary": lambda e: e.life_stages,
    "life_monthly_hazard": lambda e: e.life_hazard,
    "life_value_risk_quadrant_summary": lambda e: e.life_quadrants,
    "life_model_priority_segments": lambda e: e.life_segments,
    "life_lifecycle_base": lambda e: lifecycle.lifecycle_base_export(e.table("lifecycle"), e.p),
    "life_km_overall": lambda e: e.overall_curve,
    "life_km_by_stage": lambda e: e.curve("lifecycle_stage"),
    "life_km_by_value_tier": lambda e: e.curve("clv_value_tier"),
    "life_km_by_risk_tier": lambda e: e.curve("churn_risk_tier"),
    "life_km_by_quadrant": lambda e: e.quadrant_curve,
    "life_survival_timepoint_summary": lambda e: lifecycle.survival_timepoint_summary(
        e.table("lifecycle"), e.table("quadrant_curve")),
    "life_lifecycle_top_sample": lambda e: lifecycle.lifecycle_top_sample(e.table("lifecycle"), e.p),
    "life_lifecycle_headline": lambda e: lifecycle.lifecycle_headline(
        e.table("life_portfolio"), e.life_stages, e.life_hazard, e.life_quadrants, e.table("life_segments"),
        e.table("overall_curve")),
}

VALIDATION: dict[str, Query] = {
    "valid_kpi_summary": lambda e: e.valid_kpi,
    "valid_business_grade": lambda e: e.valid_kpi.select("best_model", "business_validation_grade"),
    "valid_model_comparison_readout": lambda e: validation.model_comparison_readout(e.table("scorecard_comparison")),
    "valid_decile_lift_scorecard": lambda e: validation.decile_lift_scorecard(e.table("risk_deciles")),
    "valid_threshold_policy_scorecard": lambda e: validation.threshold_policy_scorecard(e.table("thresholds")),
    "valid_calibration_diagnostic": lambda e: e.valid_calibration,
    "valid_risk_tier_value_impact": lambda e: e.valid_risk_value,
    "valid_segment_intervention_priority": lambda e: e.valid_segments,
    "valid_cancel_signal_sensitivity": lambda e: e.sensitivity(trained=False),
    "valid_cancel_signal_sensitivity_trained": lambda e: e.sensitivity(trained=True),
    "valid_feature_importance_governance": lambda e: e.importance_governance,
    "valid_scorecard_importance_governance": lambda e: validation.feature_importance_governance(
        e.table("scorecard_importance")),
    "valid_leakage_governance_check": lambda e: e.governance,
    "valid_recommended_operating_point": lambda e: validation.recommended_operating_point(e.table("thresholds")),
    "valid_valid_headline": lambda e: validation.valid_headline(
        e.table("valid_kpi"), e.table("thresholds"), e.valid_calibration, e.valid_risk_value, e.valid_segments,
        e.governance),
}


def _decided(e: RetentionEngine) -> DataFrame:
    return save.decide(save.load_and_clip(e.table("scored"), e.table("lifecycle")), e.p)


SAVE: dict[str, Query] = {
    "save_load_and_clip": lambda e: save.load_and_clip(e.table("scored"), e.table("lifecycle")),
    "save_recommend_action": lambda e: e.table("saves").select(
        "customer_id", save.recommended_action().alias("recommended_retention_action")),
    "save_attach_assumptions": lambda e: save.with_assumptions(e.table("saves"), e.p).select(
        "customer_id", "recommended_retention_action", "expected_intervention_response_rate",
        "intervention_cost_proxy"),
    "save_save_economics": lambda e: _decided(e).select(
        "customer_id", "gross_value_at_risk_proxy", "expected_saved_clv_proxy", "net_save_value_proxy",
        "break_even_response_rate", "expected_roi_proxy"),
    "save_offer_eligibility": lambda e: e.table("saves").select(
        "customer_id", save.offer_eligibility().alias("should_receive_paid_offer")),
    "save_suppression_reason": lambda e: e.table("saves").select(
        "customer_id", save.suppression_reason().alias("suppression_reason")),
    "save_save_rank_and_score": lambda e: e.table("saves").select(
        "customer_id", "save_worthiness_rank", "save_worthiness_score"),
    "save_save_priority_tier": lambda e: e.table("saves").select("customer_id", "save_priority_tier"),
    "save_final_targeting_readout": lambda e: e.table("saves").select(
        "customer_id", save.final_targeting_readout().alias("final_targeting_readout")),
    "save_customer_save_worthiness_scores": lambda e: e.table("saves").drop(*save.HELPER_COLUMNS),
    "save_portfolio_summary": lambda e: e.save_portfolio,
    "save_action_summary": lambda e: e.save_actions,
    "save_priority_tier_summary": lambda e: e.save_tiers,
    "save_budget_summary": lambda e: save.budget_summary(e.table("saves")),
    "save_segment_summary": lambda e: e.save_segments,
    "save_save_worthiness_deciles": lambda e: e.save_deciles,
    "save_suppression_summary": lambda e: e.save_suppressions,
    "save_high_priority_save_targets": lambda e: save.high_priority_save_targets(e.table("saves"), e.p),
    "save_top_sample": lambda e: save.save_top_sample(e.table("saves"), e.p),
    "save_save_headline": lambda e: save.save_headline(
        e.table("save_portfolio"), e.save_actions, e.save_tiers, e.save_segments, e.save_suppressions),
}


def _membership(e: RetentionEngine) -> DataFrame:
    """Customers per targeting strategy, empty strategies included."""
    listed = roi.strategies(e.p)
    cells = roi.strategy_cells(e.table("saves"), [(name, cond) for name, _, _, cond in listed])
    names = literal_rows(
        e.spark,
        [(name, kind, readout) for name, kind, readout, _ in listed],
        "strategy_name string, strategy_type string, strategy_readout string",
    )
    counts = cells.groupBy("strategy_name").agg(F.sum("n").alias("targeted_customers"))
    return names.join(counts, "strategy_name", "left").fillna(0, ["targeted_customers"])


def _roi_base(e: RetentionEngine) -> DataFrame:
    return e.table("roi_matrix").filter(F.col("scenario_name") == "Base")


ROI: dict[str, Query] = {
    "roi_targeting_strategies": _membership,
    "roi_top_n_strategy": lambda e: _membership(e).filter(F.col("strategy_type") == "Top-N"),
    "roi_roi_metrics": lambda e: _roi_base(e).drop(
        "strategy_type", "strategy_readout", "scenario_readout", "recommended_decision"),
    "roi_strategy_scenario_matrix": lambda e: e.roi_matrix,
    "roi_strategy_decision": lambda e: e.table("roi_matrix").select(
        "strategy_name", "scenario_name", roi.strategy_decision().alias("recommended_decision")),
    "roi_roi_portfolio_summary": lambda e: roi.roi_portfolio_summary(e.table("roi_matrix")),
    "roi_best_strategy_by_scenario": lambda e: e.roi_best,
    "roi_action_roi_summary": lambda e: roi.action_roi_summary(e.table("saves"), e.p),
    "roi_budget_cap_frontier": lambda e: e.roi_frontier,
    "roi_response_rate_sensitivity": lambda e: roi.response_rate_sensitivity(e.table("saves"), e.p),
    "roi_break_even_summary": lambda e: e.roi_break_even,
    "roi_roi_frontier_export": lambda e: roi.roi_frontier_export(e.table("roi_matrix")),
    "roi_roi_headline": lambda e: roi.roi_headline(
        e.table("roi_matrix"), e.roi_best, e.table("roi_frontier"), e.roi_break_even),
}

AB: dict[str, Query] = {
    "ab_efficient_budget": lambda e: e.efficient_budget,
    "ab_experiment_population": lambda e: abtest.experiment_population(
        e.table("saves"), e.table("efficient_budget"), e.p),
    "ab_stratify": lambda e: abtest.stratify(e.table("saves")).select("customer_id", "randomization_stratum"),
    "ab_deterministic_assignment": lambda e: e.table("population").select(
        "customer_id", "randomization_stratum", "ab_test_randomization_score", "stratum_row_number",
        "stratum_size", "stratum_treatment_cutoff", "experiment_group"),
    "ab_candidate_population": lambda e: e.table("population"),
    "ab_ab_portfolio_summary": lambda e: e.ab_portfolio,
    "ab_experiment_design_summary": lambda e: e.ab_design,
    "ab_sample_size": lambda e: abtest.power_scenarios(e.table("population"), ["lifecycle_stage"]).select(
        "lifecycle_stage", "scenario_label", "target_power", "required_sample_size_per_group"),
    "ab_power": lambda e: abtest.power_scenarios(e.table("population"), ["clv_value_tier"]).select(
        "clv_value_tier", "scenario_label", "target_power", "planned_sample_size_per_group",
        "approx_power_with_planned_sample"),
    "ab_power_scenarios": lambda e: e.ab_power,
    "ab_treatment_control_plan": lambda e: abtest.treatment_control_plan(e.table("population")),
    "ab_segment_test_readiness": lambda e: abtest.segment_test_readiness(e.table("population"), e.p),
    "ab_balance_diagnostics": lambda e: abtest.balance_diagnostics(e.table("population")),
    "ab_minimum_detectable_effect": lambda e: abtest.minimum_detectable_effect(e.table("population")),
    "ab_ab_plan_cards": lambda e: e.ab_cards,
    "ab_assignment_counts": lambda e: abtest.assignment_counts(e.table("population")),
    "ab_rollout_thresholds": lambda e: abtest.rollout_thresholds(e.table("ab_design")),
    "ab_ab_headline": lambda e: abtest.ab_headline(
        e.table("ab_portfolio"), e.table("ab_design"), e.table("ab_power")),
}


def _check(name: str) -> Query:
    return lambda e: e.check(name)


def _dashboard(name: str) -> Query:
    return lambda e: e.dashboard(name)


CHECKS: dict[str, Query] = {
    f"check_{name}": _check(name)
    for name in ("customer_month", "clv", "leakage", "churn_model", "lifecycle", "validation", "save", "roi", "ab")
}
CHECKS["check_fail_on_violation"] = lambda e: checks.combine_status({
    name: e.check(name) for name in e.check_names()
})

BI: dict[str, Query] = {
    f"bi_{name}": _dashboard(name)
    for name in (
        "executive_kpi", "value_leakage_heatmap", "risk_value_decision_map", "save_worthiness_funnel",
        "budget_frontier", "ab_readiness", "model_governance", "lifecycle_priority", "clv_concentration",
        "risk_lift", "retention_action",
    )
}

DOMAIN: dict[str, Query] = {
    **CLEAN, **CUSTOMER_MONTH, **COHORT, **CLV, **LEAKAGE, **CHURN, **LIFECYCLE, **VALIDATION, **SAVE, **ROI,
    **AB, **CHECKS, **BI,
}

QUERIES: dict[str, Query] = {**DOMAIN, **PRIMITIVES}
