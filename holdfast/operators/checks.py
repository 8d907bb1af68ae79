"""Data-contract checks: PASS/FAIL rows from a few one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import fixed, ratio

P, CLV, LOST = "predicted_churn_probability", "profit_adjusted_clv_proxy", "future_churned_clv_proxy"

# The check names below are fixed values.
Check = tuple[str, Column, Column | None]


def rule_note(name: str) -> str:
    return f"Rule: {name.replace('_', ' ')}."


def report(facts: DataFrame, checks: list[Check]) -> DataFrame:
    """``facts`` is one row; each check is (name, shown value, passed), None where nothing was computed."""
    rows = F.array(*(
        F.struct(
            F.lit(name).alias("check_name"),
            (
                F.lit("NOT_AVAILABLE") if passed is None
                else F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
            ).alias("status"),
            F.coalesce(value.cast("string"), F.lit("")).alias("value"),
            F.lit(rule_note(name)).alias("notes"),
        )
        for name, value, passed in checks
    ))
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def fail_on_violation(checked: DataFrame) -> DataFrame:
    """Raises when a check failed; the report has a dozen rows."""
    failed = [row["check_name"] for row in checked.filter(F.col("status") == "FAIL").collect()]
    if failed:
        raise ValueError(f"Contract checks failed: {failed}")
    return checked


def combine_status(reports: dict[str, DataFrame]) -> DataFrame:
    """One status row per report."""
    out = None
    for name, checked in reports.items():
        row = checked.agg(
            F.lit(name).alias("report"),
            F.count("*").alias("checks"),
            F.count_if(F.col("status") == "FAIL").alias("failed"),
        ).withColumn("validation_status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))
        out = row if out is None else out.unionByName(row)
    return out


def _grain(df: DataFrame, keys: list[str], groups: str, repeated: str) -> DataFrame:
    """Distinct keys and repeated keys from one shuffle of the keys."""
    return df.groupBy(*keys).count().agg(
        F.count("*").alias(groups), F.count_if(F.col("count") > 1).alias(repeated)
    )


def _cross(*one_rows: DataFrame) -> DataFrame:
    out = one_rows[0]
    for other in one_rows[1:]:
        out = out.crossJoin(other)
    return out


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _pair(left: str, a: str, right: str, b: str) -> Column:
    return F.concat(F.lit(f"{left}="), F.col(a), F.lit(f", {right}="), F.col(b))


def check_customer_month(customer_month: DataFrame, snapshot: DataFrame) -> DataFrame:
    months = customer_month.agg(
        F.count("*").alias("months"),
        F.count_if((F.col("monthly_revenue") < 0) | (F.col("monthly_list_price") < 0)).alias("negative"),
        F.count_if(F.col("tenure_months") < -1).alias("bad_tenure"),
        F.min("snapshot_month").alias("first"),
        F.max("snapshot_month").alias("last"),
    )
    customers = snapshot.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("churn_next_period").isNull()).alias("no_label"),
        F.avg("churn_next_period").alias("churn"),
        F.count_if(F.col("snapshot_month") == k.NO_MONTH).alias("unobserved"),
    )
    facts = _cross(
        months, customers,
        _grain(customer_month, ["customer_id", "snapshot_month"], "distinct_months", "dup_months"),
        _grain(snapshot, ["customer_id"], "users", "dup_customers"),
    )
    c = F.col
    return report(facts, [
        ("customer_month_table_not_empty", c("months"), c("months") > 0),
        ("modeling_snapshot_not_empty", c("customers"), c("customers") > 0),
        ("no_duplicate_customer_month_rows", c("dup_months"), c("dup_months") == 0),
        ("one_snapshot_row_per_customer", c("dup_customers"), c("dup_customers") == 0),
        ("snapshot_rows_equal_unique_users", _pair("rows", "customers", "unique_users", "users"),
         c("customers") == c("users")),
        ("no_missing_churn_target", c("no_label"), c("no_label") == 0),
        ("churn_rate_reasonable", fixed("churn", 6), (c("churn") > 0) & (c("churn") < 0.5)),
        ("no_negative_revenue_values", c("negative"), c("negative") == 0),
        ("tenure_values_reasonable", c("bad_tenure"), c("bad_tenure") == 0),
        ("users_without_observed_month_tracked", c("unobserved"), c("unobserved") >= 0),
        ("customer_month_date_range_exists", F.concat(c("first"), F.lit(" to "), c("last")),
         c("first").isNotNull() & c("last").isNotNull()),
        ("snapshot_export_exists", c("customers"), c("customers") > 0),
    ])


def check_clv(clv: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    tiers = ("clv_value_tier", "value_based_action_group", "retention_budget_tier")
    missing = F.lit(False)
    for tier in tiers:
        missing = missing | c(tier).isNull()
    months = c("expected_active_months_proxy")
    facts = _cross(clv.agg(
        F.count("*").alias("customers"),
        F.count_if(c(CLV).isNull()).alias("no_clv"),
        F.count_if((c(CLV) < 0) | (c("monthly_value_baseline") < 0) | (c("monthly_margin_baseline") < 0)).alias("negative"),
        F.count_if(missing).alias("no_tier"),
        F.count_if((months < 1) | (months > p.clv.max_months)).alias("out_of_bounds"),
    ), _grain(clv, ["customer_id"], "users", "duplicates"))
    return report(facts, [
        ("clv_table_not_empty", c("customers"), c("customers") > 0),
        ("one_row_per_customer", _pair("rows", "customers", "unique_users", "users"),
         c("customers") == c("users")),
        ("no_duplicate_customers", c("duplicates"), c("duplicates") == 0),
        ("no_null_clv_values", c("no_clv"), c("no_clv") == 0),
        ("no_negative_value_metrics", c("negative"), c("negative") == 0),
        ("all_customers_have_value_tiers", c("no_tier"), c("no_tier") == 0),
        ("expected_active_months_within_bounds", c("out_of_bounds"), c("out_of_bounds") == 0),
    ])


def check_leakage(portfolio: DataFrame, deciles: DataFrame, thresholds: DataFrame, scenarios: DataFrame,
                  budgets: DataFrame, priorities: DataFrame) -> DataFrame:
    c = F.col
    facts = _cross(
        portfolio.agg(F.count("*").alias("rows"), F.max(CLV).alias("clv"), F.max(LOST).alias("lost"),
                      F.max("clv_leakage_rate").alias("rate")),
        deciles.agg(F.count_distinct("clv_rank_decile").alias("deciles")),
        _rows(thresholds, "thresholds"),
        scenarios.agg(
            F.count("*").alias("scenarios"),
            F.max(F.when(c("scenario_name") == "Base recovery", c("recoverable_portfolio_clv_proxy"))).alias("base"),
        ),
        _rows(budgets, "budgets"),
        _rows(priorities, "priorities"),
    )
    return report(facts, [
        ("portfolio_summary_has_one_row", c("rows"), c("rows") == 1),
        ("positive_profit_adjusted_clv", fixed("clv", 2), c("clv") > 0),
        ("positive_future_churned_clv", fixed("lost", 2), c("lost") > 0),
        ("leakage_rate_reasonable", fixed("rate", 6), c("rate").between(0, 1)),
        ("clv_concentration_has_10_deciles", c("deciles"), c("deciles") == 10),
        ("threshold_table_has_four_rows", c("thresholds"), c("thresholds") == 4),
        ("scenario_table_has_three_rows", c("scenarios"), c("scenarios") == 3),
        ("base_recovery_opportunity_positive", fixed("base", 2), c("base") > 0),
        ("budget_opportunity_not_empty", c("budgets"), c("budgets") > 0),
        ("model_priority_segments_not_empty", c("priorities"), c("priorities") > 0),
    ])


def check_churn_model(comparison: DataFrame, deciles: DataFrame, scored: DataFrame) -> DataFrame:
    c = F.col
    facts = _cross(
        comparison.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.desc("top_decile_lift"), "model_name").limit(1)
        .select("roc_auc", "pr_auc", "test_churn_rate"),
        deciles.filter(c("risk_decile") == 1).select("lift_vs_portfolio", "churn_capture_share"),
        scored.agg(
            F.count("*").alias("customers"), F.min(P).alias("low"), F.max(P).alias("high"),
            F.count_distinct("churn_risk_decile").alias("deciles"),
        ),
    )
    return report(facts, [
        ("predicted_probabilities_in_range",
         F.concat(F.lit("min="), fixed("low", 6), F.lit(", max="), fixed("high", 6)),
         (c("low") >= 0) & (c("high") <= 1)),
        ("roc_auc_above_random", fixed("roc_auc", 6), c("roc_auc") > 0.5),
        ("pr_auc_above_base_churn_rate", fixed("pr_auc", 6), c("pr_auc") > c("test_churn_rate")),
        ("top_decile_lift_above_one", fixed("lift_vs_portfolio", 6), c("lift_vs_portfolio") > 1),
        ("top_decile_captures_churners", fixed("churn_capture_share", 6), c("churn_capture_share") > 0.10),
        ("scored_customer_output_not_empty", c("customers"), c("customers") > 0),
        ("ten_risk_deciles_created", c("deciles"), c("deciles") == 10),
    ])


def check_lifecycle(base: DataFrame, overall_curve: DataFrame, quadrant_curve: DataFrame,
                    priorities: DataFrame) -> DataFrame:
    c = F.col
    step = Window.partitionBy(F.lit(1)).orderBy("month_index")  # months of one curve
    rise = c("survival_probability") - F.lag("survival_probability", 1).over(step)
    coverage = c("observed_month_coverage_rate")
    facts = _cross(
        base.agg(
            F.count("*").alias("customers"), F.min("lifecycle_duration_months").alias("shortest"),
            F.count_if((coverage < 0) | (coverage > 1)).alias("bad_coverage"),
            (F.count("*") - F.count_distinct("customer_id")).alias("duplicates"),
        ),
        overall_curve.withColumn("rise", rise).agg(
            F.count("*").alias("months"), F.count_if(c("rise") > 1e-9).alias("rises")
        ),
        quadrant_curve.agg(F.count_distinct("value_risk_quadrant").alias("quadrants")),
        _rows(priorities, "priorities"),
    )
    return report(facts, [
        ("lifecycle_base_not_empty", c("customers"), c("customers") > 0),
        ("one_row_per_customer", c("duplicates"), c("duplicates") == 0),
        ("positive_lifecycle_duration", c("shortest"), c("shortest") >= 1),
        ("observed_month_coverage_rate_within_bounds", c("bad_coverage"), c("bad_coverage") == 0),
        ("overall_survival_curve_created", c("months"), c("months") > 0),
        ("overall_survival_non_increasing", c("rises") == 0, c("rises") == 0),
        ("value_risk_quadrant_curve_created", c("quadrants"), c("quadrants") >= 3),
        ("model_priority_segments_not_empty", c("priorities"), c("priorities") > 0),
    ])


def check_validation(kpi: DataFrame, deciles: DataFrame, thresholds: DataFrame, calibration: DataFrame,
                     governance: DataFrame, importance_governance: DataFrame | None) -> DataFrame:
    """``importance_governance`` is left out for a score without a trained model behind it; its check is
    then not available."""
    c = F.col
    known = importance_governance is not None
    families = [_rows(importance_governance, "families")] if known else []
    facts = _cross(
        kpi.select("best_model", "roc_auc", "pr_auc_multiple_vs_base_churn"),
        deciles.filter(c("risk_decile") == 1).select("lift_vs_portfolio", "churn_capture_share"),
        thresholds.agg(F.count_if(c("target_population_pct") == 0.2).alias("top20")),
        calibration.agg(F.count("*").alias("bins"), F.avg("absolute_calibration_gap").alias("gap")),
        governance.agg(F.count_if(c("status") == "FAIL").alias("failures")),
        *families,
    )
    return report(facts, [
        ("best_model_exists", c("best_model"), F.length("best_model") > 0),
        ("roc_auc_above_random", fixed("roc_auc", 6), c("roc_auc") > 0.5),
        ("pr_auc_above_base_rate", fixed("pr_auc_multiple_vs_base_churn", 6),
         c("pr_auc_multiple_vs_base_churn") > 1),
        ("top_decile_lift_above_one", fixed("lift_vs_portfolio", 6), c("lift_vs_portfolio") > 1),
        ("top_decile_captures_more_than_population_share", fixed("churn_capture_share", 6),
         c("churn_capture_share") > 0.10),
        ("threshold_table_has_top20", c("top20") > 0, c("top20") > 0),
        ("calibration_table_created", c("bins"), c("bins") >= 5),
        ("average_abs_calibration_gap_reasonable", fixed("gap", 6), c("gap") <= 0.10),
        ("governance_checks_no_failures", c("failures"), c("failures") == 0),
        ("feature_importance_governance_created", c("families") if known else F.lit(None),
         c("families") > 0 if known else None),
    ])


def check_save(saves: DataFrame, deciles: DataFrame) -> DataFrame:
    c = F.col
    offer = c("should_receive_paid_offer")
    facts = _cross(
        saves.agg(
            F.count("*").alias("customers"),
            (F.count("*") - F.count_distinct("customer_id")).alias("duplicates"),
            F.min("save_worthiness_score").alias("low"),
            F.max("save_worthiness_score").alias("high"),
            F.count_if(offer).alias("offers"),
            F.coalesce(F.sum(F.when(offer, c("net_save_value_proxy"))), F.lit(0.0)).alias("net"),
            F.count_if(c("recommended_retention_action") == k.SUPPRESS).alias("suppressed"),
        ),
        _rows(deciles, "deciles"),
    )
    return report(facts, [
        ("scored_output_not_empty", c("customers"), c("customers") > 0),
        ("one_row_per_customer", c("duplicates"), c("duplicates") == 0),
        ("no_negative_scores", fixed("low", 6), c("low") >= 0),
        ("score_max_not_above_100", fixed("high", 6), c("high") <= 100),
        ("positive_paid_offer_count", c("offers"), c("offers") > 0),
        ("paid_offer_net_value_positive", fixed("net", 2), (c("offers") > 0) & (c("net") > 0)),
        ("suppression_group_exists", c("suppressed"), c("suppressed") > 0),
        ("decile_output_created", c("deciles"), c("deciles").isin(0, 10)),
    ])


def check_roi(matrix: DataFrame, summary: DataFrame, best: DataFrame, frontier: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    facts = _cross(
        matrix.agg(F.count("*").alias("cells"), F.min("campaign_cost_proxy").alias("cheapest")),
        summary.select(c("best_base_net_save_value_proxy").alias("net"), c("best_base_roi_proxy").alias("roi")),
        _rows(best, "best"),
        _rows(frontier, "caps"),
    )
    return report(facts, [
        ("strategy_scenario_matrix_not_empty", c("cells"), c("cells") > 0),
        ("base_best_strategy_positive_net_value", fixed("net", 2), c("net") > 0),
        ("base_best_strategy_positive_roi", fixed("roi", 6), c("roi") > 0),
        ("best_strategy_by_scenario_created", c("best"), c("best") > 0),
        ("budget_frontier_created", c("caps"), c("caps") == len(p.budget_caps)),
        ("no_negative_campaign_cost", fixed("cheapest", 6), c("cheapest") >= 0),
    ])


def check_ab(population: DataFrame, design: DataFrame, scenarios: DataFrame, plan: DataFrame,
             balance: DataFrame, detectable: DataFrame, cards: DataFrame, readiness: DataFrame) -> DataFrame:
    c = F.col
    facts = _cross(
        population.agg(
            F.count("*").alias("customers"),
            (F.count("*") - F.count_distinct("customer_id")).alias("duplicates"),
        ),
        design.select(
            c("treatment_customers").alias("treated"), c("control_customers").alias("held"),
            c("treatment_expected_net_save_value_proxy").alias("net"),
        ),
        _rows(scenarios, "scenarios"),
        plan.agg(F.sum("customers").alias("planned")),
        balance.agg(F.count("*").alias("features"), F.max(F.abs("standardized_difference")).alias("worst")),
        _rows(detectable, "effects"),
        _rows(cards, "cards"),
        _rows(readiness, "segments"),
    ).withColumn("share", F.coalesce(ratio("treated", c("treated") + c("held")), F.lit(0.0)))
    return report(facts, [
        ("experiment_population_not_empty", c("customers"), c("customers") > 0),
        ("one_row_per_customer", c("duplicates"), c("duplicates") == 0),
        ("treatment_and_control_exist", _pair("treatment", "treated", "control", "held"),
         (c("treated") > 0) & (c("held") > 0)),
        ("randomization_balance_reasonable", fixed("share", 4), c("share").between(0.45, 0.55)),
        ("expected_test_net_value_positive", fixed("net", 2), c("net") > 0),
        ("power_scenarios_created", c("scenarios"), c("scenarios") > 0),
        ("metric_cards_created", c("cards"), c("cards") >= 4),
        ("treatment_plan_groups_sum_to_population", c("planned"), c("planned") == c("customers")),
        ("balance_diagnostics_created", c("features"), c("features") > 0),
        ("max_standardized_difference_reasonable", fixed("worst", 6), c("worst") <= 0.10),
        ("mde_readout_created", c("effects"), c("effects") > 0),
        ("segment_readiness_created", c("segments"), c("segments") > 0),
    ])
