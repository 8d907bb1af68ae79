"""DuckDB text for the cleaning, customer-month, cohort, value and leakage queries."""

from __future__ import annotations

from holdfast import config as k
from holdfast.config import FIXTURE as p
from holdfast.oracle.base import ENGAGEMENT_TIER, REVENUE_TIER, STAGE, TOP, constants, months
from holdfast.oracle.compose import among, when

CTES: dict[str, str] = {}
Q: dict[str, str] = {}

# --- Clean --------------------------------------------------------------------------------
Q["clean_labels"] = "SELECT * FROM labels_c"
Q["clean_members"] = "SELECT * FROM members_c"
Q["clean_transactions"] = "SELECT * FROM transactions_c"
Q["clean_user_logs_monthly"] = "SELECT * FROM activity_c"
Q["clean_completion_rate_proxy"] = """
SELECT customer_id, activity_month, num_100, total_plays,
       coalesce(num_100::DOUBLE/nullif(total_plays, 0), 0) AS completion_rate_proxy FROM activity_c"""
Q["clean_engagement_score"] = """
SELECT customer_id, activity_month, total_secs, num_unq, active_days, engagement_score FROM logs_c"""
Q["clean_data_quality_summary"] = """
SELECT (SELECT count(*) FROM labels_c) AS train_rows,
       (SELECT count(DISTINCT customer_id) FROM labels_c) AS train_unique_users,
       (SELECT avg(is_churn) FROM labels_c) AS churn_rate,
       (SELECT count(*) FROM members_c) AS members_rows,
       (SELECT count(*) FROM transactions_c) AS transactions_rows,
       (SELECT count(DISTINCT customer_id) FROM transactions_c) AS transaction_unique_users,
       (SELECT count(*) FROM transactions_c WHERE transaction_month IS NULL) AS transactions_without_month,
       (SELECT count(*) FROM logs_c) AS user_log_monthly_rows,
       (SELECT count(DISTINCT customer_id) FROM logs_c) AS user_log_unique_users"""

# --- Customer month -------------------------------------------------------------------------
Q["cm_transaction_monthly"] = "SELECT * FROM pay_month"
Q["cm_customer_month_keys"] = "SELECT * FROM month_keys"
Q["cm_customer_month_base"] = "SELECT * FROM cm_base"
Q["cm_customer_month_features"] = "SELECT * FROM cm_features"
Q["cm_change_ratios"] = """
SELECT customer_id, snapshot_month, engagement_change_pct, activity_change_pct, revenue_change_pct FROM cm"""
Q["cm_engagement_tier"] = f"""
SELECT customer_id, snapshot_month, engagement_score, {ENGAGEMENT_TIER} AS engagement_tier FROM cm_base"""
Q["cm_revenue_tier"] = f"""
SELECT customer_id, snapshot_month, monthly_revenue, {REVENUE_TIER} AS revenue_tier FROM cm_base"""
Q["cm_lifecycle_stage"] = f"""
SELECT customer_id, snapshot_month, tenure_months, {STAGE} AS lifecycle_stage FROM cm_base"""
Q["cm_customer_month_table"] = "SELECT * FROM cm"
Q["cm_latest_customer_month"] = "SELECT * FROM cm_latest"
Q["cm_latest_transaction"] = "SELECT * FROM tx_latest"
Q["cm_modeling_customer_snapshot"] = "SELECT * FROM snap"
Q["cm_snapshot_flags"] = """
SELECT customer_id, no_recent_activity_flag, cancellation_signal_flag, major_activity_drop_flag FROM snap"""
Q["cm_customer_month_summary"] = """
SELECT snapshot_month, count(*) AS customer_month_rows, count(DISTINCT customer_id) AS unique_customers,
       avg(churn_next_period) AS churn_rate, sum(monthly_revenue) AS total_monthly_revenue,
       avg(monthly_revenue) AS avg_monthly_revenue, avg(engagement_score) AS avg_engagement_score,
       avg(active_days) AS avg_active_days FROM cm GROUP BY 1"""
Q["cm_build_summary"] = f"""
SELECT count(*) AS customer_month_rows, count(DISTINCT customer_id) AS customer_month_unique_users,
       min(snapshot_month) AS customer_month_min_month, max(snapshot_month) AS customer_month_max_month,
       (SELECT count(*) FROM snap) AS modeling_snapshot_rows,
       (SELECT avg(churn_next_period) FROM snap) AS modeling_snapshot_churn_rate,
       (SELECT count(*) FROM snap WHERE snapshot_month = '{k.NO_MONTH}') AS users_without_observed_month
FROM cm"""

# --- Cohorts ----------------------------------------------------------------------------------
LOST_REVENUE = "sum(monthly_revenue) FILTER (churn_next_period = 1)"
SNAP = f"""count(*) AS customers, avg(churn_next_period) AS churn_rate,
  sum(monthly_revenue) AS total_monthly_revenue_proxy, avg(monthly_revenue) AS avg_monthly_revenue_proxy,
  coalesce({LOST_REVENUE}, 0) AS future_churned_revenue_proxy, avg(engagement_score) AS avg_engagement_score"""

CTES["c_month"] = f"""
SELECT snapshot_month, count(DISTINCT customer_id) AS observed_customers,
       sum(monthly_revenue) AS total_monthly_revenue_proxy, avg(monthly_revenue) AS avg_monthly_revenue_proxy,
       avg(churn_next_period) AS future_churn_label_rate, coalesce({LOST_REVENUE}, 0) AS future_churned_revenue_proxy,
       avg(engagement_score) AS avg_engagement_score, avg(active_days) AS avg_active_days,
       avg(is_auto_renew) AS auto_renew_rate, avg(had_cancel) AS cancel_signal_rate
FROM cm GROUP BY 1"""
CTES["c_first"] = """
SELECT customer_id, min(snapshot_month_date) AS first_observed_month_date,
       min(snapshot_month) AS first_observed_month FROM cm GROUP BY 1"""
CTES["c_size"] = """
SELECT first_observed_month, first_observed_month_date, count(DISTINCT customer_id) AS cohort_size
FROM c_first GROUP BY ALL"""
CTES["c_long"] = f"""
SELECT first_observed_month, k AS months_since_first_observed, any_value(cohort_size) AS cohort_size,
       count(DISTINCT customer_id) AS observed_users,
       count(DISTINCT customer_id)::DOUBLE/any_value(cohort_size) AS observed_retention_rate,
       sum(monthly_revenue) AS cohort_monthly_revenue_proxy,
       coalesce({LOST_REVENUE}, 0) AS future_churned_revenue_proxy,
       avg(churn_next_period) AS future_churn_label_rate, avg(engagement_score) AS avg_engagement_score
FROM (SELECT cm.*, f.first_observed_month, s.cohort_size,
             {months('f.first_observed_month_date', 'cm.snapshot_month_date')} AS k
      FROM cm JOIN c_first f USING (customer_id) JOIN c_size s USING (first_observed_month))
GROUP BY 1, 2"""
CTES["c_eng"] = f"""
SELECT engagement_tier, {SNAP}, avg(active_days) AS avg_active_days,
       avg(no_recent_activity_flag) AS no_recent_activity_rate,
       avg(major_activity_drop_flag) AS major_activity_drop_rate FROM snap GROUP BY 1"""
CTES["c_stage"] = f"""
SELECT lifecycle_stage, {SNAP}, avg(tenure_months) AS avg_tenure_months,
       avg(cancellation_signal_flag) AS cancellation_signal_rate FROM snap GROUP BY 1"""
FOCUS = when([
    ("latest_is_cancel = 1 AND revenue_tier IN ('High revenue', 'Medium revenue')", "Win-back recovery candidate"),
    ("revenue_tier = 'High revenue' AND churn_rate >= 0.10 AND latest_is_cancel = 0",
     "High-priority retention candidate"),
    ("engagement_tier = 'No observed activity' AND churn_rate >= 0.10", "Low-cost reactivation candidate"),
    ("lifecycle_stage IN ('New customer', 'Early lifecycle') AND engagement_tier IN "
     "('No observed activity', 'Low engagement')", "Onboarding intervention candidate"),
    ("churn_rate < 0.05 AND revenue_tier = 'High revenue'", "Monitor and protect"),
], "Standard retention monitoring")
CTES["c_focus"] = f"""
SELECT *, {FOCUS} AS recommended_retention_focus,
       future_churned_revenue_proxy*(1 + cancellation_signal_rate) AS revenue_recovery_priority_score
FROM (SELECT lifecycle_stage, engagement_tier, revenue_tier, latest_is_auto_renew, latest_is_cancel, {SNAP},
             avg(major_activity_drop_flag) AS major_activity_drop_rate,
             avg(cancellation_signal_flag) AS cancellation_signal_rate
      FROM snap GROUP BY 1, 2, 3, 4, 5)
WHERE customers >= {p.min_segment_rows}
ORDER BY revenue_recovery_priority_score DESC, 1, 2, 3, 4, 5 LIMIT {p.top_segments}"""

Q["cohort_monthly_revenue_leakage"] = "SELECT * FROM c_month"
Q["cohort_customer_first_month"] = "SELECT * FROM c_first"
Q["cohort_cohort_sizes"] = "SELECT * FROM c_size"
Q["cohort_cohort_retention_long"] = "SELECT * FROM c_long"
Q["cohort_cohort_retention_matrix"] = "SELECT first_observed_month, " + ", ".join(
    f"max(observed_retention_rate) FILTER (months_since_first_observed = {m}) AS month_{m}" for m in range(13)
) + " FROM c_long GROUP BY 1"
Q["cohort_engagement_tier_churn_revenue"] = "SELECT * FROM c_eng"
Q["cohort_revenue_tier_churn_revenue"] = f"""
SELECT revenue_tier, {SNAP}, avg(had_discount) AS discount_exposure_rate, avg(is_auto_renew) AS auto_renew_rate
FROM snap GROUP BY 1"""
Q["cohort_lifecycle_stage_churn_revenue"] = "SELECT * FROM c_stage"
Q["cohort_registered_channel_churn_revenue"] = f"""
SELECT registered_via, {SNAP}, avg(is_auto_renew) AS auto_renew_rate FROM snap GROUP BY 1"""
Q["cohort_retention_risk_segment_matrix"] = f"""
SELECT lifecycle_stage, engagement_tier, revenue_tier, {SNAP}, avg(active_days) AS avg_active_days,
       avg(cancellation_signal_flag) AS cancellation_signal_rate,
       avg(major_activity_drop_flag) AS major_activity_drop_rate
FROM snap GROUP BY 1, 2, 3 HAVING count(*) >= {p.min_segment_rows}"""
Q["cohort_high_value_at_risk_segments"] = "SELECT * FROM c_focus"
Q["cohort_cohort_heatmap"] = """
SELECT first_observed_month AS cohort_month, months_since_first_observed, cohort_size, observed_users,
       observed_retention_rate FROM c_long"""
Q["cohort_cohort_headline"] = """
SELECT m.snapshot_month AS latest_observed_month, m.observed_customers AS latest_observed_customers,
       m.future_churn_label_rate AS latest_month_future_churn_label_rate,
       m.future_churned_revenue_proxy AS latest_month_future_churned_revenue_proxy,
       (SELECT engagement_tier FROM c_eng ORDER BY future_churned_revenue_proxy DESC LIMIT 1)
         AS highest_future_churned_revenue_engagement_tier,
       (SELECT lifecycle_stage FROM c_stage ORDER BY future_churned_revenue_proxy DESC LIMIT 1)
         AS highest_future_churned_revenue_lifecycle_stage,
       f.lifecycle_stage AS top_segment_lifecycle_stage, f.engagement_tier AS top_segment_engagement_tier,
       f.revenue_tier AS top_segment_revenue_tier, f.customers AS top_segment_customers,
       f.churn_rate AS top_segment_churn_rate,
       f.future_churned_revenue_proxy AS top_segment_future_churned_revenue_proxy,
       f.recommended_retention_focus AS top_segment_recommended_retention_focus
FROM (SELECT * FROM c_month ORDER BY snapshot_month DESC LIMIT 1) m,
     (SELECT * FROM c_focus ORDER BY revenue_recovery_priority_score DESC LIMIT 1) f"""

# --- Value ------------------------------------------------------------------------------------
SEG4 = "lifecycle_stage, engagement_tier, revenue_tier, clv_value_tier"
SEG6 = SEG4 + ", value_based_action_group, retention_budget_tier"
CORE = """count(*) AS customers, avg(churn_next_period) AS future_churn_rate,
  sum(profit_adjusted_clv_proxy) AS total_profit_adjusted_clv_proxy,
  sum(future_churned_clv_proxy) AS future_churned_clv_proxy"""
SIGNALS = """avg(engagement_score) AS avg_engagement_score, avg(auto_renew_signal) AS auto_renew_rate,
  avg(cancellation_signal) AS cancellation_signal_rate"""
AVERAGES = """avg(monthly_value_baseline) AS avg_monthly_value_baseline,
  avg(profit_adjusted_clv_proxy) AS avg_profit_adjusted_clv_proxy"""

CTES["v_all"] = f"""
SELECT {CORE}, sum(monthly_value_baseline) AS total_monthly_value_baseline,
       sum(monthly_margin_baseline) AS total_monthly_margin_baseline,
       sum(annual_revenue_run_rate_proxy) AS annual_revenue_run_rate_proxy,
       sum(annual_margin_run_rate_proxy) AS annual_margin_run_rate_proxy,
       avg(profit_adjusted_clv_proxy) AS avg_profit_adjusted_clv_proxy,
       avg(expected_active_months_proxy) AS avg_expected_active_months_proxy FROM clv"""
CTES["v_tier"] = f"""
SELECT clv_value_tier, {CORE}, {AVERAGES}, {SIGNALS}, avg(monthly_margin_baseline) AS avg_monthly_margin_baseline,
       avg(expected_active_months_proxy) AS avg_expected_active_months_proxy FROM clv GROUP BY 1"""
CTES["v_action"] = f"""
SELECT value_based_action_group, retention_budget_tier, {CORE}, {AVERAGES}, {SIGNALS} FROM clv GROUP BY 1, 2"""
CTES["v_targets"] = f"""
SELECT customer_id, churn_next_period, snapshot_month, lifecycle_stage, engagement_tier, revenue_tier,
       clv_value_tier, value_based_action_group, retention_budget_tier, monthly_value_baseline,
       monthly_margin_baseline, expected_active_months_proxy, profit_adjusted_clv_proxy,
       future_churned_clv_proxy, engagement_score, active_days, auto_renew_signal, cancellation_signal,
       no_recent_activity_flag, major_activity_drop_flag
FROM clv WHERE clv_value_tier IN {TOP}
ORDER BY future_churned_clv_proxy DESC, profit_adjusted_clv_proxy DESC, customer_id"""

Q["clv_value_baselines"] = """
SELECT customer_id, monthly_value_baseline, engagement_value_baseline, auto_renew_signal, cancellation_signal
FROM valued"""
Q["clv_value_deciles"] = """
SELECT customer_id, monthly_value_baseline, engagement_value_baseline, monthly_value_decile, engagement_decile
FROM deciled"""
Q["clv_expected_active_months"] = "SELECT customer_id, expected_active_months_proxy FROM with_months"
Q["clv_clv_score"] = """
SELECT customer_id, gross_margin_rate, monthly_margin_baseline, annual_revenue_run_rate_proxy,
       annual_margin_run_rate_proxy, profit_adjusted_clv_proxy, future_churned_clv_proxy FROM clv"""
for _c in ("clv_value_tier", "value_based_action_group", "retention_budget_tier"):
    Q[f"clv_{_c}"] = f"SELECT customer_id, {_c} FROM clv"
Q["clv_customer_clv_scores"] = "SELECT * FROM clv"
Q["clv_portfolio_clv_summary"] = "SELECT * FROM v_all"
Q["clv_clv_value_tier_summary"] = "SELECT * FROM v_tier"
Q["clv_clv_segment_summary"] = f"""
SELECT {SEG4}, {CORE}, {AVERAGES}, {SIGNALS}, avg(active_days) AS avg_active_days
FROM clv GROUP BY {SEG4} HAVING count(*) >= {p.min_segment_rows}"""
Q["clv_value_based_action_group_summary"] = "SELECT * FROM v_action"
Q["clv_high_value_recovery_targets"] = "SELECT * FROM v_targets"
Q["clv_clv_segment_matrix"] = f"""
SELECT {SEG6}, {CORE}, {SIGNALS}, sum(monthly_value_baseline) AS total_monthly_value_baseline
FROM clv GROUP BY {SEG6} HAVING count(*) >= {p.min_export_rows}"""
Q["clv_clv_top_sample"] = f"""
SELECT * FROM clv ORDER BY profit_adjusted_clv_proxy DESC, customer_id LIMIT {p.sample_rows}"""
Q["clv_clv_headline"] = """
SELECT v.customers, v.future_churn_rate, v.annual_revenue_run_rate_proxy, v.annual_margin_run_rate_proxy,
       v.total_profit_adjusted_clv_proxy, v.future_churned_clv_proxy,
       t.clv_value_tier AS top_value_tier_by_total_clv, t.customers AS top_value_tier_customers,
       t.future_churn_rate AS top_value_tier_future_churn_rate,
       a.value_based_action_group AS top_action_group_by_future_churned_clv,
       a.customers AS top_action_group_customers,
       a.future_churned_clv_proxy AS top_action_group_future_churned_clv_proxy,
       g.customer_id AS top_target_customer_id, g.clv_value_tier AS top_target_clv_value_tier,
       g.value_based_action_group AS top_target_value_based_action_group,
       g.profit_adjusted_clv_proxy AS top_target_profit_adjusted_clv_proxy,
       g.future_churned_clv_proxy AS top_target_future_churned_clv_proxy
FROM v_all v, (SELECT * FROM v_tier ORDER BY total_profit_adjusted_clv_proxy DESC LIMIT 1) t,
     (SELECT * FROM v_action ORDER BY future_churned_clv_proxy DESC LIMIT 1) a,
     (SELECT * FROM v_targets ORDER BY future_churned_clv_proxy DESC, profit_adjusted_clv_proxy DESC,
      customer_id LIMIT 1) g"""

# --- Leakage ------------------------------------------------------------------------------------
LEAK = """count(*) AS customers, avg(churn_next_period) AS future_churn_rate,
  sum(profit_adjusted_clv_proxy) AS profit_adjusted_clv_proxy,
  sum(future_churned_clv_proxy) AS future_churned_clv_proxy"""
RATE = """CASE WHEN sum(profit_adjusted_clv_proxy) > 0
  THEN sum(future_churned_clv_proxy)/sum(profit_adjusted_clv_proxy) END AS clv_leakage_rate"""
BASES = """sum(monthly_value_baseline) AS monthly_revenue_baseline_proxy,
  sum(monthly_margin_baseline) AS monthly_margin_baseline_proxy"""
BEHAVIOUR = """avg(no_recent_activity_flag) AS no_recent_activity_rate,
  avg(major_activity_drop_flag) AS major_activity_drop_rate"""
SEGMENT_TABLE = f"""SELECT {SEG6}, {LEAK}, {RATE}, {SIGNALS}, {BEHAVIOUR},
  sum(monthly_value_baseline) AS monthly_revenue_baseline_proxy, avg(active_days) AS avg_active_days
  FROM clv GROUP BY {SEG6} HAVING count(*) >= """

CTES["l_all"] = f"""
SELECT {LEAK}, {RATE}, {BASES}, sum(annual_revenue_run_rate_proxy) AS annual_revenue_run_rate_proxy,
       sum(annual_margin_run_rate_proxy) AS annual_margin_run_rate_proxy,
       sum(monthly_value_baseline*churn_next_period) AS future_churned_monthly_revenue_proxy,
       sum(monthly_margin_baseline*churn_next_period) AS future_churned_monthly_margin_proxy FROM clv"""
CTES["l_action"] = f"""
SELECT value_based_action_group, retention_budget_tier, {LEAK}, {RATE}, {BASES}, {SIGNALS}, {BEHAVIOUR}
FROM clv GROUP BY 1, 2"""
CTES["l_ranked"] = """
SELECT *, row_number() OVER (ORDER BY profit_adjusted_clv_proxy DESC, customer_id) AS r,
       ntile(10) OVER (ORDER BY profit_adjusted_clv_proxy DESC, customer_id) AS clv_rank_decile FROM clv"""
CTES["l_dec"] = f"""
SELECT *, sum(clv_share) OVER (ORDER BY clv_rank_decile) AS cumulative_clv_share,
       sum(future_churned_clv_share) OVER (ORDER BY clv_rank_decile) AS cumulative_future_churned_clv_share
FROM (SELECT clv_rank_decile, {LEAK}, {SIGNALS}, {AVERAGES},
             sum(profit_adjusted_clv_proxy)/(SELECT nullif(sum(profit_adjusted_clv_proxy), 0) FROM clv) AS clv_share,
             sum(future_churned_clv_proxy)/(SELECT nullif(sum(future_churned_clv_proxy), 0) FROM clv)
               AS future_churned_clv_share
      FROM l_ranked GROUP BY 1)"""
_tops = constants(k.CONCENTRATION_PERMILLE, ["VARCHAR", "BIGINT"])
CTES["l_top"] = f"""
SELECT t.label AS threshold_label, t.pm/1000.0::DOUBLE AS threshold_pct, count(*) AS customers,
       sum(c.profit_adjusted_clv_proxy) AS profit_adjusted_clv_proxy,
       sum(c.future_churned_clv_proxy) AS future_churned_clv_proxy,
       sum(c.profit_adjusted_clv_proxy)/max(w.v) AS clv_share,
       sum(c.future_churned_clv_proxy)/max(w.l) AS future_churned_clv_share,
       avg(c.churn_next_period) AS future_churn_rate, avg(c.monthly_value_baseline) AS avg_monthly_value_baseline,
       avg(c.engagement_score) AS avg_engagement_score
FROM l_ranked c
CROSS JOIN (SELECT count(*) AS n, sum(profit_adjusted_clv_proxy) AS v, sum(future_churned_clv_proxy) AS l FROM clv) w
JOIN ({_tops}) t(label, pm) ON c.r <= (w.n*t.pm + 999)//1000
GROUP BY t.label, t.pm"""
LEAK_READOUT = when([
    (f"retention_budget_tier = '{k.PREMIUM_BUDGET}' AND future_churn_rate >= 0.10", "Model should prioritize"),
    ("value_based_action_group = 'Suppress paid offer'", "Suppress from paid retention"),
    ("cancellation_signal_rate >= 0.50", "Win-back strategy needed"),
    ("no_recent_activity_rate >= 0.50", "Reactivation strategy needed"),
    ("future_churn_rate < 0.03", "Monitor, do not overspend")], "Watchlist segment")
CTES["l_driver"] = f"""
SELECT *, future_churned_clv_proxy*(1 + cancellation_signal_rate)*(1 + major_activity_drop_rate)
            AS leakage_priority_score, {LEAK_READOUT} AS leakage_strategy_readout
FROM (SELECT {SEG6}, {LEAK}, {SIGNALS}, {BEHAVIOUR}, avg(active_days) AS avg_active_days
      FROM clv GROUP BY {SEG6} HAVING count(*) >= {p.min_segment_rows})"""
_rec = constants(k.RECOVERY_SCENARIOS, ["VARCHAR", "DOUBLE"])
CTES["l_scen"] = f"""
SELECT scenario_name, recovery_rate, a AS portfolio_future_churned_clv_proxy,
       a*recovery_rate AS recoverable_portfolio_clv_proxy, b AS premium_budget_future_churned_clv_proxy,
       b*recovery_rate AS recoverable_premium_budget_clv_proxy,
       c AS premium_plus_moderate_future_churned_clv_proxy,
       c*recovery_rate AS recoverable_premium_plus_moderate_clv_proxy
FROM (SELECT sum(future_churned_clv_proxy) AS a,
             sum(future_churned_clv_proxy) FILTER (retention_budget_tier = '{k.PREMIUM_BUDGET}') AS b,
             sum(future_churned_clv_proxy) FILTER (retention_budget_tier IN
               {among(k.PREMIUM_BUDGET, k.MODERATE_BUDGET)}) AS c FROM clv),
     ({_rec}) s(scenario_name, recovery_rate)"""
_plan = constants([(b.tier, b.cost_per_customer, b.recovery_rate, b.model_weight) for b in p.budget_tiers],
                  ["VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE"])
CTES["plan_rows"] = f"SELECT * FROM ({_plan}) t(tier, cost, recovery, weight)"
CTES["l_budget"] = """
SELECT *, CASE WHEN campaign_cost_proxy > 0 THEN net_recovery_opportunity_proxy/campaign_cost_proxy END AS roi_proxy
FROM (SELECT g.*, cost AS campaign_cost_per_customer, recovery AS expected_recovery_rate,
             customers*cost AS campaign_cost_proxy, future_churned_clv_proxy*recovery AS recoverable_clv_proxy,
             future_churned_clv_proxy*recovery - customers*cost AS net_recovery_opportunity_proxy,
             CASE WHEN future_churned_clv_proxy > 0 THEN customers*cost/future_churned_clv_proxy END
               AS break_even_recovery_rate
      FROM (SELECT retention_budget_tier, count(*) AS customers, avg(churn_next_period) AS future_churn_rate,
                   sum(profit_adjusted_clv_proxy) AS profit_adjusted_clv_proxy,
                   sum(future_churned_clv_proxy) AS future_churned_clv_proxy,
                   avg(engagement_score) AS avg_engagement_score,
                   avg(cancellation_signal) AS cancellation_signal_rate FROM clv GROUP BY 1) g
      JOIN plan_rows ON tier = retention_budget_tier)"""
ADVICE = when([
    (f"retention_budget_tier = '{k.PREMIUM_BUDGET}' AND future_churned_clv_proxy > {p.large_value}",
     "Highest priority for churn model"),
    (f"retention_budget_tier = '{k.MODERATE_BUDGET}' AND future_churned_clv_proxy > {p.large_value}",
     "Secondary model priority"),
    ("value_based_action_group = 'Suppress paid offer'", "Exclude from paid-retention model action"),
    (f"retention_budget_tier = '{k.AUTOMATION_BUDGET}'", "Use for low-cost lifecycle automation"),
], "Monitor segment")
REASON = when([
    (f"retention_budget_tier = '{k.PREMIUM_BUDGET}'", "Much value at stake: worth telling leavers from stayers."),
    (f"retention_budget_tier = '{k.MODERATE_BUDGET}'",
     "Some value at stake: scores save campaign cost."),
    (f"retention_budget_tier = '{k.AUTOMATION_BUDGET}'", "Little value each: automated messages only."),
    ("value_based_action_group = 'Suppress paid offer'", "Nothing to lose: no paid offers."),
], "Use as monitoring population.")
CTES["l_prio"] = f"""
SELECT g.*, future_churned_clv_proxy*(1 + future_churn_rate)*weight AS model_priority_score,
       {ADVICE} AS model_priority_recommendation, {REASON} AS modeling_reason
FROM (SELECT {SEG6}, {LEAK}, {SIGNALS}, avg(monthly_value_baseline) AS avg_monthly_value_baseline,
             avg(no_recent_activity_flag) AS no_recent_activity_rate
      FROM clv GROUP BY {SEG6} HAVING count(*) >= {p.min_segment_rows}) g
JOIN plan_rows ON tier = retention_budget_tier"""

Q["leak_portfolio_summary"] = "SELECT * FROM l_all"
Q["leak_by_clv_tier"] = f"""
SELECT clv_value_tier, retention_budget_tier, {LEAK}, {RATE}, {BASES}, {SIGNALS} FROM clv GROUP BY 1, 2"""
Q["leak_by_action_group"] = "SELECT * FROM l_action"
Q["leak_segment_matrix"] = SEGMENT_TABLE + str(p.min_segment_rows)
Q["leak_clv_concentration_deciles"] = "SELECT * FROM l_dec"
Q["leak_driver_scores"] = "SELECT * FROM l_driver"
Q["leak_budget_pressure"] = f"""
SELECT retention_budget_tier, {LEAK}, {RATE}, {BASES}, avg(engagement_score) AS avg_engagement_score,
       avg(cancellation_signal) AS cancellation_signal_rate FROM clv GROUP BY 1"""
Q["leak_monthly_value_trend"] = """
SELECT m.snapshot_month, count(DISTINCT m.customer_id) AS observed_customers,
       sum(m.monthly_revenue) AS observed_monthly_revenue_proxy,
       sum(m.monthly_revenue*c.gross_margin_rate) AS observed_monthly_margin_proxy,
       avg(m.churn_next_period) AS future_churn_label_rate,
       sum(m.monthly_revenue*m.churn_next_period) AS future_churned_monthly_revenue_proxy,
       sum(m.monthly_revenue*c.gross_margin_rate*m.churn_next_period) AS future_churned_monthly_margin_proxy,
       avg(m.engagement_score) AS avg_engagement_score, avg(m.had_cancel) AS cancel_signal_rate
FROM cm m LEFT JOIN clv c USING (customer_id) GROUP BY 1"""
Q["leak_leakage_base"] = SEGMENT_TABLE + str(p.min_export_rows)
Q["leak_concentration_thresholds"] = "SELECT * FROM l_top"
Q["leak_recoverable_scenarios"] = "SELECT * FROM l_scen"
Q["leak_budget_opportunity"] = "SELECT * FROM l_budget"
Q["leak_model_priority_segments"] = "SELECT * FROM l_prio"


def picked(alias: str, prefix: str, names) -> str:
    return ", ".join(f"{alias}.{n} AS {prefix}_{n}" for n in names)


_s4 = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier"]
_sh = ["customers", "clv_share", "future_churned_clv_share"]
Q["leak_leakage_headline"] = f"""
SELECT w.customers, w.future_churn_rate, w.annual_revenue_run_rate_proxy, w.annual_margin_run_rate_proxy,
  w.profit_adjusted_clv_proxy, w.future_churned_clv_proxy, w.clv_leakage_rate,
  {picked('a', 'top_action', ['value_based_action_group', 'retention_budget_tier', 'customers',
                              'future_churn_rate', 'future_churned_clv_proxy'])},
  {picked('d', 'top_driver', [*_s4, 'value_based_action_group', 'customers', 'future_churn_rate',
                              'future_churned_clv_proxy', 'leakage_strategy_readout'])},
  {picked('x', 'top_decile', [*_sh, 'future_churn_rate'])},
  {picked('t5', 'top_5', _sh)}, {picked('t10', 'top_10', _sh)},
  {picked('s', 'base_recovery', ['recovery_rate', 'recoverable_portfolio_clv_proxy',
                                 'recoverable_premium_budget_clv_proxy'])},
  {picked('b', 'best_budget', ['retention_budget_tier', 'campaign_cost_proxy', 'recoverable_clv_proxy',
                               'net_recovery_opportunity_proxy', 'roi_proxy'])},
  {picked('m', 'top_priority', [*_s4, 'customers', 'future_churned_clv_proxy', 'model_priority_recommendation'])}
FROM l_all w, (SELECT * FROM l_action ORDER BY future_churned_clv_proxy DESC LIMIT 1) a,
  (SELECT * FROM l_driver ORDER BY leakage_priority_score DESC LIMIT 1) d,
  (SELECT * FROM l_dec WHERE clv_rank_decile = 1) x, (SELECT * FROM l_top WHERE threshold_label = 'Top 5%') t5,
  (SELECT * FROM l_top WHERE threshold_label = 'Top 10%') t10,
  (SELECT * FROM l_scen WHERE scenario_name = 'Base recovery') s,
  (SELECT * FROM l_budget ORDER BY net_recovery_opportunity_proxy DESC LIMIT 1) b,
  (SELECT * FROM l_prio ORDER BY model_priority_score DESC LIMIT 1) m"""

# Distinct customers of every period, counted from the customer rows themselves.
_month_date = "strptime(snapshot_month || '-01', '%Y-%m-%d')"
_periods = [
    ("month", "snapshot_month"), ("quarter", f"strftime({_month_date}, '%Y') || '-Q' || quarter({_month_date})"),
    ("year", f"strftime({_month_date}, '%Y')"), ("all", "'All'"),
    *(("trailing_3_months", f"strftime({_month_date} + INTERVAL {n} MONTH, '%Y-%m')") for n in range(3)),
]
CTES["customer_periods"] = "\nUNION ALL ".join(
    f"SELECT '{kind}' AS kind, {period} AS period, {tier} AS engagement_tier, customer_id FROM cm"
    for kind, period in _periods for tier in ("engagement_tier", "'All'"))
Q["cohort_distinct_rollups"] = f"""
SELECT kind, period, engagement_tier, count(DISTINCT customer_id) AS customers FROM customer_periods
WHERE kind <> 'trailing_3_months' OR period IN (SELECT snapshot_month FROM cm) GROUP BY 1, 2, 3
UNION ALL
SELECT 'retained', l.snapshot_month, 'All', count(DISTINCT l.customer_id)
FROM cm l JOIN cm e ON e.customer_id = l.customer_id
  AND strftime(strptime(e.snapshot_month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') = l.snapshot_month GROUP BY 2"""
