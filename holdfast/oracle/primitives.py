"""DuckDB text for the building-block queries."""

from __future__ import annotations

from holdfast.config import FIXTURE as p
from holdfast.operators.validation import SIGNAL_FAMILIES
from holdfast.oracle.base import months, qcut, unit_hash
from holdfast.oracle.compose import among, count_text, fixed, money, percent, times, when
from holdfast.oracle.decisions import Q as DECISION_QUERIES
from holdfast.oracle.decisions import erf_cdf

CTES: dict[str, str] = {}
Q: dict[str, str] = {}

CTES["pm"] = """
SELECT *, row_number() OVER w AS row_no, count(*) OVER () AS n, ntile(10) OVER w AS tile,
       sum(monthly_revenue) OVER w AS revenue_so_far
FROM cm WINDOW w AS (ORDER BY active_days DESC, monthly_revenue DESC, customer_id, snapshot_month)"""

Q["prim_csv_scan"] = "SELECT customer_id AS msno, is_churn FROM labels_c"
Q["prim_csv_scan_chunked"] = """
SELECT customer_id AS msno, count(*) AS log_rows, count(DISTINCT day) AS days, sum(num_unq) AS num_unq,
       sum(total_secs) AS total_secs FROM in_logs GROUP BY 1"""
Q["prim_csv_scan_projected"] = """
SELECT customer_id AS msno, strftime(day, '%Y%m%d')::INTEGER AS date, total_secs FROM in_logs"""
Q["prim_parquet_scan"] = "SELECT customer_id, snapshot_month, total_secs FROM cm WHERE monthly_revenue > 0"
Q["prim_staged_csv_reread"] = "SELECT * FROM frontier"
Q["prim_parquet_sink"] = """
SELECT customer_id, snapshot_month, monthly_revenue, engagement_score FROM cm"""
Q["prim_csv_sink"] = """
SELECT customer_id, churn_next_period, snapshot_month, city, age, monthly_revenue, lifecycle_stage FROM snap"""
Q["prim_top_sample_sink"] = f"""
SELECT customer_id, profit_adjusted_clv_proxy, clv_value_tier FROM clv
ORDER BY profit_adjusted_clv_proxy DESC, customer_id LIMIT {p.sample_rows}"""
Q["prim_named_table"] = """
SELECT lifecycle_stage, count(*) AS customer_months, sum(monthly_revenue) AS revenue FROM cm GROUP BY 1"""
Q["prim_row_number_global"] = "SELECT customer_id, snapshot_month, row_no FROM pm"
Q["prim_running_sum_global"] = "SELECT customer_id, snapshot_month, revenue_so_far FROM pm"
Q["prim_ntile_global"] = "SELECT customer_id, snapshot_month, tile FROM pm"
Q["prim_bucket_without_join"] = "SELECT customer_id, snapshot_month, tile FROM pm"
Q["prim_quantile_cut_global"] = f"SELECT customer_id, snapshot_month, {qcut('row_no', 'n')} AS bucket FROM pm"
Q["prim_top_percent"] = """
SELECT customer_id, snapshot_month, row_no FROM pm WHERE row_no <= greatest(1, n*50//1000)"""
Q["prim_totals_beside_rows"] = """
SELECT customer_id, snapshot_month, count(*) OVER () AS all_rows,
       monthly_revenue/sum(monthly_revenue) OVER () AS revenue_share FROM cm"""
Q["prim_random_sample"] = f"""
SELECT customer_id FROM splitted WHERE in_test
ORDER BY {unit_hash(f'{p.model.seed}-sample')}, customer_id LIMIT {p.sample_rows}"""
Q["prim_group_top_row"] = """
SELECT customer_id, snapshot_month, monthly_revenue FROM cm
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY monthly_revenue DESC, snapshot_month DESC) = 1"""
Q["prim_argmax_row"] = """
SELECT customer_id, snapshot_month, monthly_revenue FROM cm
ORDER BY monthly_revenue DESC, customer_id DESC, snapshot_month DESC LIMIT 1"""
Q["prim_conditional_aggregates"] = """
SELECT clv_value_tier, sum(profit_adjusted_clv_proxy*churn_next_period) AS lost, sum(churn_next_period) AS churners,
       sum(profit_adjusted_clv_proxy*churn_next_period)/nullif(sum(profit_adjusted_clv_proxy), 0) AS loss_rate,
       var_samp(monthly_value_baseline) AS variance, median(expected_active_months_proxy) AS median_months
FROM clv GROUP BY 1"""
Q["prim_null_handling"] = """
SELECT customer_id, coalesce(age, 0) AS age_or_zero, nullif(gender, 'unknown') AS known_gender FROM members_c"""
Q["prim_lenient_cast"] = """
SELECT customer_id, coalesce(try_cast(x AS DOUBLE), 0) AS number, try_cast(x AS INTEGER) AS whole
FROM (SELECT customer_id, CASE WHEN city % 2 = 0 THEN city::VARCHAR ELSE gender END AS x FROM members_c)"""
Q["prim_date_functions"] = f"""
SELECT customer_id, transaction_date, transaction_date_dt AS day, transaction_month AS month,
       date_trunc('month', transaction_date_dt)::DATE AS month_start,
       {months('transaction_date_dt', 'membership_expire_date_dt')} AS months_to_expiry, NULL::DATE AS broken_day
FROM transactions_c"""
_age = "coalesce(age, 0)"
Q["prim_numeric_functions"] = f"""
SELECT customer_id, greatest(monthly_revenue, latest_actual_amount_paid) AS larger, least(age, 40) AS capped_age,
       least(greatest({_age}/100, 0.1::DOUBLE), 0.6::DOUBLE) AS clipped, ln(1 + monthly_revenue) AS log_revenue,
       ceil({_age}/7)::BIGINT AS ceiling, floor({_age}/7)::BIGINT AS floor, sqrt(monthly_revenue) AS root,
       abs({_age} - 50) AS distance, {erf_cdf(f'({_age} - 50)/20')} AS normal_share,
       num_25 + num_50 + num_75 + num_985 + num_100 AS plays
FROM snap"""
Q["prim_text_functions"] = f"""
SELECT customer_id, clv_value_tier || ' | ' || lifecycle_stage AS stratum,
       regexp_matches(value_based_action_group, 'Premium|High-value') AS is_premium,
       revenue_tier ILIKE '%high%' AS is_high, {money('profit_adjusted_clv_proxy')} AS money,
       {percent('completion_rate_proxy')} AS percent, {count_text('transaction_count')} AS count,
       {times('expected_active_months_proxy')} AS times, {fixed('engagement_score', 4)} AS four
FROM clv"""
Q["prim_unit_hash"] = f"SELECT customer_id, {unit_hash(p.ab_seed)} AS u FROM labels_c"
Q["prim_case_ladder"] = f"""
SELECT {when([('trailing_3mo_revenue < 1', 'none'), ('trailing_3mo_revenue < 100000', 'low'),
              ('trailing_3mo_revenue < 300000', 'middle')], 'high')} AS band, count(*) AS customers
FROM snap GROUP BY 1"""
_family = when([(f"feature IN {among(*names)}", family) for family, names in SIGNAL_FAMILIES.items()],
               "Other modeled signal")
Q["prim_feature_families"] = f"""
SELECT feature, {_family} AS signal_family, non_null_rows
FROM ({DECISION_QUERIES['churn_feature_leakage_audit']})"""
Q["prim_union_all"] = """
SELECT month, kind, count(*) AS rows FROM (
  SELECT transaction_month AS month, 'payment' AS kind FROM transactions_c
  UNION ALL SELECT activity_month, 'activity' FROM logs_c) GROUP BY 1, 2"""
