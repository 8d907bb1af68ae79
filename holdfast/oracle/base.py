"""DuckDB text of the shared tables: inputs, customer months, snapshot, value, score, saves, test.

Written apart from the Spark operators, as plain windows over whole tables.
"""

from __future__ import annotations

from holdfast import config as k
from holdfast.config import FIXTURE as p
from holdfast.oracle.compose import among, when

TOP = among(*k.TOP_VALUE)
ELEVATED = among(*k.ELEVATED_RISK)
e1, e2 = p.engagement_cuts
r1, r2 = p.revenue_cuts
t1, t2, t3 = p.tenure_cuts

MONTHS = "((year({b})-year({a}))*12 + month({b})-month({a}))"


def months(a: str, b: str) -> str:
    return MONTHS.format(a=a, b=b)


ENGAGEMENT_TIER = when(
    [("engagement_score = 0", k.NO_ACTIVITY), (f"engagement_score < {e1}", k.ENGAGEMENT_TIERS[0]),
     (f"engagement_score < {e2}", k.ENGAGEMENT_TIERS[1])], k.ENGAGEMENT_TIERS[2])
REVENUE_TIER = when(
    [("monthly_revenue = 0", k.NO_REVENUE), (f"monthly_revenue < {r1}", k.REVENUE_TIERS[0]),
     (f"monthly_revenue < {r2}", k.REVENUE_TIERS[1])], k.REVENUE_TIERS[2])
STAGE = when(
    [("tenure_months IS NULL", k.UNKNOWN_TENURE), (f"tenure_months < {t1}", k.LIFECYCLE_STAGES[0]),
     (f"tenure_months < {t2}", k.LIFECYCLE_STAGES[1]), (f"tenure_months < {t3}", k.LIFECYCLE_STAGES[2])],
    k.LIFECYCLE_STAGES[3])


PAYMENTS = ("transaction_count", "monthly_revenue", "monthly_list_price", "monthly_discount_amount",
            "avg_plan_days", "max_plan_days", "avg_paid_per_day", "is_auto_renew", "had_cancel", "had_discount")
ACTIVITY = ("active_days", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs",
            "total_plays", "completion_rate_proxy", "engagement_score")
TRENDS = ("prior_month_engagement_score", "prior_month_total_secs", "prior_month_revenue",
          "trailing_3mo_engagement_score", "trailing_3mo_revenue", "trailing_3mo_active_days",
          "engagement_change_pct", "activity_change_pct", "revenue_change_pct")


def zeros(alias: str, names) -> str:
    return ", ".join(f"coalesce({alias}.{n}, 0) AS {n}" for n in names)


DECILE = "monthly_value_decile"
ACTION_GROUP = when([
    ("monthly_value_baseline <= 0", "Suppress paid offer"),
    (f"{DECILE} >= 9 AND cancellation_signal = 1", "Premium win-back"),
    (f"{DECILE} >= 9 AND no_recent_activity_flag = 1", "High-value reactivation"),
    (f"{DECILE} >= 9", "Protect high-value customer"),
    (f"{DECILE} >= 7 AND major_activity_drop_flag = 1", "Save intervention candidate"),
    (f"{DECILE} >= 7", "Targeted retention nurture"),
    (f"{DECILE} <= 3", "Low-cost automated retention"),
], "Standard lifecycle nurture")
VALUE_TIER = when([
    ("monthly_value_baseline <= 0", k.NO_VALUE), (f"{DECILE} >= 9", k.ELITE_VALUE),
    (f"{DECILE} >= 7", k.HIGH_VALUE), (f"{DECILE} >= 4", k.CORE_VALUE)], k.LOW_VALUE)
BUDGET_TIER = when([
    ("monthly_value_baseline <= 0", k.NO_BUDGET), (f"{DECILE} >= 9", k.PREMIUM_BUDGET),
    (f"{DECILE} >= 7", k.MODERATE_BUDGET), (f"{DECILE} >= 4", k.LOW_COST_BUDGET)], k.AUTOMATION_BUDGET)

QUADRANT = when([
    (f"churn_risk_tier IN {ELEVATED} AND clv_value_tier IN {TOP}", k.QUADRANT_HH),
    (f"churn_risk_tier IN {ELEVATED} AND clv_value_tier IN {among(k.LOW_VALUE, k.NO_VALUE)}", k.QUADRANT_HL),
    (f"churn_risk_tier = '{k.LOW_RISK}' AND clv_value_tier IN {TOP}", k.QUADRANT_LH),
    (f"churn_risk_tier = '{k.MEDIUM_RISK}' AND clv_value_tier IN {TOP}", k.QUADRANT_MH)], k.QUADRANT_REST)
READOUT = when([
    (f"churn_risk_tier = '{k.CRITICAL}' AND clv_value_tier IN {TOP}", "Immediate save-worthiness review"),
    (f"churn_risk_tier IN {ELEVATED} AND retention_budget_tier = '{k.PREMIUM_BUDGET}'",
     "Premium save timing analysis"),
    (f"churn_risk_tier IN {ELEVATED} AND retention_budget_tier IN {among(k.AUTOMATION_BUDGET, k.NO_BUDGET)}",
     "Do not overspend"),
    (f"churn_risk_tier = '{k.LOW_RISK}' AND clv_value_tier IN {TOP}", "Protect without discount"),
], "Monitor lifecycle trend")
ACTION = when([
    (f"profit_adjusted_clv_proxy <= 0 OR retention_budget_tier = '{k.NO_BUDGET}'", k.SUPPRESS),
    (f"churn_risk_tier = '{k.CRITICAL}' AND clv_value_tier IN {TOP} "
     f"AND retention_budget_tier = '{k.PREMIUM_BUDGET}'", k.PREMIUM_SAVE),
    (f"churn_risk_tier IN {ELEVATED} AND clv_value_tier IN {TOP} "
     "AND value_based_action_group = 'Premium win-back'", k.WIN_BACK),
    (f"churn_risk_tier IN {ELEVATED} AND clv_value_tier IN {TOP} "
     f"AND retention_budget_tier = '{k.PREMIUM_BUDGET}'", k.TARGETED),
    (f"churn_risk_tier IN {ELEVATED} AND clv_value_tier IN {among(*k.TOP_VALUE, k.CORE_VALUE)} "
     f"AND retention_budget_tier = '{k.MODERATE_BUDGET}'", k.NURTURE),
    (f"churn_risk_tier IN {ELEVATED} AND retention_budget_tier = '{k.AUTOMATION_BUDGET}'", k.AUTOMATED),
    (f"value_risk_quadrant = '{k.QUADRANT_LH}'", k.PROTECT)], k.MONITOR)
SUPPRESSION = when([
    (f"recommended_retention_action = '{k.SUPPRESS}' AND profit_adjusted_clv_proxy <= 0", "No positive CLV proxy"),
    (f"recommended_retention_action = '{k.SUPPRESS}' AND retention_budget_tier = '{k.NO_BUDGET}'",
     "No paid budget tier"),
    ("intervention_cost_proxy > 0 AND net_save_value_proxy <= 0",
     "Expected save value does not clear intervention cost"),
    (f"recommended_retention_action = '{k.MONITOR}'", "Monitor only before ROI testing")], "Not suppressed")
SAVE_TIER = when([
    (f"recommended_retention_action = '{k.PROTECT}'", k.TIER_PROTECT),
    (f"recommended_retention_action = '{k.SUPPRESS}'", k.TIER_SUPPRESSED),
    ("place <= 0.01", k.TIER_1), ("place <= 0.05", k.TIER_2), ("place <= 0.10", k.TIER_3),
    ("place <= 0.20", k.TIER_4), ("place IS NOT NULL", k.TIER_POOL)], k.TIER_NONE)
TARGETING = when([
    (f"save_priority_tier = '{tier}'", text) for tier, text in (
        (k.TIER_1, "Highest expected economic save opportunity"), (k.TIER_2, "Strong paid-retention candidate"),
        (k.TIER_3, "Targeted paid-retention candidate"), (k.TIER_4, "Use for controlled campaign testing"),
        (k.TIER_SUPPRESSED, "Do not spend paid retention budget"),
        (k.TIER_PROTECT, "Protect experience, avoid discounting"))
], "Monitor until ROI simulation")


def constants(rows, types) -> str:
    """VALUES list with explicit types."""
    def cell(v, t):
        return f"{v!r}::{t}" if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join(
        "(" + ", ".join(cell(v, t) for v, t in zip(row, types)) + ")" for row in rows)


def qcut(rank: str, n: str, buckets: int = 10) -> str:
    """Equal-quantile bucket of rank 1..n in whole-number arithmetic."""
    return (f"greatest(1, CASE WHEN {n} <= 1 THEN 1 "
            f"ELSE ({buckets}*({rank}-1) + ({n}-1) - 1) // ({n}-1) END)")


def score(cancel_weight: float) -> str:
    """The planning scorecard over columns named like its inputs."""
    z = (f"(-1.5::DOUBLE + {cancel_weight}::DOUBLE*cancellation_signal_flag - 1.0::DOUBLE*auto_renew_signal "
         "+ 0.8::DOUBLE*no_recent_activity_flag + 0.6::DOUBLE*major_activity_drop_flag "
         "- 0.03::DOUBLE*least(coalesce(tenure_months, 0), 24))")
    return f"round(1.0::DOUBLE/(1.0::DOUBLE + exp(-{z})), 6)"


def unit_hash(seed: str, column: str = "customer_id") -> str:
    return (f"(('0x' || substr(sha256('{seed}|' || {column}), 1, 16))::UBIGINT)::DOUBLE "
            "/ 18446744073709551615::DOUBLE")


CTES: dict[str, str] = {}

CTES["in_labels"] = """
SELECT c_custkey::VARCHAR AS customer_id,
       CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey
                         AND o.o_orderdate >= TIMESTAMP '2000-08-01') THEN 0 ELSE 1 END AS is_churn
FROM customer"""
CTES["in_members"] = """
SELECT c_custkey::VARCHAR AS customer_id, c_nationkey AS city, floor(c_acctbal/100)::INTEGER AS bd,
       CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 4 WHEN 'FURNITURE' THEN 7
            WHEN 'HOUSEHOLD' THEN 9 ELSE 13 END AS registered_via,
       coalesce((SELECT min(o_orderdate)::DATE FROM orders o
                 WHERE o.o_custkey = c_custkey AND o.o_orderdate < TIMESTAMP '2000-08-01'),
                (DATE '2000-07-01' - to_months(((c_custkey*7) % 48)::INTEGER))::DATE) AS registration_date
FROM customer"""
CTES["in_transactions"] = """
SELECT o_custkey::VARCHAR AS customer_id, (1 + o_orderkey % 5)::INTEGER AS payment_method_id,
       (CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 30*(1 + o_orderkey % 3) END)::INTEGER AS payment_plan_days,
       coalesce(price, 0) AS plan_list_price, coalesce(paid, 0) AS actual_amount_paid,
       (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER AS is_auto_renew,
       (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')::INTEGER AS is_cancel,
       o_orderdate::DATE AS transaction_date_dt
FROM orders
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS price, sum(l_extendedprice*(1-l_discount)) AS paid
           FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderdate < TIMESTAMP '2000-08-01'"""
CTES["in_logs"] = """
SELECT user_id::VARCHAR AS customer_id, (ts::DATE - to_months(282))::DATE AS day,
       (event_type='view')::INTEGER AS num_25, (event_type='click')::INTEGER AS num_50,
       (event_type='signup')::INTEGER AS num_75, (event_type='error')::INTEGER AS num_985,
       (event_type='purchase')::INTEGER AS num_100, 1 AS num_unq, value*60 AS total_secs
FROM events"""

CTES["labels_c"] = "SELECT customer_id, is_churn FROM in_labels"
CTES["members_c"] = """
SELECT customer_id, coalesce(city, 0) AS city,
       CASE WHEN bd > 0 AND bd <= 100 THEN bd::DOUBLE END AS age,
       coalesce(gender, 'unknown') AS gender, coalesce(registered_via, 0) AS registered_via, registration_date
FROM in_members WHERE customer_id IN (SELECT customer_id FROM labels_c)
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY registration_date DESC NULLS LAST, city DESC) = 1"""
CTES["transactions_c"] = """
SELECT customer_id, payment_method_id, payment_plan_days, is_auto_renew, is_cancel, plan_list_price,
       actual_amount_paid,
       strftime(transaction_date_dt, '%Y%m%d')::INTEGER AS transaction_date,
       strftime(transaction_date_dt + payment_plan_days, '%Y%m%d')::INTEGER AS membership_expire_date,
       transaction_date_dt, (transaction_date_dt + payment_plan_days)::DATE AS membership_expire_date_dt,
       strftime(transaction_date_dt, '%Y-%m') AS transaction_month,
       strftime(transaction_date_dt + payment_plan_days, '%Y-%m') AS expire_month,
       plan_list_price - actual_amount_paid AS discount_amount,
       (plan_list_price - actual_amount_paid > 0)::INTEGER AS is_discounted,
       CASE WHEN payment_plan_days > 0 THEN actual_amount_paid/payment_plan_days ELSE 0 END AS paid_per_day
FROM in_transactions SEMI JOIN labels_c USING (customer_id)"""
CTES["activity_c"] = """
SELECT customer_id, strftime(day, '%Y-%m') AS activity_month, count(DISTINCT day) AS active_days,
       sum(num_25)::BIGINT AS num_25, sum(num_50)::BIGINT AS num_50, sum(num_75)::BIGINT AS num_75,
       sum(num_985)::BIGINT AS num_985, sum(num_100)::BIGINT AS num_100, sum(num_unq)::BIGINT AS num_unq,
       sum(total_secs) AS total_secs, sum(num_25+num_50+num_75+num_985+num_100)::BIGINT AS total_plays
FROM in_logs SEMI JOIN labels_c USING (customer_id) GROUP BY ALL"""
CTES["logs_c"] = """
SELECT *, CASE WHEN total_plays > 0 THEN num_100::DOUBLE/total_plays ELSE 0 END AS completion_rate_proxy,
       round(ln(1+total_secs) + 0.25::DOUBLE*ln(1+num_unq) + 0.5::DOUBLE*ln(1+active_days), 9) AS engagement_score
FROM activity_c"""

CTES["pay_month"] = """
SELECT customer_id, transaction_month AS snapshot_month, count(*) AS transaction_count,
       sum(actual_amount_paid) AS monthly_revenue, sum(plan_list_price) AS monthly_list_price,
       sum(discount_amount) AS monthly_discount_amount, avg(payment_plan_days) AS avg_plan_days,
       max(payment_plan_days) AS max_plan_days, avg(paid_per_day) AS avg_paid_per_day,
       max(is_auto_renew) AS is_auto_renew, max(is_cancel) AS had_cancel, max(is_discounted) AS had_discount,
       max(transaction_date_dt) AS latest_transaction_date,
       max(membership_expire_date_dt) AS latest_membership_expire_date
FROM transactions_c WHERE transaction_month IS NOT NULL GROUP BY ALL"""
CTES["month_keys"] = """
SELECT customer_id, snapshot_month FROM pay_month
UNION SELECT customer_id, activity_month FROM logs_c"""
CTES["cm_base"] = f"""
SELECT x.customer_id, x.snapshot_month, strptime(x.snapshot_month || '-01', '%Y-%m-%d')::DATE AS snapshot_month_date,
       m.city, m.age, m.gender, m.registered_via, m.registration_date,
       {months('m.registration_date', "strptime(x.snapshot_month || '-01', '%Y-%m-%d')::DATE")} AS tenure_months,
       {zeros('t', PAYMENTS)}, t.latest_transaction_date, t.latest_membership_expire_date,
       {zeros('a', ACTIVITY)}, l.is_churn AS churn_next_period
FROM month_keys x
LEFT JOIN pay_month t ON t.customer_id = x.customer_id AND t.snapshot_month = x.snapshot_month
LEFT JOIN logs_c a ON a.customer_id = x.customer_id AND a.activity_month = x.snapshot_month
LEFT JOIN members_c m ON m.customer_id = x.customer_id
LEFT JOIN labels_c l ON l.customer_id = x.customer_id"""
CTES["cm_features"] = """
SELECT *, lag(engagement_score) OVER w AS prior_month_engagement_score,
       lag(total_secs) OVER w AS prior_month_total_secs, lag(monthly_revenue) OVER w AS prior_month_revenue,
       avg(engagement_score) OVER w3 AS trailing_3mo_engagement_score,
       sum(monthly_revenue) OVER w3 AS trailing_3mo_revenue,
       sum(active_days) OVER w3 AS trailing_3mo_active_days
FROM cm_base
WINDOW w AS (PARTITION BY customer_id ORDER BY snapshot_month),
       w3 AS (PARTITION BY customer_id ORDER BY snapshot_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
CTES["cm"] = f"""
SELECT *, (engagement_score - prior_month_engagement_score)/nullif(prior_month_engagement_score, 0)
            AS engagement_change_pct,
       (total_secs - prior_month_total_secs)/nullif(prior_month_total_secs, 0) AS activity_change_pct,
       (monthly_revenue - prior_month_revenue)/nullif(prior_month_revenue, 0) AS revenue_change_pct,
       {ENGAGEMENT_TIER} AS engagement_tier, {REVENUE_TIER} AS revenue_tier, {STAGE} AS lifecycle_stage
FROM cm_features"""
CTES["cm_latest"] = """
SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_month_date DESC) = 1"""
CTES["tx_latest"] = """
SELECT customer_id, payment_method_id, payment_plan_days AS latest_payment_plan_days,
       plan_list_price AS latest_plan_list_price, actual_amount_paid AS latest_actual_amount_paid,
       is_auto_renew AS latest_is_auto_renew, is_cancel AS latest_is_cancel,
       transaction_date_dt AS latest_transaction_date_raw,
       membership_expire_date_dt AS latest_membership_expire_date_raw
FROM transactions_c
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date_dt DESC NULLS LAST,
  membership_expire_date_dt DESC NULLS LAST, payment_method_id DESC, payment_plan_days DESC,
  plan_list_price DESC, actual_amount_paid DESC, is_auto_renew DESC, is_cancel DESC) = 1"""
CTES["snap_filled"] = f"""
SELECT l.customer_id, l.is_churn AS churn_next_period, coalesce(c.snapshot_month, '{k.NO_MONTH}') AS snapshot_month,
       c.snapshot_month_date, m.city, m.age, m.gender, m.registered_via, m.registration_date,
       coalesce(c.tenure_months, {months('m.registration_date', f"DATE '{p.snapshot_date}'")}) AS tenure_months,
       {zeros('c', (*PAYMENTS, *ACTIVITY, *TRENDS))},
       coalesce(c.engagement_tier, '{k.NO_ACTIVITY}') AS engagement_tier,
       coalesce(c.revenue_tier, '{k.NO_REVENUE}') AS revenue_tier,
       coalesce(c.lifecycle_stage, '{k.UNKNOWN_TENURE}') AS lifecycle_stage, t.payment_method_id,
       {zeros('t', ('latest_payment_plan_days', 'latest_plan_list_price', 'latest_actual_amount_paid',
                    'latest_is_auto_renew', 'latest_is_cancel'))},
       t.latest_transaction_date_raw, t.latest_membership_expire_date_raw
FROM labels_c l LEFT JOIN cm_latest c USING (customer_id) LEFT JOIN members_c m USING (customer_id)
LEFT JOIN tx_latest t USING (customer_id)"""
CTES["snap"] = """
SELECT *, (engagement_score = 0)::INTEGER AS no_recent_activity_flag,
       (had_cancel = 1 OR latest_is_cancel = 1)::INTEGER AS cancellation_signal_flag,
       (activity_change_pct <= -0.5)::INTEGER AS major_activity_drop_flag
FROM snap_filled"""

a = p.clv
CTES["valued"] = """
SELECT *, greatest(monthly_revenue, trailing_3mo_revenue/3, latest_actual_amount_paid) AS monthly_value_baseline,
       greatest(engagement_score, trailing_3mo_engagement_score) AS engagement_value_baseline,
       greatest(is_auto_renew, latest_is_auto_renew) AS auto_renew_signal,
       greatest(had_cancel, latest_is_cancel, cancellation_signal_flag) AS cancellation_signal
FROM snap"""
CTES["deciled"] = """
SELECT *, ntile(10) OVER (ORDER BY monthly_value_baseline, customer_id) AS monthly_value_decile,
       ntile(10) OVER (ORDER BY engagement_value_baseline, customer_id) AS engagement_decile
FROM valued"""
CTES["with_months"] = f"""
SELECT *, least({a.max_months}::DOUBLE, greatest(1.0::DOUBLE, {a.base_months}::DOUBLE
   + {a.engagement_weight}::DOUBLE*engagement_decile
   + CASE WHEN auto_renew_signal = 1 THEN {a.auto_renew_bonus}::DOUBLE ELSE 0 END
   + CASE WHEN tenure_months >= 24 THEN {a.long_tenure_bonus}::DOUBLE
          WHEN tenure_months >= 6 THEN {a.established_bonus}::DOUBLE ELSE 0 END
   + CASE WHEN cancellation_signal = 1 THEN {a.cancellation_penalty}::DOUBLE ELSE 0 END
   + CASE WHEN major_activity_drop_flag = 1 THEN {a.activity_drop_penalty}::DOUBLE ELSE 0 END
  )) AS expected_active_months_proxy
FROM deciled"""
CTES["clv"] = f"""
SELECT customer_id, churn_next_period, snapshot_month, snapshot_month_date, city, age, gender, registered_via,
       registration_date, tenure_months, lifecycle_stage, transaction_count, monthly_revenue, monthly_list_price,
       monthly_discount_amount, avg_plan_days, max_plan_days, avg_paid_per_day, is_auto_renew, had_cancel,
       had_discount, latest_payment_plan_days, latest_plan_list_price, latest_actual_amount_paid,
       latest_is_auto_renew, latest_is_cancel, latest_transaction_date_raw, latest_membership_expire_date_raw,
       active_days, total_secs, total_plays, num_unq, completion_rate_proxy, engagement_score,
       trailing_3mo_engagement_score, trailing_3mo_revenue, trailing_3mo_active_days, engagement_change_pct,
       activity_change_pct, revenue_change_pct, engagement_tier, revenue_tier, no_recent_activity_flag,
       cancellation_signal_flag, major_activity_drop_flag, monthly_value_baseline, engagement_value_baseline,
       auto_renew_signal, cancellation_signal, monthly_value_decile, engagement_decile,
       {a.margin}::DOUBLE AS gross_margin_rate, expected_active_months_proxy,
       monthly_value_baseline*{a.margin}::DOUBLE AS monthly_margin_baseline,
       monthly_value_baseline*12 AS annual_revenue_run_rate_proxy,
       monthly_value_baseline*12*{a.margin}::DOUBLE AS annual_margin_run_rate_proxy,
       monthly_value_baseline*{a.margin}::DOUBLE*expected_active_months_proxy AS profit_adjusted_clv_proxy,
       CASE WHEN churn_next_period = 1
            THEN monthly_value_baseline*{a.margin}::DOUBLE*expected_active_months_proxy ELSE 0 END
         AS future_churned_clv_proxy,
       {VALUE_TIER} AS clv_value_tier, {ACTION_GROUP} AS value_based_action_group,
       {BUDGET_TIER} AS retention_budget_tier
FROM with_months"""

CTES["splitted"] = f"""
SELECT *, row_number() OVER (PARTITION BY churn_next_period ORDER BY {unit_hash(str(p.model.seed))}, customer_id)
          > count(*) OVER (PARTITION BY churn_next_period)*{1000 - p.model.test_permille}//1000 AS in_test
FROM clv"""
CTES["test_main"] = f"""
SELECT customer_id, churn_next_period AS y, {score(2.2)} AS s, profit_adjusted_clv_proxy AS v,
       future_churned_clv_proxy AS lost, monthly_value_baseline AS b FROM splitted WHERE in_test"""
CTES["test_other"] = f"""
SELECT customer_id, churn_next_period AS y, {score(0.0)} AS s, profit_adjusted_clv_proxy AS v,
       future_churned_clv_proxy AS lost, monthly_value_baseline AS b FROM splitted WHERE in_test"""
for _side in ("main", "other"):
    CTES[f"ranked_{_side}"] = f"""
SELECT *, row_number() OVER (ORDER BY s DESC, customer_id) AS r, count(*) OVER () AS n,
       sum(y) OVER () AS all_y, sum(lost) OVER () AS all_lost FROM test_{_side}"""
    # Pairs of (churner, other) for the area; one step per distinct score for average precision.
    CTES[f"metrics_{_side}"] = f"""
SELECT (SELECT avg(CASE WHEN c.s > o.s THEN 1.0::DOUBLE WHEN c.s = o.s THEN 0.5 ELSE 0 END)
        FROM test_{_side} c, test_{_side} o WHERE c.y = 1 AND o.y = 0) AS roc_auc,
       (SELECT sum(pos*cum::DOUBLE/seen)/max(cum) FROM (
          SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS cum, sum(c) OVER (ORDER BY s DESC) AS seen
          FROM (SELECT s, sum(y) AS pos, count(*) AS c FROM test_{_side} GROUP BY s))) AS pr_auc,
       avg((s-y)*(s-y)) AS brier_score,
       avg(-(y*ln(least(greatest(s, 1e-6::DOUBLE), 1-1e-6::DOUBLE))
             + (1-y)*ln(1-least(greatest(s, 1e-6::DOUBLE), 1-1e-6::DOUBLE)))) AS log_loss,
       avg((y = (s >= 0.5)::INTEGER)::INTEGER) AS accuracy_at_0_50,
       coalesce(sum(y) FILTER (s >= 0.5)::DOUBLE/nullif(count(*) FILTER (s >= 0.5), 0), 0) AS precision_at_0_50,
       coalesce(sum(y) FILTER (s >= 0.5)::DOUBLE/nullif(sum(y), 0), 0) AS recall_at_0_50,
       avg(y) AS test_churn_rate
FROM test_{_side}"""
    CTES[f"decs_{_side}"] = f"""
SELECT {qcut('r', 'n')} AS risk_decile, count(*) AS customers, avg(s) AS avg_predicted_churn_probability,
       avg(y) AS observed_churn_rate, sum(y) AS actual_churners, sum(v) AS profit_adjusted_clv_proxy,
       sum(lost) AS future_churned_clv_proxy, avg(v) AS avg_profit_adjusted_clv_proxy,
       avg(b) AS avg_monthly_value_baseline,
       avg(y)/(max(all_y)::DOUBLE/max(n)) AS lift_vs_portfolio, sum(y)::DOUBLE/max(all_y) AS churn_capture_share,
       coalesce(sum(lost)/nullif(max(all_lost), 0), 0) AS future_churned_clv_share
FROM ranked_{_side} GROUP BY 1"""
CTES["risk_dec"] = """
SELECT *, sum(churn_capture_share) OVER (ORDER BY risk_decile) AS cumulative_churn_capture_share,
       sum(future_churned_clv_share) OVER (ORDER BY risk_decile) AS cumulative_future_churned_clv_share
FROM decs_main"""
CTES["targets"] = f"""
SELECT pm/1000.0::DOUBLE AS pct, pm FROM ({constants([(x,) for x in k.TARGET_PERMILLE], ['BIGINT'])}) t(pm)"""
CTES["thresh"] = """
SELECT pct AS target_population_pct, count(*) AS targeted_customers, min(s) AS score_threshold,
       avg(y) AS observed_churn_rate_targeted, avg(y)/(max(all_y)::DOUBLE/max(n)) AS lift_vs_portfolio,
       sum(y)::DOUBLE/max(all_y) AS churn_capture_rate, sum(v) AS profit_adjusted_clv_targeted,
       sum(lost) AS future_churned_clv_proxy_captured,
       coalesce(sum(lost)/nullif(max(all_lost), 0), 0) AS future_churned_clv_capture_rate,
       avg(v) AS avg_profit_adjusted_clv_targeted
FROM ranked_main JOIN targets ON r <= greatest(1, n*pm//1000) GROUP BY pct"""
CTES["calib"] = f"""
SELECT calibration_bin, count(*) AS customers, avg(s) AS avg_predicted_churn_probability,
       avg(y) AS observed_churn_rate, avg(y) - avg(s) AS calibration_gap
FROM (SELECT *, {qcut('up', 'n')} AS calibration_bin
      FROM (SELECT *, row_number() OVER (ORDER BY s, customer_id DESC) AS up FROM ranked_main)) GROUP BY 1"""
CTES["models"] = """
SELECT 'planning_scorecard' AS model_name, 'Transparent scorecard over snapshot signals.' AS model_note,
       TRUE AS uses_direct_cancel_signals, 5 AS feature_count, m.*, lift_vs_portfolio AS top_decile_lift,
       churn_capture_share AS top_decile_churn_capture_share,
       future_churned_clv_share AS top_decile_future_churned_clv_share
FROM metrics_main m, decs_main WHERE risk_decile = 1
UNION ALL BY NAME
SELECT 'planning_scorecard_no_cancel_signals' AS model_name,
       'Scorecard without the cancellation signal.' AS model_note,
       FALSE AS uses_direct_cancel_signals, 4 AS feature_count, m.*, lift_vs_portfolio AS top_decile_lift,
       churn_capture_share AS top_decile_churn_capture_share,
       future_churned_clv_share AS top_decile_future_churned_clv_share
FROM metrics_other m, decs_other WHERE risk_decile = 1"""
CTES["models_f1"] = """
SELECT *, coalesce(2*precision_at_0_50*recall_at_0_50/nullif(precision_at_0_50+recall_at_0_50, 0), 0) AS f1_at_0_50
FROM models"""

CTES["scored"] = f"""
SELECT customer_id, actual_future_churn_label, snapshot_month, lifecycle_stage, engagement_tier, revenue_tier,
       clv_value_tier, value_based_action_group, retention_budget_tier, monthly_value_baseline,
       monthly_margin_baseline, annual_revenue_run_rate_proxy, annual_margin_run_rate_proxy,
       profit_adjusted_clv_proxy, future_churned_clv_proxy, predicted_churn_probability, churn_risk_decile,
       CASE WHEN churn_risk_decile = 1 THEN '{k.CRITICAL}' WHEN churn_risk_decile <= 3 THEN '{k.HIGH_RISK}'
            WHEN churn_risk_decile <= 6 THEN '{k.MEDIUM_RISK}' ELSE '{k.LOW_RISK}' END AS churn_risk_tier,
       'A risk score; the save ranking decides on offers.' AS model_stage_note
FROM (SELECT *, {qcut('r', 'n')} AS churn_risk_decile
      FROM (SELECT *, row_number() OVER (ORDER BY predicted_churn_probability DESC, customer_id) AS r,
                   count(*) OVER () AS n
            FROM (SELECT *, {score(2.2)} AS predicted_churn_probability,
                         churn_next_period AS actual_future_churn_label FROM clv)))"""

CTES["bounds"] = """
SELECT customer_id, min(snapshot_month_date) AS first_observed_month_date,
       max(snapshot_month_date) AS last_observed_month_date, min(snapshot_month) AS first_observed_month,
       max(snapshot_month) AS last_observed_month, count(DISTINCT snapshot_month) AS observed_active_months
FROM cm GROUP BY 1"""
CTES["life"] = f"""
SELECT *, greatest(observation_span_months, 1) AS lifecycle_duration_months,
       CASE WHEN observation_span_months > 0 THEN observed_active_months::DOUBLE/observation_span_months
            ELSE 0 END AS observed_month_coverage_rate,
       {QUADRANT} AS value_risk_quadrant, {READOUT} AS lifecycle_strategy_readout
FROM (SELECT s.* EXCLUDE (model_stage_note, actual_future_churn_label), s.actual_future_churn_label AS churn_event,
             b.first_observed_month_date, b.last_observed_month_date, b.first_observed_month,
             b.last_observed_month, coalesce(b.observed_active_months, 0) AS observed_active_months,
             coalesce({months('b.first_observed_month_date', 'b.last_observed_month_date')} + 1, 1)
               AS observation_span_months
      FROM scored s LEFT JOIN bounds b USING (customer_id))"""

_actions = constants([(x.name, x.response_rate, x.cost) for x in p.actions], ["VARCHAR", "DOUBLE", "DOUBLE"])
CTES["save_input"] = """
SELECT s.*, l.lifecycle_duration_months, l.observed_active_months, l.observed_month_coverage_rate,
       l.value_risk_quadrant, l.lifecycle_strategy_readout
FROM scored s JOIN life l USING (customer_id)"""
CTES["decided"] = f"""
SELECT *, net_save_value_proxy > 0 AND intervention_cost_proxy > 0
          AND recommended_retention_action NOT IN {among(k.SUPPRESS, k.MONITOR)} AS should_receive_paid_offer,
       {SUPPRESSION} AS suppression_reason
FROM (SELECT *, expected_saved_clv_proxy - intervention_cost_proxy AS net_save_value_proxy,
             intervention_cost_proxy/nullif(gross_value_at_risk_proxy, 0) AS break_even_response_rate,
             CASE WHEN intervention_cost_proxy > 0
                  THEN (expected_saved_clv_proxy - intervention_cost_proxy)/intervention_cost_proxy END
               AS expected_roi_proxy
      FROM (SELECT i.*, r.response AS expected_intervention_response_rate, r.cost AS intervention_cost_proxy,
                   predicted_churn_probability*profit_adjusted_clv_proxy AS gross_value_at_risk_proxy,
                   predicted_churn_probability*profit_adjusted_clv_proxy*r.response AS expected_saved_clv_proxy
            FROM (SELECT *, {ACTION} AS recommended_retention_action FROM save_input) i
            JOIN ({_actions}) r(action, response, cost) ON r.action = i.recommended_retention_action))"""
CTES["offer_rank"] = """
SELECT customer_id, row_number() OVER w AS save_worthiness_rank, count(*) OVER () AS offers,
       sum(intervention_cost_proxy) OVER w AS cumulative_cost
FROM decided WHERE should_receive_paid_offer
WINDOW w AS (ORDER BY net_save_value_proxy DESC, customer_id)"""
CTES["saves_wide"] = f"""
SELECT *, {TARGETING} AS final_targeting_readout
FROM (SELECT *, {SAVE_TIER} AS save_priority_tier
      FROM (SELECT d.*, o.save_worthiness_rank, o.cumulative_cost,
                   CASE WHEN o.offers = 1 THEN 100
                        ELSE coalesce(100*(1 - (o.save_worthiness_rank - 1)::DOUBLE/(o.offers - 1)), 0) END
                     AS save_worthiness_score,
                   o.save_worthiness_rank::DOUBLE/o.offers AS place
            FROM decided d LEFT JOIN offer_rank o USING (customer_id)))"""
CTES["saves"] = """
SELECT customer_id, snapshot_month, actual_future_churn_label, predicted_churn_probability, churn_risk_decile,
       churn_risk_tier, lifecycle_stage, engagement_tier, revenue_tier, clv_value_tier, value_risk_quadrant,
       lifecycle_strategy_readout, value_based_action_group, retention_budget_tier, monthly_value_baseline,
       monthly_margin_baseline, annual_revenue_run_rate_proxy, annual_margin_run_rate_proxy,
       profit_adjusted_clv_proxy, future_churned_clv_proxy, gross_value_at_risk_proxy,
       expected_intervention_response_rate, intervention_cost_proxy, expected_saved_clv_proxy,
       net_save_value_proxy, break_even_response_rate, expected_roi_proxy, recommended_retention_action,
       should_receive_paid_offer, suppression_reason, save_worthiness_rank, save_worthiness_score,
       save_priority_tier, final_targeting_readout
FROM saves_wide"""
