"""Building blocks shown on whole tables: scans, sinks, global ranks and scalar functions.

The domain queries use the same blocks; these isolate the ones that have no table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import (
    bands, calendar_months, clip, count_text, fixed, hash_to_unit, money_text, month_start, month_text,
    number_or_zero, parse_yyyymmdd, percent_text, ratio, times_text, total_where,
)
from holdfast.functions.proportions import normal_cdf
from holdfast.operators import training
from holdfast.operators.ranking import (
    ROW_NO, Key, number_rows, ntile_edges, quantile_edges, rank_bucket, share_edges,
)
from holdfast.operators.validation import signal_family
from holdfast.plans.engine import RetentionEngine
from holdfast.sources import raw

Query = Callable[[RetentionEngine], DataFrame]


def _path(e: RetentionEngine, name: str) -> str:
    """A folder of its own for every written result, so a frame that still reads an earlier one stays valid."""
    return e.store.fresh(f"files-{name}")


# --- Scans and sinks ------------------------------------------------------------------------

def csv_scan(e: RetentionEngine) -> DataFrame:
    path = _path(e, "labels.csv")
    raw.write_csv(e.table("labels").withColumnRenamed("customer_id", "msno"), path)
    return raw.read_csv(e.spark, path, raw.LABELS_SCHEMA)


def _logs_csv(e: RetentionEngine) -> str:
    path = _path(e, "logs.csv")
    columns = [c.split()[0] for c in raw.USER_LOGS_SCHEMA.split(", ")]
    raw.write_csv(e.raw.user_logs.withColumnRenamed("customer_id", "msno").select(*columns), path)
    return path


def csv_scan_chunked(e: RetentionEngine) -> DataFrame:
    """Many files and splits, aggregated partially where they are read."""
    logs = raw.read_csv(e.spark, _logs_csv(e), raw.USER_LOGS_SCHEMA)
    return logs.groupBy("msno").agg(
        F.count("*").alias("log_rows"), F.count_distinct("date").alias("days"),
        F.sum("num_unq").alias("num_unq"), F.sum("total_secs").alias("total_secs"),
    )


def csv_scan_projected(e: RetentionEngine) -> DataFrame:
    return raw.read_csv(e.spark, _logs_csv(e), raw.USER_LOGS_SCHEMA).select("msno", "date", "total_secs")


def parquet_scan(e: RetentionEngine) -> DataFrame:
    """A filter and three columns of a written layer: both reach the file reader."""
    return e.table("customer_month").filter(F.col("monthly_revenue") > 0).select(
        "customer_id", "snapshot_month", "total_secs"
    )


def parquet_sink(e: RetentionEngine) -> DataFrame:
    """All customer months, written by month and read back."""
    path = _path(e, "customer_month")
    raw.write_parquet(
        e.table("customer_month").select("customer_id", "snapshot_month", "monthly_revenue", "engagement_score"),
        path, ["snapshot_month"],
    )
    return e.spark.read.parquet(path).select(
        "customer_id", F.col("snapshot_month").cast("string").alias("snapshot_month"), "monthly_revenue",
        "engagement_score",
    )


def csv_sink(e: RetentionEngine) -> DataFrame:
    """The snapshot export, read back with its schema."""
    path = _path(e, "snapshot.csv")
    wanted = e.table("snapshot").select(
        "customer_id", "churn_next_period", "snapshot_month", "city", "age", "monthly_revenue", "lifecycle_stage"
    )
    raw.write_csv(wanted, path)
    return e.spark.read.schema(wanted.schema).option("header", True).csv(path)


def top_sample_sink(e: RetentionEngine) -> DataFrame:
    path = _path(e, "top_value.csv")
    wanted = e.table("clv").select("customer_id", "profit_adjusted_clv_proxy", "clv_value_tier")
    raw.write_top_csv(wanted, path, [F.desc("profit_adjusted_clv_proxy"), F.col("customer_id")], e.p.sample_rows)
    return e.spark.read.schema(wanted.schema).option("header", True).csv(path)


def staged_csv_reread(e: RetentionEngine) -> DataFrame:
    """A later step reading an earlier step's CSV result."""
    path = _path(e, "frontier.csv")
    frontier = e.table("roi_frontier")
    raw.write_csv(frontier, path)
    return e.spark.read.schema(frontier.schema).option("header", True).csv(path)


def named_table(e: RetentionEngine) -> DataFrame:
    e.table("customer_month").createOrReplaceTempView("holdfast_customer_month")
    return e.spark.sql("""
        SELECT lifecycle_stage, count(*) AS customer_months, sum(monthly_revenue) AS revenue
        FROM holdfast_customer_month GROUP BY lifecycle_stage
    """)


# --- Global order over customer months --------------------------------------------------------

def _numbered_months(e: RetentionEngine):
    """All customer months by revenue: one third and more share the value zero."""
    return e.numbered("months", lambda: number_rows(
        e.store, "months",
        e.table("customer_month").select("customer_id", "snapshot_month", "monthly_revenue", "active_days"),
        [Key("active_days", True), Key("monthly_revenue", True), Key("customer_id"), Key("snapshot_month")],
        running={"revenue_so_far": "monthly_revenue"},
    ))


def ntile_global(e: RetentionEngine) -> DataFrame:
    ranked = _numbered_months(e)
    return ranked.frame.select(
        "customer_id", "snapshot_month", rank_bucket(ntile_edges(ranked.rows, 10)).alias("tile")
    )


def bucket_without_join(e: RetentionEngine) -> DataFrame:
    """The same tiles by literal edge comparison on the unsorted table."""
    ranked = _numbered_months(e)
    return e.table("customer_month").select(
        "customer_id", "snapshot_month", ranked.bucket(ntile_edges(ranked.rows, 10)).alias("tile")
    )


def quantile_cut_global(e: RetentionEngine) -> DataFrame:
    ranked = _numbered_months(e)
    return ranked.frame.select(
        "customer_id", "snapshot_month", rank_bucket(quantile_edges(ranked.rows, 10)).alias("bucket")
    )


def top_percent(e: RetentionEngine) -> DataFrame:
    ranked = _numbered_months(e)
    (limit,) = share_edges(ranked.rows, [50], up=False)
    return ranked.frame.filter(F.col(ROW_NO) <= limit).select("customer_id", "snapshot_month", ROW_NO)


def totals_beside_rows(e: RetentionEngine) -> DataFrame:
    """A grand total on every row: one aggregate, then a one-row broadcast."""
    months = e.table("customer_month")
    totals = months.agg(F.count("*").alias("all_rows"), F.sum("monthly_revenue").alias("all_revenue"))
    return months.crossJoin(F.broadcast(totals)).select(
        "customer_id", "snapshot_month", "all_rows", ratio("monthly_revenue", "all_revenue").alias("revenue_share")
    )


def random_sample(e: RetentionEngine) -> DataFrame:
    rows = e.table("model_frame").filter("in_test")
    return training.hash_sample(rows, e.p.model.seed, e.p.sample_rows).select("customer_id")


def group_top_row(e: RetentionEngine) -> DataFrame:
    """Best month of each customer: an aggregate, so a busy customer is combined map-side."""
    best = F.max(F.struct("monthly_revenue", "snapshot_month")).alias("b")
    return e.table("customer_month").groupBy("customer_id").agg(best).select(
        "customer_id", "b.snapshot_month", "b.monthly_revenue"
    )


def argmax_row(e: RetentionEngine) -> DataFrame:
    best = F.max_by(F.struct("customer_id", "snapshot_month", "monthly_revenue"),
                    F.struct("monthly_revenue", "customer_id", "snapshot_month"))
    return e.table("customer_month").agg(best.alias("b")).select("b.*")


def conditional_aggregates(e: RetentionEngine) -> DataFrame:
    churned = F.col("churn_next_period") == 1
    return e.table("clv").groupBy("clv_value_tier").agg(
        total_where(churned, "profit_adjusted_clv_proxy").alias("lost"),
        F.count_if(churned).alias("churners"),
        ratio(total_where(churned, "profit_adjusted_clv_proxy"), F.sum("profit_adjusted_clv_proxy")).alias("loss_rate"),
        F.var_samp("monthly_value_baseline").alias("variance"),
        F.median("expected_active_months_proxy").alias("median_months"),
    )


# --- Scalar functions ---------------------------------------------------------------------------

def null_handling(e: RetentionEngine) -> DataFrame:
    return e.table("members").select(
        "customer_id", F.coalesce("age", F.lit(0.0)).alias("age_or_zero"),
        F.nullif(F.col("gender"), F.lit("unknown")).alias("known_gender"),
    )


def lenient_cast(e: RetentionEngine) -> DataFrame:
    """Numbers in text, with text that is no number."""
    text = e.table("members").select(
        "customer_id", F.when(F.col("city") % 2 == 0, F.col("city").cast("string")).otherwise(F.col("gender")).alias("x")
    )
    return text.select("customer_id", number_or_zero("x").alias("number"), F.col("x").try_cast("int").alias("whole"))


def date_functions(e: RetentionEngine) -> DataFrame:
    day = parse_yyyymmdd("transaction_date")
    return e.table("transactions").select(
        "customer_id", "transaction_date", day.alias("day"), month_text(day).alias("month"),
        month_start(month_text(day)).alias("month_start"),
        calendar_months(day, parse_yyyymmdd("membership_expire_date")).alias("months_to_expiry"),
        # A day that does not exist becomes null instead of an error.
        parse_broken_day().alias("broken_day"),
    )


def parse_broken_day() -> Column:
    return F.try_to_date(F.concat(F.date_format("transaction_date_dt", "yyyy"), F.lit("1301")), "yyyyMMdd")


def numeric_functions(e: RetentionEngine) -> DataFrame:
    revenue, age = F.col("monthly_revenue"), F.coalesce("age", F.lit(0.0))
    return e.table("snapshot").select(
        "customer_id",
        F.greatest("monthly_revenue", "latest_actual_amount_paid").alias("larger"),
        F.least("age", F.lit(40.0)).alias("capped_age"),
        clip(age / 100, 0.1, 0.6).alias("clipped"),
        F.log1p("monthly_revenue").alias("log_revenue"),
        F.ceil(age / 7).alias("ceiling"), F.floor(age / 7).alias("floor"),
        F.sqrt(revenue).alias("root"), F.abs(age - 50).alias("distance"),
        normal_cdf((age - 50) / 20).alias("normal_share"),
        (F.col("num_25") + F.col("num_50") + F.col("num_75") + F.col("num_985") + F.col("num_100")).alias("plays"),
    )


def text_functions(e: RetentionEngine) -> DataFrame:
    return e.table("clv").select(
        "customer_id", F.concat_ws(" | ", "clv_value_tier", "lifecycle_stage").alias("stratum"),
        F.col("value_based_action_group").rlike("Premium|High-value").alias("is_premium"),
        F.lower("revenue_tier").contains("high").alias("is_high"),
        money_text("profit_adjusted_clv_proxy").alias("money"), percent_text("completion_rate_proxy").alias("percent"),
        count_text("transaction_count").alias("count"), times_text("expected_active_months_proxy").alias("times"),
        fixed("engagement_score", 4).alias("four"),
    )


def unit_hash(e: RetentionEngine) -> DataFrame:
    return e.table("labels").select("customer_id", hash_to_unit(e.p.ab_seed, "customer_id").alias("u"))


def case_ladder(e: RetentionEngine) -> DataFrame:
    return e.table("snapshot").groupBy(
        bands("trailing_3mo_revenue", (1.0, 100_000.0, 300_000.0), ("none", "low", "middle", "high")).alias("band")
    ).agg(F.count("*").alias("customers"))


def feature_families(e: RetentionEngine) -> DataFrame:
    return e.feature_audit.select("feature", signal_family().alias("signal_family"), "non_null_rows")


def union_all(e: RetentionEngine) -> DataFrame:
    paid = e.table("transactions").select("customer_id", F.col("transaction_month").alias("month"), F.lit("payment").alias("kind"))
    heard = e.table("logs_monthly").select("customer_id", F.col("activity_month").alias("month"), F.lit("activity").alias("kind"))
    return paid.unionByName(heard).groupBy("month", "kind").agg(F.count("*").alias("rows"))


PRIMITIVES: dict[str, Query] = {
    "prim_csv_scan": csv_scan,
    "prim_csv_scan_chunked": csv_scan_chunked,
    "prim_csv_scan_projected": csv_scan_projected,
    "prim_parquet_scan": parquet_scan,
    "prim_staged_csv_reread": staged_csv_reread,
    "prim_parquet_sink": parquet_sink,
    "prim_csv_sink": csv_sink,
    "prim_top_sample_sink": top_sample_sink,
    "prim_named_table": named_table,
    "prim_row_number_global": lambda e: _numbered_months(e).frame.select("customer_id", "snapshot_month", ROW_NO),
    "prim_running_sum_global": lambda e: _numbered_months(e).frame.select(
        "customer_id", "snapshot_month", "revenue_so_far"),
    "prim_ntile_global": ntile_global,
    "prim_bucket_without_join": bucket_without_join,
    "prim_quantile_cut_global": quantile_cut_global,
    "prim_top_percent": top_percent,
    "prim_totals_beside_rows": totals_beside_rows,
    "prim_random_sample": random_sample,
    "prim_group_top_row": group_top_row,
    "prim_argmax_row": argmax_row,
    "prim_conditional_aggregates": conditional_aggregates,
    "prim_null_handling": null_handling,
    "prim_lenient_cast": lenient_cast,
    "prim_date_functions": date_functions,
    "prim_numeric_functions": numeric_functions,
    "prim_text_functions": text_functions,
    "prim_unit_hash": unit_hash,
    "prim_case_ladder": case_ladder,
    "prim_feature_families": feature_families,
    "prim_union_all": union_all,
}
