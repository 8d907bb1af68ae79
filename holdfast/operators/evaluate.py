"""Ranking metrics of a churn score: exact AUCs, deciles, thresholds, calibration.

Every operator reads one numbered frame (score descending, then id), so the global sort happens
once per score and nothing runs in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import config as k
from holdfast.config import Profile
from holdfast.functions.columns import (
    clip, first_match, mean, ratio, share_or_zero, summarise, total,
)
from holdfast.operators.churn_data import BUSINESS_COLUMNS, TARGET
from holdfast.operators.ranking import (
    ROW_NO, Key, NumberedRows, number_rows, quantile_edges, rank_bucket, running_bands, share_edges,
)
from holdfast.plans.store import TableStore

P, CLV, LOST = "predicted_churn_probability", "profit_adjusted_clv_proxy", "future_churned_clv_proxy"
STAGE_NOTE = "A risk score; the save ranking decides on offers."


def rank_scores(store: TableStore, name: str, scored: DataFrame) -> NumberedRows:
    """``scored`` has customer_id, the score, ``actual_churn`` and the value columns."""
    frame = scored.select("customer_id", P, "actual_churn", CLV, LOST, "monthly_value_baseline")
    order = [Key(P, descending=True), Key("customer_id")]
    return number_rows(store, f"score_{name}", frame, order, running={"churners_so_far": "actual_churn"})


def score_metrics(ranked: NumberedRows) -> DataFrame:
    """ROC-AUC, average precision, Brier, log loss and the 0.50 threshold metrics, in one row.

    Grouping by distinct score makes ties exact: a tie group takes its average rank in the
    Mann-Whitney statistic and one step of the precision-recall curve.
    """
    y = F.col("actual_churn")
    groups = ranked.frame.groupBy(P).agg(
        F.count("*").alias("n"),
        F.sum(y).alias("pos"),
        F.min(ROW_NO).alias("lo"),
        F.max(ROW_NO).alias("hi"),
        F.max("churners_so_far").alias("cum"),
    )
    s, n, pos = F.col(P), F.col("n"), F.col("pos")
    safe = clip(s, 1e-6, 1 - 1e-6)
    hit = F.when(s >= 0.5, 1).otherwise(0)
    sums = groups.agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum(pos * (F.col("lo") + F.col("hi")) / 2).alias("rank_sum"),
        F.sum(pos * F.col("cum") / F.col("hi")).alias("precision_sum"),
        F.sum((n - pos) * s * s + pos * (1 - s) * (1 - s)).alias("squared"),
        F.sum(-(pos * F.log(safe) + (n - pos) * F.log(1 - safe))).alias("loss"),
        F.sum(pos * hit).alias("tp"),
        F.sum(n * hit).alias("called"),
    )
    n, pos, tp, called = (F.col(c).cast("double") for c in ("n", "pos", "tp", "called"))
    neg = n - pos
    precision = F.coalesce(ratio(tp, called), F.lit(0.0))
    recall = F.coalesce(ratio(tp, pos), F.lit(0.0))
    return sums.select(
        ratio(pos, n).alias("test_churn_rate"),
        (1 - ratio(F.col("rank_sum") - pos * (pos + 1) / 2, pos * neg)).alias("roc_auc"),
        ratio("precision_sum", pos).alias("pr_auc"),
        ratio("squared", n).alias("brier_score"),
        ratio("loss", n).alias("log_loss"),
        ratio(n - called - pos + 2 * tp, n).alias("accuracy_at_0_50"),
        precision.alias("precision_at_0_50"),
        recall.alias("recall_at_0_50"),
        F.coalesce(ratio(2 * tp, called + pos), F.lit(0.0)).alias("f1_at_0_50"),
    )


def risk_decile_table(ranked: NumberedRows) -> DataFrame:
    decile = rank_bucket(quantile_edges(ranked.rows, 10))
    out = summarise(ranked.frame.withColumn("risk_decile", decile), ["risk_decile"], {
        "customers": F.count("*"),
        "avg_predicted_churn_probability": mean(P),
        "observed_churn_rate": mean("actual_churn"),
        "actual_churners": total("actual_churn"),
        CLV: total(CLV),
        LOST: total(LOST),
        "avg_profit_adjusted_clv_proxy": mean(CLV),
        "avg_monthly_value_baseline": mean("monthly_value_baseline"),
    })
    everything = Window.partitionBy(F.lit(1))  # ten rows
    running = everything.orderBy("risk_decile").rowsBetween(Window.unboundedPreceding, 0)

    def whole(c: str) -> Column:
        return F.sum(c).over(everything)

    return out.withColumns({
        "lift_vs_portfolio": ratio("observed_churn_rate", whole("actual_churners") / whole("customers")),
        "churn_capture_share": ratio("actual_churners", whole("actual_churners")),
        "future_churned_clv_share": share_or_zero(LOST, whole(LOST)),
    }).withColumns({
        "cumulative_churn_capture_share": F.sum("churn_capture_share").over(running),
        "cumulative_future_churned_clv_share": F.sum("future_churned_clv_share").over(running),
    }).orderBy("risk_decile")


def threshold_table(ranked: NumberedRows) -> DataFrame:
    edges = share_edges(ranked.rows, k.TARGET_PERMILLE, up=False)
    dims = [(pm / 1000,) for pm in k.TARGET_PERMILLE]
    sums = running_bands(
        ranked.frame, rank_bucket(edges), dims, "target_population_pct double",
        {"n": F.count("*"), "pos": total("actual_churn"), "clv": total(CLV), "lost": total(LOST)},
        {"score_threshold": F.min(P)},
    )
    rate = ratio("pos", "n")
    return sums.select(
        "target_population_pct",
        F.col("n").cast("bigint").alias("targeted_customers"),
        "score_threshold",
        rate.alias("observed_churn_rate_targeted"),
        ratio(rate, ratio("all_pos", "all_n")).alias("lift_vs_portfolio"),
        ratio("pos", "all_pos").alias("churn_capture_rate"),
        F.col("clv").alias("profit_adjusted_clv_targeted"),
        F.col("lost").alias("future_churned_clv_proxy_captured"),
        share_or_zero("lost", "all_lost").alias("future_churned_clv_capture_rate"),
        ratio("clv", "n").alias("avg_profit_adjusted_clv_targeted"),
    ).orderBy("target_population_pct")


def calibration_table(ranked: NumberedRows) -> DataFrame:
    """Ten bins by ascending score: the mirror of the descending order, so no second sort."""
    ascending = ranked.frame.withColumn("_rank", F.lit(ranked.rows + 1) - F.col(ROW_NO))
    bins = ascending.withColumn("calibration_bin", rank_bucket(quantile_edges(ranked.rows, 10), "_rank"))
    return summarise(bins, ["calibration_bin"], {
        "customers": F.count("*"),
        "avg_predicted_churn_probability": mean(P),
        "observed_churn_rate": mean("actual_churn"),
    }).withColumn(
        "calibration_gap", F.col("observed_churn_rate") - F.col("avg_predicted_churn_probability")
    ).orderBy("calibration_bin")


def churn_risk_tier() -> Column:
    decile = F.col("churn_risk_decile")
    return first_match(
        [(decile == 1, k.CRITICAL), (decile <= 3, k.HIGH_RISK), (decile <= 6, k.MEDIUM_RISK)], k.LOW_RISK
    )


def scored_customers(store: TableStore, name: str, frame: DataFrame) -> DataFrame:
    """Business columns, score, global risk decile and tier.  ``frame`` carries the score."""
    business = frame.select(*BUSINESS_COLUMNS, P).withColumnRenamed(TARGET, "actual_future_churn_label")
    ranked = number_rows(
        store, f"risk_{name}", business.select(P, "customer_id"), [Key(P, descending=True), Key("customer_id")]
    )
    decile = ranked.bucket(quantile_edges(ranked.rows, 10))
    return business.withColumn("churn_risk_decile", decile).withColumns({
        "churn_risk_tier": churn_risk_tier(), "model_stage_note": F.lit(STAGE_NOTE),
    })


def segment_score_summary(scored: DataFrame, p: Profile) -> DataFrame:
    keys = ["lifecycle_stage", "engagement_tier", "revenue_tier", "clv_value_tier", "churn_risk_tier",
            "retention_budget_tier"]
    return summarise(scored, keys, {
        "customers": F.count("*"),
        "avg_predicted_churn_probability": mean(P),
        "actual_future_churn_rate": mean("actual_future_churn_label"),
        CLV: total(CLV),
        LOST: total(LOST),
        "avg_profit_adjusted_clv_proxy": mean(CLV),
    }, p.min_export_rows).orderBy(F.desc(LOST), F.desc("avg_predicted_churn_probability"), *keys)


def scored_top_sample(scored: DataFrame, p: Profile) -> DataFrame:
    return scored.orderBy(F.desc(P), "customer_id").limit(p.sample_rows)


def model_row(ranked: NumberedRows, name: str, note: str, uses_cancel: bool, feature_count: int) -> DataFrame:
    """One comparison row of a candidate score."""
    top = risk_decile_table(ranked).filter(F.col("risk_decile") == 1).select(
        F.col("lift_vs_portfolio").alias("top_decile_lift"),
        F.col("churn_capture_share").alias("top_decile_churn_capture_share"),
        F.col("future_churned_clv_share").alias("top_decile_future_churned_clv_share"),
    )
    return score_metrics(ranked).crossJoin(top).select(
        F.lit(name).alias("model_name"),
        F.lit(note).alias("model_note"),
        F.lit(uses_cancel).alias("uses_direct_cancel_signals"),
        F.lit(feature_count).alias("feature_count"),
        "*",
    )


def model_comparison(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.desc("top_decile_lift"), "model_name")


def churn_headline(comparison: DataFrame, deciles: DataFrame, thresholds: DataFrame) -> DataFrame:
    best = comparison.orderBy(
        F.desc("pr_auc"), F.desc("roc_auc"), F.desc("top_decile_lift"), "model_name"
    ).limit(1).select(
        F.col("model_name").alias("best_model"), F.col("model_note").alias("best_model_note"),
        "uses_direct_cancel_signals", "roc_auc", "pr_auc", "brier_score", "log_loss", "test_churn_rate",
    )
    top = deciles.filter(F.col("risk_decile") == 1).select(
        F.col("observed_churn_rate").alias("top_decile_observed_churn_rate"),
        F.col("lift_vs_portfolio").alias("top_decile_lift"),
        F.col("churn_capture_share").alias("top_decile_churn_capture_share"),
        F.col("future_churned_clv_share").alias("top_decile_future_churned_clv_share"),
    )
    twenty = thresholds.filter(F.col("target_population_pct") == 0.2).select(
        F.col("churn_capture_rate").alias("top_20pct_churn_capture_rate"),
        F.col("future_churned_clv_capture_rate").alias("top_20pct_future_churned_clv_capture_rate"),
    )
    return best.crossJoin(top).crossJoin(twenty)
