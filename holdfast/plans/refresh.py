"""Refresh of published customer months when payments or logs arrive.

Arrived rows touch a few (customer, month) pairs.  Only these are aggregated again from the raw rows, and only the
customers they belong to get their windows anew; of the published table only the months in which a row came
out differently are written, by replacing their partitions.  The result equals a rebuild from all raw rows, as
long as members and labels are the same; when those change a rebuild is due.

Defined results: without arrived rows, or with rows of unlabelled customers or without a date only, nothing is
written; rows may arrive late or for months not seen before; arrived rows are part of the raw tables already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import month_text, parse_yyyymmdd
from holdfast.operators import clean, customer_month
from holdfast.operators.customer_month import KEYS
from holdfast.plans.engine import RetentionEngine

FOLDER = "layers/customer_month"


def touched_pairs(engine: RetentionEngine, payments: DataFrame, logs: DataFrame) -> DataFrame:
    """(customer_id, snapshot_month) of labelled customers that arrived rows belong to."""
    def pairs(rows: DataFrame, date: str) -> DataFrame:
        month = month_text(parse_yyyymmdd(date)).alias("snapshot_month")
        return rows.select(F.col("customer_id").cast("string").alias("customer_id"), month)

    both = pairs(payments, "transaction_date").unionByName(pairs(logs, "date")).filter("snapshot_month is not null")
    return clean.keep_labelled(both.distinct(), engine.table("labels"))


def _months(df: DataFrame) -> list[str]:
    """The calendar bounds their number."""
    return sorted(r[0] for r in df.select("snapshot_month").distinct().collect())


def _base_of(engine: RetentionEngine, pairs: DataFrame, months: list[str]) -> DataFrame:
    """Base rows of touched pairs, from the raw rows of their months."""
    raw, labels = engine.raw, engine.table("labels")

    def of_months(rows: DataFrame, date: str) -> DataFrame:
        return rows.filter(month_text(parse_yyyymmdd(date)).isin(months))

    def of_pairs(rows: DataFrame, month: str) -> DataFrame:
        return rows.join(pairs.withColumnRenamed("snapshot_month", month), ["customer_id", month], "left_semi")

    paid = clean.clean_transactions(of_months(raw.transactions, "transaction_date"), labels, engine.label_count)
    active = clean.user_logs_monthly(of_months(raw.user_logs, "date"), labels)
    return customer_month.customer_month_base(
        of_pairs(customer_month.transaction_monthly(paid).withColumnRenamed("snapshot_month", "month"), "month")
        .withColumnRenamed("month", "snapshot_month"),
        of_pairs(active, "activity_month"), engine.table("members"), labels,
    )


def refresh_customer_month(engine: RetentionEngine, folder: str, payments: DataFrame, logs: DataFrame) -> list[str]:
    """Brings the published months below ``folder`` up to date and returns the months that were replaced.

    ``engine`` stands on the raw tables with the arrived ``payments`` and ``logs`` in them.
    """
    store, path = engine.store, f"{folder}/{FOLDER}"
    pairs = store.write("touched_pairs", touched_pairs(engine, payments, logs))
    months = _months(pairs)
    if not months:
        return []
    schema = engine.customer_month.schema
    published = engine.spark.read.schema(schema).parquet(path).select(*schema.names)
    customers = pairs.select("customer_id").distinct()
    fresh = _base_of(engine, pairs, months)
    theirs = store.write("months_before", published.join(customers, "customer_id", "left_semi"))
    kept = theirs.select(*fresh.columns).join(pairs, KEYS, "left_anti")
    features = customer_month.customer_month_features(kept.unionByName(fresh))
    again = customer_month.with_change_and_tiers(features, engine.p).select(*schema.names)
    again = store.write("months_again", again)

    differing = again.exceptAll(theirs).select("snapshot_month")
    replaced = _months(differing)
    if not replaced:
        return []
    here = F.col("snapshot_month").isin(replaced)
    others = published.filter(here).join(customers, "customer_id", "left_anti")
    # Written aside first: the partitions that are read here are the ones to be replaced.
    ready = store.write("months_ready", others.unionByName(again.filter(here)))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_month").parquet(path)
    return replaced
