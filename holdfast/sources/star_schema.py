"""Subscription inputs derived from the order/lineitem/event star schema (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.columns import large_side, lookup
from holdfast.sources.raw import RawTables

CUTOFF = "2000-08-01"
LAST_MONTH = "2000-07-01"
CHANNELS = (("AUTOMOBILE", 3), ("BUILDING", 4), ("FURNITURE", 7), ("HOUSEHOLD", 9))
EVENT_BANDS = (
    ("num_25", "view"), ("num_50", "click"), ("num_75", "signup"),
    ("num_985", "error"), ("num_100", "purchase"),
)
EVENT_MONTH_SHIFT = -282


def _without_orders(key: str):
    """Registration of a customer who never ordered: spread over four years."""
    offset = (F.col(key) * 7) % 48
    return F.add_months(F.to_date(F.lit(LAST_MONTH)), -offset.cast("int"))


def _yyyymmdd(day):
    return F.date_format(day, "yyyyMMdd").cast("int")


class StarSchema:
    def __init__(self, spark: SparkSession, folder: str):
        self._read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")

    def labels(self) -> DataFrame:
        """Churned: no order on or after the cutoff."""
        returning = self._read("orders").filter(F.col("o_orderdate") >= CUTOFF).groupBy("o_custkey").agg(
            F.lit(0).alias("seen")
        )
        customers = self._read("customer").select("c_custkey")
        return customers.join(large_side(returning), F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.coalesce("seen", F.lit(1)).alias("is_churn"),
        )

    def members(self) -> DataFrame:
        first = self._read("orders").filter(F.col("o_orderdate") < CUTOFF).groupBy("o_custkey").agg(
            F.to_date(F.min("o_orderdate")).alias("first_order")
        )
        c = self._read("customer").join(large_side(first), F.col("c_custkey") == F.col("o_custkey"), "left")
        gender = F.when(F.col("c_custkey") % 3 == 0, "male").when(F.col("c_custkey") % 3 == 1, "female")
        return c.select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_nationkey").alias("city"),
            F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
            gender.alias("gender"),
            lookup("c_mktsegment", CHANNELS, 13).alias("registered_via"),
            _yyyymmdd(F.coalesce("first_order", _without_orders("c_custkey"))).alias("registration_init_time"),
        )

    def transactions(self) -> DataFrame:
        # Line items are summed before the join, so the join meets one row per order.
        paid = self._read("lineitem").groupBy("l_orderkey").agg(
            F.sum("l_extendedprice").alias("plan_list_price"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual_amount_paid"),
        )
        o = self._read("orders").filter(F.col("o_orderdate") < CUTOFF)
        days = F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(30 * (1 + F.col("o_orderkey") % 3)).cast("int")
        day = F.to_date("o_orderdate")
        return o.join(large_side(paid), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            (1 + F.col("o_orderkey") % 5).cast("int").alias("payment_method_id"),
            days.alias("payment_plan_days"),
            F.coalesce("plan_list_price", F.lit(0.0)).alias("plan_list_price"),
            F.coalesce("actual_amount_paid", F.lit(0.0)).alias("actual_amount_paid"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("is_auto_renew"),
            _yyyymmdd(day).alias("transaction_date"),
            _yyyymmdd(F.date_add(day, days)).alias("membership_expire_date"),
            ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).cast("int").alias("is_cancel"),
        )

    def user_logs(self) -> DataFrame:
        bands = [
            (F.col("event_type") == event).cast("int").alias(column) for column, event in EVENT_BANDS
        ]
        day = F.add_months(F.to_date("ts"), EVENT_MONTH_SHIFT)
        return self._read("events").select(
            F.col("user_id").cast("string").alias("customer_id"),
            _yyyymmdd(day).alias("date"),
            *bands,
            F.lit(1).alias("num_unq"),
            (F.col("value") * 60).alias("total_secs"),
        )

    def tables(self) -> RawTables:
        return RawTables(self.labels(), self.members(), self.transactions(), self.user_logs())
