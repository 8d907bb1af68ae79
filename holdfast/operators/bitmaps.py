"""Distinct customers by exact bitmaps that can be merged.

Customers are numbered once.  A bitmap has a bit per customer of one range of 32,768 numbers, so the customers of a
(month, group) are a row per range.  Counts of any larger period or group come from merging these rows, without
the customer rows and without counting anybody twice; customers of two months at once come from their intersection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import large_side
from holdfast.operators.ranking import ROW_NO, Key, number_rows
from holdfast.plans.store import TableStore

ALL = "All"
NUMBER = "customer_number"


def customer_numbers(store: TableStore, customers: DataFrame) -> DataFrame:
    """customer_id and its number from 1, for unique customers."""
    numbered = number_rows(store, "customer_numbers", customers.select("customer_id"), [Key("customer_id")]).frame
    return numbered.select("customer_id", F.col(ROW_NO).cast("bigint").alias(NUMBER))


def monthly_bitmaps(customer_month: DataFrame, numbers: DataFrame, group: str) -> DataFrame:
    """snapshot_month, the group, the range of numbers, and the bits of its customers."""
    months = customer_month.select("customer_id", "snapshot_month", group).join(large_side(numbers), "customer_id")
    return months.groupBy("snapshot_month", group, F.bitmap_bucket_number(NUMBER).alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias("bits")
    )


def distinct_customers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Customers that stand in any of the rows of a key."""
    merged = rows.groupBy(*keys, "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("customers"))


def _periods(month: Column) -> Column:
    """The periods that a month counts for, as (kind, period)."""
    first = F.to_date(month, "yyyy-MM")
    quarter = F.concat(F.date_format(first, "yyyy"), F.lit("-Q"), F.quarter(first).cast("string"))
    fixed = [("month", month), ("quarter", quarter), ("year", F.date_format(first, "yyyy")), ("all", F.lit(ALL))]
    trailing = [("trailing_3_months", F.date_format(F.add_months(first, later), "yyyy-MM")) for later in range(3)]
    named = "struct<kind:string,period:string>"
    return F.array(*(F.struct(F.lit(kind), period).cast(named) for kind, period in (*fixed, *trailing)))


def distinct_rollups(bitmaps: DataFrame, group: str) -> DataFrame:
    """Distinct customers by month, quarter, year, all time and trailing three months, per group and in all.

    Trailing periods end in months that occur.  ``retained`` rows count those of a month who were there the month before.
    """
    rows = bitmaps.select(
        F.explode(_periods(F.col("snapshot_month"))).alias("p"),
        F.explode(F.array(F.col(group), F.lit(ALL))).alias(group), "range", "bits",
    ).select("p.kind", "p.period", group, "range", "bits")
    counts = distinct_customers(rows, ["kind", "period", group])
    months = bitmaps.select(F.col("snapshot_month").alias("period")).distinct()
    ends = (F.col("kind") != "trailing_3_months") | F.col("occurs")
    known = counts.join(months.withColumn("occurs", F.lit(True)), "period", "left").filter(ends).drop("occurs")

    whole = bitmaps.groupBy("snapshot_month", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    later = F.date_format(F.add_months(F.to_date("snapshot_month", "yyyy-MM"), 1), "yyyy-MM")
    sides = whole.select(F.col("snapshot_month").alias("period"), "range", "bits").unionByName(
        whole.select(later.alias("period"), "range", "bits")
    )
    both = sides.groupBy("period", "range").agg(F.count("*").alias("sides"), F.bitmap_and_agg("bits").alias("bits"))
    retained = both.filter("sides = 2").groupBy("period").agg(F.sum(F.bitmap_count("bits")).alias("customers"))
    retained = retained.filter("customers > 0").select(
        F.lit("retained").alias("kind"), "period", F.lit(ALL).alias(group), "customers"
    )
    return known.select("kind", "period", group, "customers").unionByName(retained)
