"""Cleaning of the raw inputs and the monthly activity table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import (
    flag, large_side, month_text, number_or_zero, parse_yyyymmdd,
)

PLAY_BANDS = ("num_25", "num_50", "num_75", "num_985", "num_100")
LOG_COUNTS = (*PLAY_BANDS, "num_unq")
# Scores are kept to nine decimals so that ranks do not depend on the last bit of a logarithm.
SCORE_DECIMALS = 9
#: The label filter: bits per label, bits set per label, and at most 4M words (some 100 MB where they are looked up).
FILTER_BITS, FILTER_HASHES, MOST_WORDS = 16, 4, 1 << 22
SALTS = 16
#: (customer, salt) rows that the optimizer may broadcast, some 12 MB in the driver.
MOST_LISTED = 100_000


def clean_labels(labels: DataFrame) -> DataFrame:
    return labels.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("is_churn").cast("int").alias("is_churn"),
    )


def keep_labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of labelled customers only; labels are unique per customer."""
    return df.withColumn("customer_id", F.col("customer_id").cast("string")).join(
        large_side(labels.select("customer_id")), "customer_id", "left_semi"
    )


def clean_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled customer: the latest registration, ties broken by every column.

    Reduced before the join: ``max`` over a struct combines map-side, so a customer repeated in a
    third of all rows never lands in one task, and the join meets one row per customer.
    """
    age = F.col("bd").try_cast("double")
    row = members.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.struct(
            parse_yyyymmdd("registration_init_time").alias("registration_date"),
            F.coalesce(F.col("city").cast("int"), F.lit(0)).alias("city"),
            F.when((age > 0) & (age <= 100), age).alias("age"),
            F.coalesce(F.col("gender"), F.lit("unknown")).alias("gender"),
            F.coalesce(F.col("registered_via").cast("int"), F.lit(0)).alias("registered_via"),
        ).alias("row"),
    )
    last = row.groupBy("customer_id").agg(F.max("row").alias("row"))
    return keep_labelled(last, labels).select(
        "customer_id", "row.city", "row.age", "row.gender", "row.registered_via", "row.registration_date"
    )


def _filter_place(words: int) -> tuple[Column, Column]:
    """The word of a customer in the filter, and the bits that stand for it there."""
    key = F.col("customer_id").cast("string")
    draw = F.xxhash64(key, F.lit(5))
    one = F.lit(1).cast("bigint")
    bits = [
        F.call_function("shiftleft", one, F.shiftrightunsigned(draw, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(FILTER_HASHES)
    ]
    return F.pmod(F.xxhash64(key), F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def maybe_labelled(rows: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """Rows whose customer may be labelled, by a Bloom filter looked up inside the scan.

    All bits of a customer stand in one 64-bit word, so the filter is a table of words, sized by the number of labels
    and bounded by ``MOST_WORDS``, and a lookup is one probe of a hash table.  Beyond the bound more unlabelled rows
    get through; none that is labelled is lost.
    """
    words = min(MOST_WORDS, max(1, -(-n_labels * FILTER_BITS // 64)))
    word, bits = _filter_place(words)
    held = labels.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_held"))
    probe = rows.withColumns({"_at": word, "_needs": bits})
    there = (F.col("_at") == F.col("_word")) & (F.col("_held").bitwiseAND(F.col("_needs")) == F.col("_needs"))
    return probe.join(F.broadcast(held), there, "left_semi").drop("_at", "_needs")


def keep_labelled_spread(rows: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """``keep_labelled`` for raw rows, of which one customer may hold any share.

    The filter comes first, then the exact join on (customer, salt): rows of a customer go to as many tasks as there
    are salts, by the input partition they come from.
    """
    salted = maybe_labelled(rows, labels, n_labels).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    ids = labels.select(
        F.col("customer_id").alias("_labelled"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of_salt")
    )
    same = (F.col("customer_id").cast("string") == F.col("_labelled")) & (F.col("_salt") == F.col("_of_salt"))
    if n_labels * SALTS > MOST_LISTED:
        ids = large_side(ids)
    kept = salted.join(ids, same, "left_semi").drop("_salt")
    return kept.withColumn("customer_id", F.col("customer_id").cast("string"))


def clean_transactions(transactions: DataFrame, labels: DataFrame, n_labels: int | None = None) -> DataFrame:
    """Typed payments of labelled customers; with the number of labels the raw rows are filtered in the scan."""
    if n_labels is None:
        kept = keep_labelled(transactions, labels)
    else:
        kept = keep_labelled_spread(transactions, labels, n_labels)
    typed = kept.select(
        "customer_id",
        *(number_or_zero(c, "int").alias(c)
          for c in ("payment_method_id", "payment_plan_days", "is_auto_renew", "is_cancel")),
        *(number_or_zero(c).alias(c) for c in ("plan_list_price", "actual_amount_paid")),
        "transaction_date",
        "membership_expire_date",
        parse_yyyymmdd("transaction_date").alias("transaction_date_dt"),
        parse_yyyymmdd("membership_expire_date").alias("membership_expire_date_dt"),
    )
    discount = F.col("plan_list_price") - F.col("actual_amount_paid")
    per_day = F.when(
        F.col("payment_plan_days") > 0, F.col("actual_amount_paid") / F.col("payment_plan_days")
    ).otherwise(0.0)
    return typed.withColumns({
        "transaction_month": month_text("transaction_date_dt"),
        "expire_month": month_text("membership_expire_date_dt"),
        "discount_amount": discount,
        "is_discounted": flag(discount > 0),
        "paid_per_day": per_day,
    })


def monthly_activity(user_logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Customer x month activity; distinct days are exact over the whole month.

    The first aggregate, per customer and day, combines map-side and removes repeated days, so the
    distinct count needs no expansion.  Filtering to labelled customers comes last, on rows that
    the calendar bounds: filtering the raw log first would send all rows of a very busy customer
    to the task of that customer.
    """
    typed = user_logs.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        "date",
        month_text(parse_yyyymmdd("date")).alias("activity_month"),
        *(number_or_zero(c, "bigint").alias(c) for c in LOG_COUNTS),
        number_or_zero("total_secs").alias("total_secs"),
    )
    daily = typed.groupBy("customer_id", "activity_month", "date").agg(
        *(F.sum(c).alias(c) for c in (*LOG_COUNTS, "total_secs"))
    )
    return monthly_from_daily(daily, labels)


def monthly_from_daily(daily: DataFrame, labels: DataFrame) -> DataFrame:
    """Months of labelled customers from one row per customer and day."""
    monthly = daily.groupBy("customer_id", "activity_month").agg(
        F.count("date").alias("active_days"), *(F.sum(c).alias(c) for c in (*LOG_COUNTS, "total_secs"))
    )
    return keep_labelled(monthly, labels).withColumn(
        "total_plays", sum((F.col(c) for c in PLAY_BANDS), F.lit(0))
    )


def completion_rate_proxy() -> Column:
    return F.when(F.col("total_plays") > 0, F.col("num_100") / F.col("total_plays")).otherwise(0.0)


def engagement_score() -> Column:
    score = (
        F.log1p("total_secs") + 0.25 * F.log1p("num_unq") + 0.5 * F.log1p("active_days")
    )
    return F.round(score, SCORE_DECIMALS)


def user_logs_monthly(user_logs: DataFrame, labels: DataFrame) -> DataFrame:
    return monthly_activity(user_logs, labels).withColumns({
        "completion_rate_proxy": completion_rate_proxy(),
        "engagement_score": engagement_score(),
    })


def data_quality_summary(labels: DataFrame, members: DataFrame, transactions: DataFrame,
                         logs_monthly: DataFrame) -> DataFrame:
    """Row and customer counts of the four cleaned tables, as metric rows."""
    one = labels.agg(
        F.count("*").alias("train_rows"),
        F.count_distinct("customer_id").alias("train_unique_users"),
        F.avg("is_churn").alias("churn_rate"),
    )
    two = members.agg(F.count("*").alias("members_rows"))
    three = transactions.agg(
        F.count("*").alias("transactions_rows"),
        F.count_distinct("customer_id").alias("transaction_unique_users"),
        F.count_if(F.col("transaction_month").isNull()).alias("transactions_without_month"),
    )
    four = logs_monthly.agg(
        F.count("*").alias("user_log_monthly_rows"),
        F.count_distinct("customer_id").alias("user_log_unique_users"),
    )
    # Each side is a one-row aggregate.
    return one.crossJoin(two).crossJoin(three).crossJoin(four)
