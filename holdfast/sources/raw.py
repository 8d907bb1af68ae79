"""Typed readers for the raw subscription files, and result sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Raw file schemas.
LABELS_SCHEMA = "msno string, is_churn int"
MEMBERS_SCHEMA = (
    "msno string, city int, bd int, gender string, registered_via int, registration_init_time int"
)
TRANSACTIONS_SCHEMA = (
    "msno string, payment_method_id int, payment_plan_days int, plan_list_price double, "
    "actual_amount_paid double, is_auto_renew int, transaction_date int, "
    "membership_expire_date int, is_cancel int"
)
USER_LOGS_SCHEMA = (
    "msno string, date int, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, "
    "num_unq int, total_secs double"
)


@dataclass(frozen=True)
class RawTables:
    """The four raw inputs; the customer key is named ``customer_id``.

    Dates may be yyyymmdd numbers or real dates; cleaning accepts both.
    """

    labels: DataFrame
    members: DataFrame
    transactions: DataFrame
    user_logs: DataFrame


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file or multi-file CSV with a header; input splits take the place of chunks."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_raw_csv(spark: SparkSession, folder: str) -> RawTables:
    def load(name: str, schema: str) -> DataFrame:
        return read_csv(spark, f"{folder}/{name}", schema).withColumnRenamed("msno", "customer_id")

    return RawTables(
        labels=load("train_v2.csv", LABELS_SCHEMA),
        members=load("members_v3.csv", MEMBERS_SCHEMA),
        transactions=load("transactions_v2.csv", TRANSACTIONS_SCHEMA),
        user_logs=load("user_logs_v2.csv", USER_LOGS_SCHEMA),
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_top_csv(df: DataFrame, path: str, order: list, limit: int) -> None:
    """Ordered export of the first rows: a top-k, not a full sort."""
    write_csv(df.orderBy(*order).limit(limit), path)
