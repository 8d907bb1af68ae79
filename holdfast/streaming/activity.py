"""Activity logs taken in file by file: the chunked read of a log too large to load at once.

Each trigger takes a few files and writes their sums per customer and day to a folder of its own; the
sums of all triggers are added when the result is read.  No state is kept, so a day may arrive in any
file, however late.  A replayed trigger overwrites its folder, so the result is the same after a
failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.columns import number_or_zero, parse_yyyymmdd
from holdfast.operators.clean import LOG_COUNTS, monthly_from_daily
from holdfast.sources.raw import USER_LOGS_SCHEMA

SUMMED = (*LOG_COUNTS, "total_secs")


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    return (
        spark.readStream.schema(USER_LOGS_SCHEMA)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
        .withColumnRenamed("msno", "customer_id")
    )


def daily_activity(logs: DataFrame) -> DataFrame:
    """Sums per customer and day; a day that does not parse is left out."""
    typed = logs.select(
        "customer_id",
        parse_yyyymmdd("date").alias("day"),
        *(number_or_zero(c, "bigint").alias(c) for c in LOG_COUNTS),
        number_or_zero("total_secs").alias("total_secs"),
    ).filter(F.col("day").isNotNull())
    return typed.groupBy("customer_id", "day").agg(*(F.sum(c).alias(c) for c in SUMMED))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 100) -> None:
    """Takes in every file that is not yet ingested, then stops."""
    def keep(files: DataFrame, trigger: int) -> None:
        daily_activity(files).write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

    query = (
        log_stream(spark, folder, files_per_trigger)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def monthly_activity(spark: SparkSession, out: str, labels: DataFrame) -> DataFrame:
    """Customer x month activity from the added sums of each customer and day."""
    written = spark.read.parquet(out).groupBy("customer_id", "day").agg(*(F.sum(c).alias(c) for c in SUMMED))
    daily = written.select(
        "customer_id",
        F.date_format("day", "yyyy-MM").alias("activity_month"),
        F.date_format("day", "yyyyMMdd").cast("int").alias("date"),
        *SUMMED,
    )
    return monthly_from_daily(daily, labels)
