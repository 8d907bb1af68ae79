"""Short constant tables as local relations: planned and broadcast without a job."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """``schema`` is "name type, name type" over int, bigint, double, string and boolean."""
    fields = [field.split() for field in schema.split(",")]
    arrays = [
        pa.array([row[i] for row in rows], type=ARROW_TYPES[kind]) for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))
