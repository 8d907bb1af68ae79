"""Months that arrive later, against a rebuild from everything."""

from __future__ import annotations

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.config import FIXTURE
from holdfast.plans.engine import RetentionEngine
from holdfast.plans.refresh import refresh_customer_month
from holdfast.sources.raw import write_parquet
from holdfast.sources.star_schema import StarSchema

SF_DIR = "/root/testdata/sf0.001"


def files(folder):
    return {
        month: sorted(f for f in os.listdir(f"{folder}/{month}") if f.endswith(".parquet"))
        for month in os.listdir(folder) if month.startswith("snapshot_month=")
    }


@pytest.fixture(scope="module")
def whole(spark):
    return StarSchema(spark, SF_DIR).tables()


def test_refresh_equals_a_rebuild(spark, whole, tmp_path):
    # Payments of the last two months and a few late ones of an early month arrive later, and half of the logs.
    text = F.regexp_replace(F.col("transaction_date").cast("string"), "-", "")
    late = (text >= "20000601") | ((text.substr(1, 6) == "199902") & (F.xxhash64("customer_id") % 2 == 0))
    late_log = F.xxhash64("customer_id") % 2 == 0
    before = replace(whole, transactions=whole.transactions.filter(~late), user_logs=whole.user_logs.filter(~late_log))
    arrived = whole.transactions.filter(late), whole.user_logs.filter(late_log)
    folder = str(tmp_path / "layers" / "customer_month")
    write_parquet(RetentionEngine(spark, before, FIXTURE).table("customer_month"), folder, ["snapshot_month"])
    old = files(folder)

    engine = RetentionEngine(spark, whole, FIXTURE)
    replaced = refresh_customer_month(engine, str(tmp_path), *arrived)
    want = engine.table("customer_month")
    got = spark.read.schema(want.schema).parquet(folder).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    new = files(folder)
    assert "2000-07" in replaced and len(replaced) < len(new)
    untouched = [m for m in old if m.split("=")[1] not in replaced]
    assert untouched and all(new[m] == old[m] for m in untouched)

    # Nothing new, so nothing is written.
    assert refresh_customer_month(engine, str(tmp_path), *arrived) == []
    none = whole.transactions.limit(0), whole.user_logs.limit(0)
    assert refresh_customer_month(engine, str(tmp_path), *none) == []
    assert files(folder) == new
