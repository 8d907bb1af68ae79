from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from holdfast.functions import columns as c
from holdfast.functions.proportions import erf, normal_cdf, power, sample_size


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,months", [
    ("2017-01-31", "2017-02-01", 1), ("2017-01-01", "2017-01-31", 0), ("2016-12-15", "2018-01-01", 13),
    ("2017-03-01", "2017-01-31", -2),
])
def test_calendar_months(spark, a, b, months):
    assert _one(spark, c.calendar_months(F.to_date(F.lit(a)), F.to_date(F.lit(b)))) == months


@pytest.mark.parametrize("text,day", [(20170131, "2017-01-31"), (20171301, None), (None, None)])
def test_parse_yyyymmdd(spark, text, day):
    df = spark.createDataFrame([(text,)], "d int")
    got = df.select(c.parse_yyyymmdd("d").alias("d")).first()["d"]
    assert (str(got) if got else None) == day


def test_ratio_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0), (1.0, -2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(c.ratio("a", "b"), c.positive_ratio("a", "b"), c.share_or_zero("a", "b")).collect()]
    assert got == [(None, None, 0.0), (None, None, 0.0), (0.25, 0.25, 0.25), (-0.5, None, 0.0)]


def test_first_match_order_and_default(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "v int")
    col = c.first_match([(F.col("v") < 3, "a"), (F.col("v") < 7, "b")], "c")
    assert [r[0] for r in df.select(col).collect()] == ["a", "b", "c", "c"]


def test_hash_to_unit_is_sha256(spark):
    want = int(hashlib.sha256(b"seed|abc").hexdigest()[:16], 16) / float(16**16 - 1)
    assert _one(spark, c.hash_to_unit("seed", F.lit("abc"))) == want


@pytest.mark.parametrize("value,text", [
    (1.694e9, "$1.69B"), (97_436_104.6, "$97.44M"), (750_000.0, "$750K"), (999.4, "$999"), (None, ""),
    (-2_500_000.0, "$-2.50M"),
])
def test_money_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(c.money_text("v")).first()[0] == text


def test_other_texts(spark):
    assert _one(spark, c.percent_text(F.lit(0.1410))) == "14.10%"
    assert _one(spark, c.times_text(F.lit(20.004))) == "20.00x"
    assert _one(spark, c.count_text(F.lit(970960))) == "970,960"


@pytest.mark.parametrize("x", [-3.0, -0.7, 0.0, 0.2, 1.96, 4.0])
def test_normal_cdf(spark, x):
    assert abs(_one(spark, normal_cdf(F.lit(x))) - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-14


def test_erf_over_its_whole_range(spark):
    xs = [s * x for x in [0.0, 1e-300, 1e-9, 0.1, 0.46875, 0.4687500001, 1.0, 2.0, 3.99, 4.0, 4.01, 5.9, 30.0, 1e200] for s in (1, -1)]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in frame.select("x", erf(F.col("x")).alias("y")).collect():
        assert abs(r.y - math.erf(r.x)) <= 1e-15 * max(1.0, abs(math.erf(r.x))) + 2e-16


def test_planning_stays_in_generated_code(spark):
    """No stage falls back because its code has grown too large."""
    frame = spark.range(5).selectExpr("0.4D + id / 100D as a", "0.3D + id * 0D as b", "id * 1000 as n")
    planned = frame.select(power(F.col("a"), F.col("b"), F.col("n")).alias("p"), sample_size(F.col("a"), F.col("b"), F.lit(0.84)).alias("n"))
    stages = planned._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and all(0 < size < 8000 for size in sizes)


# Published planning figures for a control rate of 0.64808 with 31,406 customers per arm.
@pytest.mark.parametrize("reduction,reach,rows", [(0.01, 0.39627, 85_499), (0.02, 0.923, None), (0.03, 0.999, None)])
def test_published_power(spark, reduction, reach, rows):
    base = 0.648080
    p1, p2 = F.lit(base), F.lit(base * (1 - reduction))
    assert abs(_one(spark, power(p1, p2, F.lit(31_406))) - reach) < 6e-4
    if rows:
        assert abs(_one(spark, sample_size(p1, p2, F.lit(0.84))) - rows) < 30


def test_no_effect_has_no_sample_size(spark):
    assert _one(spark, sample_size(F.lit(0.2), F.lit(0.2), F.lit(0.84))) is None


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        c.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"], "a test")


def test_equal_leaders_are_told_apart_by_name(spark):
    rows = [("b", "x", 5.0, 1), ("a", "y", 5.0, 2), ("a", "x", 5.0, 3), ("c", "x", None, 4), ("d", "x", 1.0, 5)]
    df = spark.createDataFrame(rows, "tier string, stage string, lost double, customers int")
    for parts in (1, 5):
        got = c.top_pick(df.repartition(parts), "lost", {"top_tier": "tier", "top_customers": "customers"})
        assert [tuple(r) for r in got.collect()] == [("a", 3)]
    assert tuple(c.top_pick(df.filter("lost is null"), "lost", {"t": "tier"}).first()) == (None,)
