from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators.ranking import (
    ROW_NO, Key, ntile_edges, number_rows, quantile_edges, rank_bucket, running_bands, share_edges,
)


def _frame(spark, rows: int, partitions: int):
    # A third of all rows share one value.
    return spark.range(rows, numPartitions=partitions).select(
        F.format_string("c%05d", F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % 101).cast("double")).alias("v"),
    )


@pytest.mark.parametrize("rows", [1, 9, 10, 11, 91, 500])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_number_rows_equals_plain_sort(spark, store, rows, descending, partitions):
    df = _frame(spark, rows, partitions)
    order = [Key("v", descending), Key("id")]
    ranked = number_rows(store, f"t{rows}{descending}{partitions}", df, order, running={"so_far": "v"})
    got = ranked.frame.toPandas().sort_values(ROW_NO)
    want = df.toPandas().sort_values(["v", "id"], ascending=[not descending, True])
    assert ranked.rows == rows
    assert got[ROW_NO].tolist() == list(range(1, rows + 1))
    assert got["id"].tolist() == want["id"].tolist()
    assert np.allclose(got["so_far"], want["v"].cumsum())
    edges = ranked.rows_at([1, rows])
    assert edges[1]["id"] == want["id"].iloc[0] and edges[rows]["id"] == want["id"].iloc[-1]


def test_bucket_by_edges_equals_bucket_by_rank(spark, store):
    df = _frame(spark, 333, 5)
    ranked = number_rows(store, "edges", df, [Key("v", True), Key("id")])
    edges = ntile_edges(ranked.rows, 10)
    by_edge = {r["id"]: r["b"] for r in df.select("id", ranked.bucket(edges).alias("b")).collect()}
    by_rank = {r["id"]: r["b"] for r in ranked.frame.select("id", rank_bucket(edges).alias("b")).collect()}
    assert by_edge == by_rank
    assert len(set(by_edge.values())) == 10


def test_no_unpartitioned_window_and_no_python(spark, store):
    ranked = number_rows(store, "plan", _frame(spark, 100, 3), [Key("v"), Key("id")], running={"s": "v"})
    plan = ranked.frame._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_empty_input(spark, store):
    ranked = number_rows(store, "none", _frame(spark, 5, 1).filter("false"), [Key("v"), Key("id")])
    assert ranked.rows == 0 and ranked.frame.count() == 0
    assert _frame(spark, 2, 1).select(ranked.bucket(ntile_edges(0, 10)).alias("b")).count() == 2


@pytest.mark.parametrize("rows", [1, 3, 9, 10, 11, 91, 1500])
def test_ntile_sizes(rows):
    edges = [0, *ntile_edges(rows, 10), rows]
    sizes = [b - a for a, b in zip(edges, edges[1:])]
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("rows", [10, 11, 91, 100, 375, 457, 1500, 4676, 71437, 99999])
def test_quantile_edges_equal_the_usual_quantile_cut(rows):
    cut = pd.qcut(pd.Series(np.arange(1, rows + 1, dtype=float)), q=10, labels=False)
    want = cut.value_counts().sort_index().tolist()
    edges = [0, *quantile_edges(rows, 10), rows]
    assert [b - a for a, b in zip(edges, edges[1:])] == want


def test_published_decile_sizes():
    edges = [0, *quantile_edges(71_437, 10), 71_437]
    assert [b - a for a, b in zip(edges, edges[1:])] == [
        7144, 7144, 7143, 7144, 7144, 7143, 7144, 7143, 7144, 7144,
    ]


def test_share_edges_are_exact():
    assert share_edges(150, [10, 50], up=True) == [2, 8]
    assert share_edges(150, [10, 50], up=False) == [1, 7]
    assert share_edges(3, [10], up=False) == [1]


def test_running_bands_keep_empty_bands(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 5.0), (9, 1.0)], "r int, x double")
    out = running_bands(
        df, F.when(F.col("r") <= 1, 1).when(F.col("r") <= 2, 2).when(F.col("r") <= 3, 3).otherwise(4),
        [("a",), ("b",), ("c",)], "label string", {"n": F.count("*"), "x": F.sum("x")}, {"low": F.min("x")},
    ).orderBy("label").collect()
    assert [(r["label"], r["n"], r["x"], r["low"]) for r in out] == [
        ("a", 1.0, 2.0, 2.0), ("b", 1.0, 2.0, 2.0), ("c", 2.0, 7.0, 2.0),
    ]
    assert {r["all_x"] for r in out} == {8.0}
