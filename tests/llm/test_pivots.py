from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import pivots

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(whole):
        if q % 50 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(whole[q][0], v)), i) for i, vs in whole.items() if i != q for v in vs
            )[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("slice_rows", [64, 8192])
def test_like_brute_force(spark, store, monkeypatch, slice_rows):
    monkeypatch.setattr(pivots, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 3)
    monkeypatch.setattr(pivots, "STEP", 16)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # ties
    rows += [(500, None), (501, [1.0, None]), (550, [math.nan] * 8), (502, [math.inf] * 8), (600, []), (650, [3.0]), (None, [1.0] * 8), (7, [9.0] * 8)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = pivots.op9_pivot_top_k(store, frame).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_few_and_no_vectors(spark, store):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 1.0]), (50, [0.0, -1.0])]
    got = pivots.op9_pivot_top_k(store, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert pivots.op9_pivot_top_k(store, spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        pivots.op9_pivot_top_k(store, spark.createDataFrame([(0, [1e9])], SCHEMA))


@pytest.mark.parametrize("slice_rows", [64, 8192])
def test_long_vectors_are_scored_exactly(spark, store, monkeypatch, slice_rows):
    monkeypatch.setattr(pivots, "SLICE_ROWS", slice_rows)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(250)]
    rows += [(i, [float(np.float32(rng.uniform(1e6, 2e6))) for _ in range(6)]) for i in (250, 251, 252, 300)]
    # Scores beyond 2^53 that differ by 1 only.
    rows += [(400, [2.0**22, 1 / 256]), (401, [2.0**22, 1 / 256]), (402, [2.0**22, 2 / 256]), (403, [70_000.0])]
    got = pivots.op9_pivot_top_k(store, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("block_rows", [2, 2048])
def test_queries_that_repeat_an_id_like_the_sql_form(spark, store, monkeypatch, block_rows):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(pivots, "SLICE_ROWS", 32)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(4)]) for i in range(120)]
    rows += [(50, [2.0, 2.0, 0.0, 0.0]), (50, [-2.0, 0.0, 2.0, 0.0]), *[(100, [0.0, 0.0, 0.0, 3.0])] * 7, (None, [9.0] * 4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    want = con.execute(pivots.OP9_SQL).fetchall()
    got = pivots.op9_pivot_top_k(store, frame).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_save_evaluations():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (20, 16)).astype(float)
    points = centres[rng.integers(0, 20, 2000)] + rng.integers(-30, 30, (2000, 16))
    ids = np.arange(2000)
    _, _, evaluated = pivots.best_of_slice(ids[:10], points[:10], np.full(10, -1e18), ids, points, points[::100], 5)
    assert evaluated < 10 * 2000 / 3


def test_sql_form(spark, store):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = con.execute(pivots.OP9_SQL).fetchall()
    got = pivots.op9_pivot_top_k(store, spark.read.parquet(path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
