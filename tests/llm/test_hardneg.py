from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in vector]
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for vec_id, label, v in {(i, y, tuple(v)) for i, y, v in usable if i % 100 == 0}:
        others = sorted((-dot(v, u), i, y) for i, y, u in usable if i != vec_id)
        positives = [(-s, i) for s, i, y in others if y == label][:5]
        for score, positive in positives:
            window = [(-s, i) for s, i, y in others if y != label and 80 * score <= -100 * s <= 100 * score][:5]
            out += [(vec_id, positive, rank, i, score, s) for rank, (s, i) in enumerate(window, start=1)]
    return sorted(out)


def mined(spark, store, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as code", "3 as anchor").repartition(3)
    return sorted(map(tuple, hardneg.op13_one_bit_negatives(store, frame).collect()))


def clustered(seed, n=900, width=24, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + spread * rng.normal(size=width)
        label = int(rng.integers(10)) if i % 3 else 4  # one label holds a third
        rows.append((int(i), [float(x) for x in v / np.linalg.norm(v)], label))
    return rows


@pytest.mark.parametrize("slice_rows,block_rows", [(8192, 1024), (100, 2)])
def test_like_brute_force(spark, store, monkeypatch, slice_rows, block_rows):
    monkeypatch.setattr(hardneg, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", block_rows)
    rows = clustered(1)
    want = brute(rows)
    assert mined(spark, store, rows) == want and len(want) > 100


def test_odd_rows_ties_and_repeats(spark, store):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)], rng.randrange(2)) for i in range(160)]
    rows += [
        (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.0, 0.5], 0), (None, [0.5, 0.5, 0.5], 1), (200, None, 1),
        (300, [0.5, 0.5, 0.5], None), (400, [0.5, None, 0.5], 1), (401, [0.5, float("nan"), 0.5], 1), (402, [float("inf"), 0.0, 0.0], 0),
        (500, [], 1), (501, [0.5], 0), (600, [2.0**20, 0.0, 0.0], 1), (601, [2.0**20, 1.0, 0.0], 0), (602, [2.0**20, 0.0, 1.0], 1),
        (-100, [0.5, 0.25, 0.5], 1), (7, [0.25, 0.25, 0.25], 9), (14, [0.25, 0.25, 0.25], 9),
    ] + [(33, [0.5, 0.5, 0.25], 1)] * 8
    rows = [r for r in rows if r[0] != 500 or r[1] is not None]
    padded = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))], y) for i, v, y in rows]
    assert mined(spark, store, rows) == brute(padded)


def test_empty_and_single(spark, store):
    assert mined(spark, store, []) == []
    assert mined(spark, store, [(100, [0.5], 1)]) == []
    assert mined(spark, store, [(100, [0.5], 1), (101, [0.5], 1)]) == []  # a positive, but no other label


def test_vectors_too_long_for_a_score_take_no_part(spark, store):
    rows = [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [1.0, 0.0], 2), (103, [2.0**24, 0.0], 2), (104, [1e30, 0.0], 1)]
    assert mined(spark, store, rows) == [(100, 101, 1, 102, 65536, 65536)]


def slice_of(points):
    points = np.floor(points)
    code, align, rest, long = hardneg.one_bit(points)
    return hardneg.Slice(pa.table({
        "vec_id": np.arange(len(points)), "label": np.zeros(len(points), np.int64),
        "v": pa.array([p.astype("<i8").tobytes() for p in points], pa.binary()),
        "code": pa.array([c.tobytes() for c in code], pa.binary()), "align": align, "rest": rest, "long": long,
    }), points.shape[1])


@pytest.mark.parametrize("width,scale", [(1, 10), (3, 1000), (64, 256), (70, 1e6), (130, 3)])
def test_intervals_always_hold(width, scale):
    rng = np.random.default_rng(width)
    points = np.concatenate((rng.normal(size=(300, width)) * scale, np.zeros((2, width)), np.eye(width)[:2] * scale))
    held = slice_of(points)
    for anchor in held.points[[0, 5, 300, 302]]:
        low, high = held.intervals(anchor)
        truth = held.points @ anchor
        assert (low <= truth).all() and (truth <= high).all()


def test_intervals_leave_most_of_a_clustered_table_unscored():
    rows = clustered(3, n=6000, width=64, spread=0.03)
    held = slice_of(np.array([v for _, v, _ in rows]) * 256)
    held.best(held.points[0], held.ids != 0, np.array([hardneg._LOW]), np.array([-hardneg._LOW]), 5)
    assert held.scored < 0.3 * len(rows)


def test_far_vectors_are_scored_in_whole_numbers():
    held = slice_of(np.array([[2.0**30, 1, 0], [2.0**30, 0, 1], [2.0**30, 1, 1]]))
    assert held.scores(held.points[0], np.arange(3)).tolist() == [2**60 + 1, 2**60, 2**60 + 1]
