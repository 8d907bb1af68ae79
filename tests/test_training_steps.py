"""Order statistics, Newton steps and leaf-wise trees against independent single-machine versions."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.config import ModelSettings
from holdfast.operators import boosting, logistic, order_stats

SETTINGS = ModelSettings(boosting_rounds=6)


def frame_of(spark, columns: dict, parts: int = 3):
    names = list(columns)
    kinds = ", ".join(f"{n} double" for n in names)
    rows = [tuple(None if v is None else float(v) for v in row) for row in zip(*columns.values())]
    return spark.createDataFrame(rows, kinds).repartition(parts)


def test_ordered_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -1.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    ordered = order_stats.to_ordered(values)
    assert (ordered[1:] >= ordered[:-1]).all() and ordered[4] == ordered[5]
    assert np.array_equal(order_stats.from_ordered(ordered), values + 0.0)


@pytest.mark.parametrize("bits", [5, 8, 11])
def test_ranks_equal_sorting(spark, store, bits):
    rng = random.Random(bits)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(701)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(701)],
        "third_alike": [7.25 if rng.random() < 0.4 else rng.uniform(7, 8) for _ in range(701)],
        "few": [rng.randrange(4) - 1 for _ in range(701)],
        "gaps": [None if rng.random() < 0.5 else float("nan") if rng.random() < 0.2 else rng.random() for _ in range(701)],
        "never": [None] * 701,
        "one": [None] * 700 + [3.5],
    }
    cells = order_stats.value_cells(frame_of(spark, columns), list(columns), lambda n: range(0, n, 50), keep_all=4, bits=bits)
    for name, raw in columns.items():
        held = sorted(v for v in raw if v is not None and not math.isnan(v))
        assert cells[name].rows == len(held)
        assert [cells[name].at(r) for r in range(0, len(held), 50)] == held[::50]
        assert cells[name].complete == (len(set(held)) <= 4)
    assert cells["few"].values.tolist() == [-1, 0, 1, 2] and cells["few"].counts.sum() == 701


def test_medians(spark, store):
    columns = {"odd": [3, 1, 2, None], "even": [4, 1, 3, 2], "none": [None] * 4, "ends": [-5, 1e300, None, None]}
    got = order_stats.medians(frame_of(spark, columns), list(columns))
    assert got == {"odd": 2.0, "even": 2.5, "none": None, "ends": (1e300 - 5) / 2}
    assert order_stats.medians(frame_of(spark, columns).limit(0), ["odd"]) == {"odd": None}


def test_newton_reaches_the_only_minimum(spark, store):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5)) * [1, 3, 0.1, 1, 0]  # the last column is constant
    y = (rng.random(900) < 1 / (1 + np.exp(-(x @ [1, -0.5, 2, 0, 3] - 1)))).astype(float)
    w = np.where(y == 1, 2.0, 0.7)
    names = [f"x{i}" for i in range(5)]
    frame = frame_of(spark, {**{n: x[:, i] for i, n in enumerate(names)}, "y": y, "w": w})
    model = logistic.fit(frame, names, "y", "w", 100)

    def loss_and_slope(at):
        z = x @ at[:-1] + at[-1]
        p = 1 / (1 + np.exp(-z))
        loss = (w * (np.logaddexp(0, z) - y * z)).sum() + at[:-1] @ at[:-1] / 2
        return loss, np.append(x.T @ (w * (p - y)) + at[:-1], (w * (p - y)).sum())

    found = np.array([*model.weights, model.intercept])
    lowest, slope = loss_and_slope(found)
    assert np.abs(slope).max() < 1e-9
    for _ in range(200):  # convex, so a zero slope is the minimum; and no neighbour is lower
        assert loss_and_slope(found + rng.normal(size=6) * 10.0 ** rng.uniform(-5, 0))[0] >= lowest
    assert np.abs(logistic.gradient_at(frame, model, "y", "w")).max() < 1e-12
    again = logistic.fit(frame.repartition(7), names, "y", "w", 100)
    assert again.weights == pytest.approx(model.weights, abs=1e-12)
    got = frame.select(model.probability([F.col(n) for n in names]).alias("p"), *names).toPandas()
    want = 1 / (1 + np.exp(-(got[names].to_numpy() @ found[:-1] + found[-1])))
    assert np.abs(got["p"] - want).max() < 1e-12


def test_newton_without_rows_and_with_one_class(spark, store):
    empty = frame_of(spark, {"x": [1.0], "y": [1.0], "w": [1.0]}).limit(0)
    assert logistic.fit(empty, ["x"], "y", "w", 10).intercept == 0.0
    one = logistic.fit(frame_of(spark, {"x": [1.0, 2.0], "y": [1.0, 1.0], "w": [1.0, 1.0]}), ["x"], "y", "w", 50)
    assert np.isfinite(one.intercept) and one.intercept > 5


# --- trees ---------------------------------------------------------------------------------------


def brute_bins(column: np.ndarray, bins: int) -> np.ndarray:
    held = np.sort(column[~np.isnan(column)])
    values = np.unique(held)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique([held[len(held) * i // bins] for i in range(1, bins)])


def brute_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, s: ModelSettings):
    """Best-first growth one split at a time, every split searched from the rows themselves."""
    lam = s.leaf_penalty

    def best(rows):
        found = None
        total = g[rows].sum() ** 2 / (h[rows].sum() + lam)
        for f in range(bins.shape[1]):
            column = bins[rows, f]
            for missing_left in (False, True):
                if missing_left and not (column == boosting.MISSING).any():
                    continue
                for cut in range(boosting.MISSING):
                    left = (column <= cut) | ((column == boosting.MISSING) & missing_left)
                    left &= (column != boosting.MISSING) | missing_left
                    if left.sum() < s.min_leaf_rows or (~left).sum() < s.min_leaf_rows:
                        continue
                    gain = sum(g[rows[side]].sum() ** 2 / (h[rows[side]].sum() + lam) for side in (left, ~left)) - total
                    key = (-round(gain, 7), missing_left, f, cut)
                    if gain > 0 and (found is None or key < found[0]):
                        found = key, rows[left], rows[~left], gain
                    if cut > column[column != boosting.MISSING].max(initial=0):
                        break
        return found

    leaves, splits = [np.arange(len(g))], []
    options = [best(leaves[0])]
    while len(leaves) < s.max_leaves and any(options):
        at = min((o[0][0], i) for i, o in enumerate(options) if o)[1]
        key, left, right, _ = options[at]
        splits.append(key[1:])
        leaves[at:at + 1] = [left, right]
        options[at:at + 1] = [best(left) if len(left) >= 2 * s.min_leaf_rows else None, best(right) if len(right) >= 2 * s.min_leaf_rows else None]
    value = np.zeros(len(g))
    for rows in leaves:
        value[rows] = -s.boosting_step * g[rows].sum() / (h[rows].sum() + lam)
    return splits, value


def planted(seed: int, n: int = 2000):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 12, n), rng.exponential(size=n), rng.integers(0, 3, n) - 1.0])
    z = 2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] % 3 == 1) + (x[:, 2] > 1) * (x[:, 0] < 0) + 0.3 * rng.normal(size=n) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * z))).astype(float)
    x[rng.random(n) < 0.1, 2] = np.nan
    return x, y


def test_trees_equal_a_brute_force_trainer(spark, store):
    x, y = planted(1)
    s = replace(SETTINGS, boosting_rounds=2, max_leaves=9, bins=20)
    names = ["a", "b", "c", "d"]
    frame = frame_of(spark, {**{n: [None if math.isnan(v) else v for v in x[:, i]] for i, n in enumerate(names)}, "y": y})
    model = boosting.fit(store, frame.withColumn("aside", F.lit(False)), names, "y", "aside", s)
    cuts = [brute_bins(x[:, i], s.bins) for i in range(4)]
    bins = boosting.to_bins(x, cuts)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    assert model.base == pytest.approx(margin[0], abs=1e-12)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        splits, value = brute_tree(bins, p - y, p * (1 - p), s)
        inner = {(tree.missing_left[i], tree.feature[i], tree.cut_bin[i]) for i, f in enumerate(tree.feature) if f != boosting.LEAF}
        assert inner == set(splits) and sum(f == boosting.LEAF for f in tree.feature) == len(splits) + 1
        got = np.array(tree.value)[tree.leaves_of_values(x)]
        assert np.abs(got - value).max() < 1e-9
        assert np.array_equal(tree.leaves_of_values(x), tree.leaves_of_bins(bins))
        margin += value


def test_growth_in_batches_equals_split_by_split(spark, store, monkeypatch):
    x, y = planted(2, 4000)
    names = ["a", "b", "c", "d"]
    frame = frame_of(spark, {**{n: x[:, i] for i, n in enumerate(names)}, "y": y}).withColumn("aside", F.lit(False))
    s = replace(SETTINGS, boosting_rounds=1, max_leaves=31)
    passes, plain = [], boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: passes.append(len(a[3])) or plain(*a))
    model = boosting.fit(store, frame, names, "y", "aside", s)
    assert len(passes) <= 12  # not a pass per split
    replay = boosting._replay

    def one_at_a_time(tree, splits, leaves):
        accepted, unknown = replay(tree, splits, leaves)
        return accepted, unknown[:1]

    monkeypatch.setattr(boosting, "_replay", one_at_a_time)
    slow = boosting.fit(store, frame, names, "y", "aside", s)
    assert [t.feature for t in slow.trees] == [t.feature for t in model.trees]
    assert [t.value for t in slow.trees] == [t.value for t in model.trees]


def test_trees_do_not_depend_on_the_partitions_or_refreshes(spark, store, monkeypatch):
    x, y = planted(3)
    names = ["a", "b", "c", "d"]
    columns = {**{n: x[:, i] for i, n in enumerate(names)}, "y": y}
    fits = []
    for parts, refresh in ((1, 12), (5, 12), (5, 2)):
        monkeypatch.setattr(boosting, "REFRESH", refresh)
        frame = frame_of(spark, columns, parts).withColumn("aside", F.col("a") > 1.2)
        fits.append(boosting.fit(store, frame, names, "y", "aside", replace(SETTINGS, boosting_rounds=4)))
    assert [t.feature for t in fits[0].trees] == [t.feature for t in fits[1].trees] == [t.feature for t in fits[2].trees]
    assert fits[0] == fits[1]


def test_early_stop_and_learning(spark, store):
    x, y = planted(4, 3000)
    noise = np.random.default_rng(5).integers(0, 2, 3000).astype(float)
    names = ["a", "b", "c", "d"]
    frame = frame_of(spark, {**{n: x[:, i] for i, n in enumerate(names)}, "y": y, "noise": noise}).withColumn(
        "aside", F.pmod(F.xxhash64("a"), F.lit(5)) == 0
    )
    model = boosting.fit(store, frame, names, "y", "aside", replace(SETTINGS, boosting_rounds=5))
    p = 1 / (1 + np.exp(-model.margin(x)))
    assert p[y == 1].mean() > p[y == 0].mean() + 0.1
    got = frame.select(model.probability([F.col(n) for n in names]).alias("p")).toPandas()["p"]
    assert sorted(got) == pytest.approx(sorted(p), abs=1e-12)
    dull = boosting.fit(store, frame, names, "noise", "aside", replace(SETTINGS, boosting_rounds=30, stop_rounds=4))
    assert len(dull.trees) < 30  # noise stops early


def test_one_class_and_no_rows(spark, store):
    frame = frame_of(spark, {"a": [1.0, 2.0, None], "y": [1.0, 1.0, 1.0]}).withColumn("aside", F.lit(False))
    model = boosting.fit(store, frame, ["a"], "y", "aside", SETTINGS)
    assert model.trees == () and model.base > 10
    assert boosting.fit(store, frame.limit(0), ["a"], "y", "aside", SETTINGS).base == 0.0


def test_stop_rule():
    s = replace(SETTINGS, stop_rounds=3, stop_gain=0.01)
    assert not boosting.stops([1.0, 1.1, 1.2], s)
    assert boosting.stops([1.0, 1.1, 1.2, 0.995], s)
    assert not boosting.stops([1.0, 1.1, 1.2, 0.9], s)
