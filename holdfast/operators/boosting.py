"""Boosted trees, grown leaf by leaf from gradient histograms.

Features are cut into at most 255 bins, at all their values where there are few and at exact quantiles
otherwise, and one more bin holds missing values.  A pass adds up gradient, curvature and rows per
(node, feature, bin) in the tasks; only these sums travel.  Of two siblings the one with fewer rows is summed, the
other is the difference to the parent.

A tree grows best split first.  One pass serves all nodes that the growth would take next if their children
offered nothing better; then the growth is replayed with what is known, so a tree needs about as many passes as
it is deep, and is the same as if it had been grown split by split.

Gradients are summed as whole numbers, so the trees do not depend on how rows are dealt to tasks.  The score so
far stands beside the bins and is written anew every ``REFRESH`` trees; in between the tasks add the newest
trees themselves.  Growth ends early when the loss of the rows set aside stops falling.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import ModelSettings
from holdfast.operators.order_stats import Cells, value_cells
from holdfast.plans.store import TableStore

MISSING = 255
REFRESH = 12
LEAF = -1
MIN_CURVATURE = 1e-3
_BLOCK = 4096


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1.  Rows up to ``cut`` go left, as bins or as values."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    cut_bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, blank in (
            (self.feature, LEAF), (self.cut_bin, 0), (self.cut, 0.0), (self.missing_left, False), (self.left, 0),
            (self.right, 0), (self.value, 0.0),
        ):
            column.append(blank)
        return len(self.feature) - 1

    def leaves(self, n: int, goes_left) -> np.ndarray:
        """The leaf of each of ``n`` rows; ``goes_left(rows, nodes)`` decides for rows at inner nodes."""
        feature, left, right = (np.array(c) for c in (self.feature, self.left, self.right))
        node = np.zeros(n, np.int64)
        open_ = np.arange(n) if feature[0] != LEAF else np.zeros(0, np.int64)
        while len(open_):
            at = node[open_]
            node[open_] = np.where(goes_left(open_, at), left[at], right[at])
            open_ = open_[feature[node[open_]] != LEAF]
        return node

    def features_above(self) -> list[frozenset[int]]:
        """The features that are asked on the way to each node."""
        above: list[frozenset[int]] = [frozenset()] * len(self.feature)
        for node, f in enumerate(self.feature):  # children have higher numbers
            if f != LEAF:
                above[self.left[node]] = above[self.right[node]] = above[node] | {f}
        return above

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, missing = np.array(self.feature), np.array(self.cut_bin), np.array(self.missing_left)

        def goes_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            b = bins[rows, feature[nodes]]
            return np.where(b == MISSING, missing[nodes], b <= cut[nodes])

        return self.leaves(len(bins), goes_left)

    def leaves_of_values(self, x: np.ndarray) -> np.ndarray:
        feature, cut, missing = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)

        def goes_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            v = x[rows, feature[nodes]]
            return np.where(np.isnan(v), missing[nodes], v <= cut[nodes])

        return self.leaves(len(x), goes_left)


@dataclass(frozen=True)
class BoostedTrees:
    features: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _sum(self.base, [np.array(tree.value)[tree.leaves_of_values(x)] for tree in self.trees], len(x))

    def used(self) -> list[int]:
        """Features that any tree asks for."""
        return sorted({f for tree in self.trees for f in tree.feature if f != LEAF})

    def moves(self, pairs: DataFrame) -> DataFrame:
        """Rows whose score changes when one feature takes the donor's value: i, repeat, label, old, new.

        ``pairs`` has repeat, label, x and donor.  A tree is asked again only for rows whose way through it meets the
        feature; all others keep its old answer.
        """
        above = [tree.features_above() for tree in self.trees]
        values = [np.array(tree.value) for tree in self.trees]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, donor = (np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("x", "donor"))
                leaves = [tree.leaves_of_values(x) for tree in self.trees]
                answers = [value[leaf] for value, leaf in zip(values, leaves)]
                old = _probability(self.base, answers, len(x))
                for f in self.used():
                    shuffled = x.copy()
                    shuffled[:, f] = donor[:, f]
                    differs = ~((x[:, f] == donor[:, f]) | (np.isnan(x[:, f]) & np.isnan(donor[:, f])))
                    again = []
                    for tree, value, leaf, answer, names in zip(self.trees, values, leaves, answers, above):
                        meets = np.array([f in n for n in names])
                        at = np.flatnonzero(differs & meets[leaf])
                        if len(at):
                            answer = answer.copy()
                            answer[at] = value[tree.leaves_of_values(shuffled[at])]
                        again.append(answer)
                    new = _probability(self.base, again, len(x))
                    moved = np.flatnonzero(new != old)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(moved), f, np.int32)), batch.column("repeat").take(pa.array(moved)),
                        batch.column("label").take(pa.array(moved)), pa.array(old[moved]), pa.array(new[moved]),
                    ], ["i", "repeat", "label", "old", "new"])

        return pairs.mapInArrow(run, "i int, repeat int, label int, old double, new double")

    def probability(self, columns: Sequence[Column]) -> Column:
        """The score of the given feature columns, a batch of rows at a time."""
        @F.pandas_udf("double")
        def run(x: pd.DataFrame) -> pd.Series:
            values = x.to_numpy(dtype=float)
            answers = [np.array(tree.value)[tree.leaves_of_values(values)] for tree in self.trees]
            return pd.Series(_probability(self.base, answers, len(values)))

        return run(F.struct(*(c.cast("double").alias(f"f{i}") for i, c in enumerate(columns))))


def _sum(base: float, answers: Sequence[np.ndarray], n: int) -> np.ndarray:
    """Tree by tree in order, so equal answers give the same bits."""
    out = np.full(n, base)
    for answer in answers:
        out += answer
    return out


def _probability(base: float, answers: Sequence[np.ndarray], n: int) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-_sum(base, answers, n)))


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Named columns side by side, nulls as NaN."""
    columns = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def cuts_of(cells: Cells, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last: between neighbouring values, or at the quantiles."""
    if cells.complete:
        return (cells.values[:-1] + cells.values[1:]) / 2
    return np.unique(cells.values)[:bins - 1]


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    def ranks(n: int) -> list[int]:
        return [n * i // bins for i in range(1, bins)]

    cells = value_cells(df, features, ranks, keep_all=bins, bits=8)
    return [cuts_of(cells[f], bins) for f in features]


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, ends in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(ends, x[:, f], "left"))
    return out


def _binned(df: DataFrame, features: Sequence[str], label: str, aside: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """label, whether the row is set aside, its bins, and the score so far."""
    names = list(features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                bins = to_bins(matrix(part, names), cuts)
                yield pa.RecordBatch.from_arrays([
                    part.column("y"), part.column("aside"), pa.array([b.tobytes() for b in bins], pa.binary()),
                    pa.array(np.full(len(bins), base)),
                ], ["y", "aside", "bins", "margin"])

    rows = df.select(*names, F.col(label).cast("double").alias("y"), F.col(aside).alias("aside"))
    return rows.mapInArrow(run, "y double, aside boolean, bins binary, margin double")


def _bin_rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, newest: Sequence[Tree]) -> np.ndarray:
    out = batch.column("margin").to_numpy().copy()
    for tree in newest:
        out += np.array(tree.value)[tree.leaves_of_bins(bins)]
    return out


def _refreshed(rows: DataFrame, newest: Sequence[Tree], width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch, _bin_rows(batch, width), newest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def histograms(
    rows: DataFrame, newest: Sequence[Tree], tree: Tree, nodes: Sequence[int], width: int, unit: float
) -> tuple[dict[int, np.ndarray], float]:
    """Gradient, curvature and rows per (feature, bin) of some nodes, and the loss of the rows set aside.

    The sums are whole numbers of ``unit``; the loss is only asked for with the root.
    """
    place = {node: i for i, node in enumerate(nodes)}
    lookup = np.full(len(tree.feature), -1, np.int64)
    lookup[list(nodes)] = range(len(nodes))
    size = len(nodes) * width * 256

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss = np.zeros((3, size), np.int64), 0
        offset = np.arange(width) * 256
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                bins = _bin_rows(part, width)
                margin, y = _margins(part, bins, newest), part.column("y").to_numpy()
                aside = part.column("aside").to_numpy(zero_copy_only=False)
                if 0 in place and aside.any():
                    loss += int(np.rint((np.logaddexp(0, margin) - y * margin)[aside] / unit).sum())
                node = lookup[tree.leaves_of_bins(bins)]
                mine = np.flatnonzero((node >= 0) & ~aside)
                if not len(mine):
                    continue
                p = 1.0 / (1.0 + np.exp(-margin[mine]))
                gradient, curvature = np.rint((p - y[mine]) / unit), np.rint(p * (1 - p) / unit)
                cell = (node[mine, None] * (width * 256) + offset + bins[mine]).ravel()
                for i, values in enumerate((gradient, curvature, np.ones(len(mine)))):
                    sums[i] += np.bincount(cell, np.repeat(values, width), size).astype(np.int64)
        used = np.flatnonzero(sums[2])
        cells = np.append(used, -1)
        g, h, n = (np.append(s[used], last) for s, last in zip(sums, (loss, 0, 0)))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (cells, g, h, n))), ["cell", "g", "h", "n"])

    merged = rows.mapInArrow(add, "cell bigint, g bigint, h bigint, n bigint").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")
    ).toArrow()  # at most nodes x features x bins
    cell = merged["cell"].to_numpy()
    out, inside = np.zeros((3, size), np.int64), cell >= 0
    for i, c in enumerate("ghn"):
        out[i, cell[inside]] = merged[c].to_numpy()[inside]
    shaped = out.reshape(3, len(nodes), width, 256)
    loss = float(merged["g"].to_numpy()[~inside].sum()) * unit
    return {node: shaped[:, i] for node, i in place.items()}, loss


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut_bin: int
    missing_left: bool
    left: tuple[int, int, int]  # gradient, curvature and rows of the left side


def best_split(sums: np.ndarray, s: ModelSettings, unit: float) -> Split | None:
    """The best split of a node's histogram (3, features, 256); the first feature and bin of equal gains."""
    known, missing = np.cumsum(sums[:, :, :MISSING], axis=2), sums[:, :, MISSING:]
    total = sums.sum(2)[:, 0]
    best: Split | None = None
    for missing_left in ((False, True) if missing[2].any() else (False,)):
        left = known + missing if missing_left else known
        right = total[:, None, None] - left
        allowed = (left[2] >= s.min_leaf_rows) & (right[2] >= s.min_leaf_rows)
        allowed &= (left[1] * unit >= MIN_CURVATURE) & (right[1] * unit >= MIN_CURVATURE)
        if not allowed.any():
            continue
        gain = sum((side[0] * unit) ** 2 / (side[1] * unit + s.leaf_penalty) for side in (left, right))
        gain = np.where(allowed, gain - (total[0] * unit) ** 2 / (total[1] * unit + s.leaf_penalty), -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 0 and (best is None or gain[f, b] > best.gain):
            best = Split(float(gain[f, b]), int(f), int(b), missing_left, tuple(map(int, left[:, f, b])))
    return best


def grow(
    rows: DataFrame, newest: Sequence[Tree], cuts: list[np.ndarray], s: ModelSettings, unit: float
) -> tuple[Tree, float]:
    """One tree, and the loss of the rows set aside before it."""
    width, tree = len(cuts), Tree()
    sums, loss = histograms(rows, newest, tree, [0], width, unit)
    known = dict(sums)
    splits = {0: best_split(known[0], s, unit)}
    totals = {0: tuple(map(int, known[0].sum(2)[:, 0]))}
    cut_nodes: set[int] = set()
    while True:
        accepted, unknown = _replay(tree, splits, s.max_leaves)
        if not unknown:
            break
        wanted = []
        for node in unknown:
            split = splits[node]
            if node not in cut_nodes:
                cut_nodes.add(node)
                tree.left[node], tree.right[node] = left, right = tree.add(), tree.add()
                tree.feature[node], tree.cut_bin[node] = split.feature, split.cut_bin
                tree.cut[node] = float(cuts[split.feature][split.cut_bin]) if split.cut_bin < len(cuts[split.feature]) else math.inf
                tree.missing_left[node] = split.missing_left
                totals[left] = split.left
                totals[right] = tuple(t - part for t, part in zip(totals[node], split.left))
            fewer = min((tree.left[node], tree.right[node]), key=lambda c: totals[c][2])
            wanted.append((node, fewer))
        sums, _ = histograms(rows, newest, tree, [fewer for _, fewer in wanted], width, unit)
        for node, fewer in wanted:
            other = tree.left[node] + tree.right[node] - fewer
            known[fewer], known[other] = sums[fewer], known[node] - sums[fewer]
            del known[node]
            for child in (fewer, other):
                splits[child] = best_split(known[child], s, unit) if totals[child][2] >= 2 * s.min_leaf_rows else None
    return _final(tree, accepted, splits, totals, cuts, s, unit), loss


def _replay(tree: Tree, splits: dict[int, Split | None], leaves: int) -> tuple[list[int], list[int]]:
    """Nodes cut by growth best first, and those of them whose children are not known although they may be cut."""
    heap = [(-splits[0].gain, 0)] if splits[0] else []
    accepted, unknown, held = [], [], 1
    while heap and held < leaves:
        _, node = heapq.heappop(heap)
        accepted.append(node)
        held += 1
        if tree.feature[node] == LEAF:
            if held < leaves:
                unknown.append(node)
            continue
        for child in (tree.left[node], tree.right[node]):
            if splits[child]:
                heapq.heappush(heap, (-splits[child].gain, child))
    return accepted, unknown


def _final(
    tree: Tree, accepted: list[int], splits: dict[int, Split | None], totals: dict[int, tuple], cuts: list[np.ndarray],
    s: ModelSettings, unit: float,
) -> Tree:
    """The tree of the accepted cuts alone, with the values of its leaves."""
    out, place = Tree(), {0: 0}
    totals = dict(totals)
    for node in accepted:
        split, at = splits[node], place[node]
        left, right = out.add(), out.add()
        out.feature[at], out.cut_bin[at], out.missing_left[at] = split.feature, split.cut_bin, split.missing_left
        ends = cuts[split.feature]
        out.cut[at] = float(ends[split.cut_bin]) if split.cut_bin < len(ends) else math.inf
        out.left[at], out.right[at] = left, right
        below = split.left, tuple(t - part for t, part in zip(totals[node], split.left))
        for child, side in zip((left, right), below):
            out.value[child] = -s.boosting_step * side[0] * unit / (side[1] * unit + s.leaf_penalty)
        if tree.feature[node] != LEAF:
            place[tree.left[node]], place[tree.right[node]] = left, right
            totals[tree.left[node]], totals[tree.right[node]] = below
    if not accepted:
        g, h, _ = totals[0]
        out.value[0] = -s.boosting_step * g * unit / (h * unit + s.leaf_penalty)
    return out


def stops(losses: Sequence[float], s: ModelSettings) -> bool:
    """None of the last losses is below the one before them."""
    if len(losses) <= s.stop_rounds:
        return False
    return not any(loss < losses[-s.stop_rounds - 1] - s.stop_gain for loss in losses[-s.stop_rounds:])


def fit(
    store: TableStore, df: DataFrame, features: Sequence[str], label: str, aside: str, s: ModelSettings
) -> BoostedTrees:
    """Trees for a 0/1 label from the rows that are not set ``aside``; those tell when to stop."""
    learn = df.filter(~F.col(aside))
    facts = df.agg(
        F.count_if(~F.col(aside)).alias("n"), F.sum(F.when(~F.col(aside), F.col(label))).alias("positive"),
        F.count_if(F.col(aside)).alias("aside"),
    ).first()
    n, positive = facts["n"], float(facts["positive"] or 0)
    if not 0 < positive < n:  # nothing to tell apart
        share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
        return BoostedTrees(tuple(features), math.log(share / (1 - share)), ())
    base = math.log(positive / (n - positive))
    # Sums over all rows stay below 2^62, sums over a block exact in a double.
    unit = 2.0 ** -min(38, 61 - int(n + facts["aside"]).bit_length())
    cuts = bin_cuts(learn, features, s.bins)
    rows = store.write("binned", _binned(df, features, label, aside, cuts, base))
    trees: list[Tree] = []
    newest: list[Tree] = []
    losses: list[float] = []
    while len(trees) < s.boosting_rounds:
        tree, loss = grow(rows, newest, cuts, s, unit)
        if facts["aside"]:
            losses.append(loss / facts["aside"])
            if stops(losses, s):
                break
        trees.append(tree)
        newest.append(tree)
        if len(newest) == REFRESH:
            rows, newest = store.write("binned", _refreshed(rows, newest, len(features))), []
    return BoostedTrees(tuple(features), base, tuple(trees))
