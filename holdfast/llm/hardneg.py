"""Hard negatives by rotated one-bit codes with a deterministic filter.

Every vector is turned by a fixed random rotation and stored with one bit per dimension, the signs.  Beside the
code stands its *alignment*, the exact inner product of the turned vector with the unit vector of its code, and the
length of the *rest* that the code leaves over.  An anchor is turned likewise and cut into ``PLANES`` bit
planes, so its product with a code is a sum of popcounts, and

    <anchor, vector> = alignment * <anchor, code> + <anchor, rest>

where by Cauchy-Schwarz the last part is at most |rest| times the length of the anchor outside the code's direction.
That is an interval that always holds the score, whatever the data; a margin covers the rounding of the planes and
of the rotation.  A vector is scored in whole numbers only if its interval reaches what still counts, best
upper ends first.

Two passes: positives of an anchor come from the rows of its label, negatives from all others, within the
windows that the positives set.  Rows are dealt to slices of bounded size (by label in the first pass), anchors to
blocks; a task holds one slice and one block and gives at most ``k`` rows per anchor and window.  A first slice gives
every window a score that must be beaten, so that later slices are left sooner.

Components are floor(256 * x), and all scores are exact: in float64 as long as the product of the lengths is below
2^53, beyond that in 64-bit integers.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do
rows whose squared length after scaling reaches 2^62, whose scores may not fit a bigint; missing components of a
shorter vector count as 0; an empty vector scores 0.  Ties go to the smaller id.  Rows that share an anchor's id
are not its partners; rows alike in id, label and vector are one anchor, other rows of one id are anchors of their
own; as partners all rows count.  Windows of positives without any negative, and anchors without positives, give no
row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.text import small_batches
from holdfast.plans.store import TableStore

PLANES = 8
SLICE_ROWS = 8192
BLOCK_ROWS = 1024
STEP = 512
K = 5
LONGEST = float(1 << 62)
EXACT = float(1 << 53)
_LOW = -(1 << 62)
_MARGIN = 1e-9

CODED = "vec_id bigint, label bigint, v binary, code binary, align double, rest double, long double"


def whole_vectors(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label and whole-number components of every row that takes part."""
    x = F.col(vector)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    length = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.floor(c.cast("double") * 256).cast("double") ** 2)
    usable = usable & F.forall(x, lambda c: F.abs(c.cast("double")) < float(1 << 24)) & (length < LONGEST)
    return df.filter(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), scaled.alias("v")
    )


@cache
def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(4_669).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def turned(points: np.ndarray) -> np.ndarray:
    return points @ rotation(points.shape[1])


def one_bit(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, alignment, length of the rest, and length of every vector."""
    y = turned(points)
    bits = y > 0
    align = np.abs(y).sum(1) / np.sqrt(points.shape[1])
    long = np.sqrt((y**2).sum(1))
    return words_of(bits), align, np.sqrt(np.maximum(long**2 - align**2, 0)), long


def words_of(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def coded(store: TableStore, vectors: DataFrame, width: int) -> DataFrame:
    """The vectors with their codes, written once: components as small integers, one bit a dimension."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=4096):
            points = np.zeros((batch.num_rows, width))
            for i, v in enumerate(batch.column(2).to_pylist()):
                points[i, : len(v)] = v
            code, align, rest, long = one_bit(points)
            # Only as wide as the components need; the row's own length tells the width when it is read.
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(points).max(initial=0) < 2.0 ** (8 * int(k[-1]) - 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([p.tobytes() for p in points.astype(kind)], pa.binary()),
                pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align), pa.array(rest), pa.array(long),
            ], ["vec_id", "label", "v", "code", "align", "rest", "long"])

    return store.write("coded_vectors", vectors.mapInArrow(run, CODED))


def points_of(packed: Iterable[bytes], width: int) -> np.ndarray:
    """Whole-number components from rows of 2, 4 or 8 bytes a component."""
    packed = list(packed)
    out = np.empty((len(packed), width))
    sizes = np.array([len(p) for p in packed])
    for size in set(sizes.tolist()):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([packed[i] for i in at]), f"<i{size // width}")
        out[at] = raw.reshape(len(at), width)
    return out


class Slice:
    """Vectors of one task: codes for the intervals, components for the scores."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.points = points_of(table["v"].to_pylist(), width)
        self.code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(len(self.ids), -1)
        self.align, self.rest, self.long = (table[c].to_numpy() for c in ("align", "rest", "long"))
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        self.scored = 0

    def intervals(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all scores: estimates from popcounts, and how far the truth can be away."""
        width = len(anchor)
        y = turned(anchor[None, :])[0]
        low, high = y.min(), y.max()
        unit = (high - low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((y - low) / unit).astype(np.int64)
        inside = np.zeros(len(self.ids), np.int64)
        for plane in range(PLANES):
            mask = words_of((steps >> plane & 1).astype(bool)[None, :])
            inside += np.bitwise_count(self.code & mask).sum(1, dtype=np.int64) << plane
        held = low + unit * steps  # the anchor as its planes have it
        along = (2 * (low * self.ones + unit * inside) - held.sum()) / np.sqrt(width)
        length = float(np.sqrt((y**2).sum()))
        off = float(np.sqrt(((y - held) ** 2).sum()))  # what the planes leave out, at most this along any code
        outside = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        reach = self.align * off + self.rest * outside + _MARGIN * length * self.long + 1e-6
        middle = self.align * along
        return middle - reach, middle + reach

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact whole-number inner products of some rows."""
        self.scored += len(at)
        length = float(np.sqrt((anchor**2).sum()))
        near = self.long[at] * length < EXACT
        if near.all():
            return (self.points[at] @ anchor).astype(np.int64)
        out = np.empty(len(at), np.int64)
        out[near] = (self.points[at[near]] @ anchor).astype(np.int64)
        out[~near] = self.points[at[~near]].astype(np.int64) @ anchor.astype(np.int64)
        return out

    def best(
        self, anchor: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the rows of its best ``k`` and their scores.

        A window's ``low`` rises to the ``k``-th score found in it, so rows are taken by falling upper bound until
        none can reach any window.
        """
        lower, upper = self.intervals(anchor)
        bar = low.astype(np.float64)  # what an upper bound must reach; bounds have a margin, so rounding does no harm
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in high]
        open_ = np.flatnonzero(allowed & (upper >= bar.min()) & (lower <= high.max()))
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        for start in range(0, len(open_), STEP):
            step = open_[start:start + STEP]
            step = step[upper[step] >= bar.min()]
            if not len(step):
                break
            score = self.scores(anchor, step)
            for w, (rows, values) in enumerate(found):
                fits = (score >= low[w]) & (score <= high[w])
                if not fits.any():
                    continue
                rows, values = np.concatenate((rows, step[fits])), np.concatenate((values, score[fits]))
                order = np.lexsort((self.ids[rows], -values))[:k]
                found[w] = rows[order], values[order]
                if len(order) == k:
                    last = float(values[order][-1])
                    bar[w] = max(bar[w], last - 1e-12 * abs(last))
        return found


def _parts(n: int, size: int) -> int:
    return -(-n // size) or 1


def _deal(*by: str, salt: int, parts: int | Column) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _ranked(found: DataFrame, keys: list[str], partner: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), partner)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def positives(store: TableStore, rows: DataFrame, anchors: DataFrame, width: int, k: int = K) -> DataFrame:
    """The ``k`` best other rows of each anchor's label: anchor, positive_id, positive_score."""
    size = rows.groupBy("label").agg(F.count("*").alias("n"))
    asked = anchors.groupBy("label").agg(F.count("*").alias("asked"))
    plan = size.join(asked, "label").select(
        "label", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"),
        F.ceil(F.col("asked") / BLOCK_ROWS).cast("int").alias("blocks"),
    )
    plan = store.write("label_plan", plan)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    given = rows.join(plan, "label").withColumn("slice", _deal("vec_id", "v", salt=41, parts=F.col("slices")))
    given = given.withColumn("block", every("blocks")).drop("slices", "blocks")
    wanted = anchors.join(plan, "label").withColumn("a_block", _deal("anchor", salt=43, parts=F.col("blocks"))).select(
        "anchor", F.col("anchor_id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), "a_block",
        every("slices").alias("a_slice"),
    )

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and given.num_rows:
            slice_ = Slice(given, width)
            points = points_of(asked["a_v"].to_pylist(), width)
            for name, own, anchor in zip(asked["anchor"].to_pylist(), asked["a_id"].to_pylist(), points):
                ((found, score),) = slice_.best(
                    anchor, slice_.ids != own, np.array([_LOW]), np.array([-_LOW]), k
                )
                out += zip([name] * len(found), slice_.ids[found].tolist(), score.tolist())
        return _table(out, ("anchor", "positive_id", "positive_score"))

    found = wanted.groupBy("a_label", "a_slice", "a_block").cogroup(given.groupBy("label", "slice", "block")).applyInArrow(
        run, "anchor bigint, positive_id bigint, positive_score bigint"
    )
    return _ranked(found, ["anchor"], "positive_id", "positive_score", k)


def negatives(
    store: TableStore, rows: DataFrame, anchors: DataFrame, chosen: DataFrame, width: int, n: int, k: int = K
) -> DataFrame:
    """For each anchor and window the ``k`` best rows of other labels within it: anchor, high, negative_id, score.

    Positives of one score share a window, from 80 % of it to itself.
    """
    four_fifths = F.call_function("div", F.col("positive_score").cast("decimal(20,0)") * 4 + 4, F.lit(5).cast("decimal(2,0)"))
    windows = chosen.filter("positive_score >= 0").select(
        "anchor", F.col("positive_score").alias("high"), four_fifths.alias("low")
    ).distinct()
    windows = store.write("windows", windows)
    slices = _parts(n, SLICE_ROWS)
    wanted = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("windows"))
    wanted = anchors.join(wanted, "anchor")  # at most k windows an anchor
    blocks = _parts(wanted.count(), BLOCK_ROWS)
    wanted = store.write("asked", wanted.withColumn("a_block", _deal("anchor", salt=43, parts=blocks)))
    sliced = rows.withColumn("slice", _deal("vec_id", "v", salt=47, parts=slices))

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and given.num_rows:
            slice_ = Slice(given, width)
            points = points_of(asked["a_v"].to_pylist(), width)
            columns = (asked[c].to_pylist() for c in ("anchor", "a_id", "a_label", "a_windows"))
            for name, own, label, bounds, anchor in zip(*columns, points):
                low, high = (np.array([b[c] for b in bounds], np.int64) for c in ("low", "high"))
                allowed = (slice_.ids != own) & (slice_.labels != label)
                for top, (found, score) in zip(high.tolist(), slice_.best(anchor, allowed, low, high, k)):
                    out += zip([name] * len(found), [top] * len(found), slice_.ids[found].tolist(), score.tolist())
        return _table(out, ("anchor", "high", "negative_id", "score"))

    def over(asked: DataFrame, given: DataFrame, slice_ids: Column) -> DataFrame:
        # Each slice meets each block once: their rows are copied to the tasks (slice, block), which bounds a task.
        left = asked.select(
            "anchor", F.col("anchor_id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"),
            F.col("windows").alias("a_windows"), "a_block", F.explode(slice_ids).alias("a_slice"),
        )
        right = given.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("a_slice", "a_block").cogroup(right.groupBy("slice", "block")).applyInArrow(
            run, "anchor bigint, high bigint, negative_id bigint, score bigint"
        )

    keys = ["anchor", "high"]
    if slices > 1:
        # One slice first: a window's k-th score there is what later rows must reach.
        seen = _ranked(over(wanted, sliced.filter("slice = 0"), F.array(F.lit(0))), keys, "negative_id", "score", k)
        floors = seen.filter(F.col("rank") == k).select("anchor", "high", F.col("score").alias("floor"))
        raised = windows.join(floors, keys, "left").select("anchor", "high", F.coalesce("floor", "low").alias("low"))
        raised = raised.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("windows"))
        wanted = store.write("asked", wanted.drop("windows").join(raised, "anchor"))
    found = over(wanted, sliced, F.sequence(F.lit(0), F.lit(slices - 1)))
    return _ranked(found, keys, "negative_id", "score", k)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns)})


def mine(store: TableStore, vectors: DataFrame, is_anchor: Column, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, v) rows."""
    vectors = store.write("whole_vectors", vectors)
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(facts["width"] or 0, 1)
    rows = coded(store, vectors, width)
    anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct()
    anchors = store.write("anchors", anchors.withColumn("anchor", F.monotonically_increasing_id()))
    chosen = store.write("positives", positives(store, rows, anchors, width, k))
    found = store.write("negatives", negatives(store, rows, anchors, chosen, width, facts["n"], k))
    names = anchors.select(F.col("anchor").alias("name"), "anchor_id")
    return (
        chosen.drop("rank").join(found, (chosen["anchor"] == found["anchor"]) & (F.col("positive_score") == F.col("high")))
        .drop(found["anchor"]).join(names, F.col("anchor") == F.col("name"))
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
    )


def op13_one_bit_negatives(store: TableStore, embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(store, whole_vectors(embeddings, "vec_id", "embedding", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), a AS (
  SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)
), s AS (
  SELECT a.anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM a JOIN v c ON a.vec_id <> c.vec_id
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
