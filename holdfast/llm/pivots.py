"""Exact top-k inner products by pivot-table elimination.

Inner products follow from distances: <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2.  Every vector's distances to
a fixed number of pivots are computed beforehand, and by the triangle inequality the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), so an upper bound of the score.  Candidates
are evaluated in the order of their bounds, until the next bound is below the k-th best score so far.

Vectors are dealt to slices of bounded size, queries to blocks.  One task holds one block and one slice and
gives at most k rows per query; the best k of all slices are then picked per query.  A first pass over one
slice gives each query a k-th score to start from, so that later slices can be left sooner.

Components are floor(256 * x), and all scores are exact.  For vectors of a squared length below ``NEAR`` = 2^51
squared distances are whole numbers that float64 holds, and the roots' rounding is covered by a margin.  Pairs with
a longer vector have no bound: all of them are evaluated, in 64-bit integers.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query or
candidate, nor do vectors without id; an empty vector scores 0; missing components of a shorter vector count as 0.
A table with a squared length of 2^62 or more (of components, 2^31 after scaling) is refused, as a score is a bigint.
Ties go to the smaller id.  Rows that repeat an id are candidates of their own, but never of a query with their id.
Queries that repeat an id are all searched, and the best ``k`` of their pairs together are given, so a candidate
that is near several of them can stand there several times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.store import TableStore

PIVOTS = 24
PIVOT_SAMPLE = 2048
SLICE_ROWS = 8192
BLOCK_ROWS = 2048
STEP = 256
NEAR = float(1 << 51)
LONGEST = float(1 << 62)
_FAR = -(1 << 62)


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and the whole-number components of every vector that takes part."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))
    usable = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("v")
    )


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def choose_pivots(vectors: DataFrame, width: int, count: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors among a bounded sample by hash; pivots change the speed, never the result."""
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    points = matrix(sample["v"], width)
    points = points[(points**2).sum(1) < NEAR]
    if not len(points):
        return np.zeros((0, width))
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def products(points: np.ndarray, query: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whole-number inner products, those of ``far`` pairs in 64-bit integers, as float64 would round them."""
    if not far.any():
        return (points @ query).astype(np.int64)
    out = np.empty(len(points), np.int64)
    out[~far] = points[~far] @ query
    out[far] = points[far].astype(np.int64) @ query.astype(np.int64)
    return out


def best_of_slice(
    q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, points: np.ndarray,
    pivots: np.ndarray, k: int,
) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Per query the positions and scores of its best ``k`` in the slice, and how many were evaluated.

    Candidates below ``floor``, a score that k others are known to reach, may be left out.
    """
    q_table, table = distances(queries, pivots), distances(points, pivots)
    q_norm, norm = (queries**2).sum(1), (points**2).sum(1)
    far_points = norm >= NEAR
    found, scores, evaluated = [], [], 0
    for i in range(len(queries)):
        gap = np.zeros(len(points))
        for p in range(table.shape[1]):
            np.maximum(gap, np.abs(table[:, p] - q_table[i, p]), out=gap)
        bound = (q_norm[i] + norm - np.maximum(gap - 1e-6 * (1 + gap), 0) ** 2) / 2
        far = far_points | (q_norm[i] >= NEAR)
        bound[far] = np.inf
        open_ = np.flatnonzero((bound >= floor[i]) & (ids != q_ids[i]))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(open_), STEP):
            if len(score) >= k and bound[open_[at]] < score[k - 1]:
                break
            step = open_[at:at + STEP]
            best = np.concatenate((best, step))
            score = np.concatenate((score, products(points[step], queries[i], far[step])))
            evaluated += len(step)
            order = np.lexsort((ids[best], -score))[:k]
            best, score = best[order], score[order]
        found.append(best)
        scores.append(score)
    return found, scores, evaluated


def search(store: TableStore, vectors: DataFrame, is_query, k: int) -> DataFrame:
    """The ``k`` best other vectors of every query: query_id, rank, vec_id, score."""
    vectors = store.write("vectors", vectors)
    facts = vectors.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(is_query).alias("queries"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest"),
    ).first()
    if (facts["longest"] or 0) >= LONGEST:
        raise ValueError("scores of a vector with a squared length of 2^62 or more don't fit a bigint")
    width = max(facts["width"] or 0, 1)
    slices, blocks = -(-facts["n"] // SLICE_ROWS) or 1, -(-facts["queries"] // BLOCK_ROWS) or 1
    pivots = choose_pivots(vectors, width)

    sliced = vectors.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(slices)).cast("int"))
    # Query rows alike are searched once; more than k of them change nothing.  The block looks at the vector too, so
    # one id on many rows fills no block.
    queries = store.write("queries", vectors.filter(is_query).groupBy(F.col("vec_id").alias("q_id"), F.col("v").alias("q")).agg(
        F.least(F.count("*"), F.lit(k)).alias("times")
    ).withColumn("q_block", F.pmod(F.xxhash64("q_id", "q", F.lit(17)), F.lit(blocks)).cast("int")))

    def run(_: tuple, asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        ids, q_ids = given["vec_id"].to_numpy(), asked["q_id"].to_numpy()
        if not len(ids) or not len(q_ids):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found, scores, _ = best_of_slice(
            q_ids, matrix(asked["q"], width), asked["floor"].to_numpy(), ids, matrix(given["v"], width), pivots, k
        )
        times = np.repeat(asked["times"].to_numpy(), [len(f) for f in found])
        return pd.DataFrame({
            "query_id": np.repeat(np.repeat(q_ids, [len(f) for f in found]), times),
            "vec_id": np.repeat(ids[np.concatenate(found)], times), "score": np.repeat(np.concatenate(scores), times),
        })

    def over(parts: DataFrame, asked: DataFrame, slice_ids) -> DataFrame:
        # Each slice meets each block once: their rows are copied to the tasks (slice, block), which bounds a task.
        given = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        wanted = asked.withColumn("q_slice", F.explode(slice_ids))
        return wanted.groupBy("q_slice", "q_block").cogroup(given.groupBy("slice", "block")).applyInPandas(
            run, "query_id bigint, vec_id bigint, score bigint"
        )

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    seeds = over(sliced.filter("slice = 0"), queries.withColumn("floor", F.lit(float(_FAR))), F.array(F.lit(0)))
    floors = seeds.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k)
    floors = store.write("floors", floors.select("query_id", F.col("score").cast("double").alias("floor")))
    asked = queries.join(floors, F.col("q_id") == F.col("query_id"), "left").select(
        "q_id", "q", "q_block", "times", F.coalesce("floor", F.lit(float(_FAR))).alias("floor")
    )
    every = over(sliced, asked, F.sequence(F.lit(0), F.lit(slices - 1)))
    return every.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )


def op9_pivot_top_k(store: TableStore, embeddings: DataFrame, k: int = 5) -> DataFrame:
    return search(store, whole_vectors(embeddings, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
