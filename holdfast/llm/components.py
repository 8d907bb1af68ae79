"""Connected components of a link table by alternating large and small stars.

First every task labels the links of its own partition, of at most about ``PART_LINKS``, which leaves stars.  Then
every round links the neighbours above a node to the smallest node near it, then the neighbours below
it, until each node points straight at the smallest node of its component.  Only minima are
aggregated and rows are joined to them one by one, so a node with very many links fills no task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.plans.store import TableStore

ROUNDS = 60
#: Links that a task labels by itself (16 bytes each); a table of so few is settled by that.
PART_LINKS = 1_000_000


def components(store: TableStore, links: DataFrame) -> DataFrame:
    """``links`` (a, b) of bigint; returns (node, component), the smallest node, for nodes with links.

    Links of a node to itself and nulls say nothing and are left out; without links no row results.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = store.write("edges", edges)
    parts = -(-edges.count() // PART_LINKS) or 1
    edges = store.write("part_stars", edges.coalesce(parts).mapInArrow(_part_stars, "u bigint, v bigint").distinct())
    for _ in range(ROUNDS):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store.write("stars", small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def _settled(edges: DataFrame) -> bool:
    """Each node has one link down, and no link's lower end goes further down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low"))
    )
    moves = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return moves.filter("up > 1 or (up = 1 and low = 1)").isEmpty()


def _part_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node to the smallest node that the links of this partition join it with."""
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not table:
        return
    upper, lower = (np.concatenate(side) for side in zip(*table))
    nodes, place = np.unique(np.concatenate((upper, lower)), return_inverse=True)
    upper, lower = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[upper], label[lower])
        new = label.copy()
        for side in (upper, lower, label[upper], label[lower]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[label[inner]])], ["u", "v"])
