"""Global ranks, running totals and quantile buckets without a single-task window.

``number_rows`` range-partitions the rows on (order columns, id), so a value shared by a third
of all rows is still split across tasks by id.  Inside each sorted partition the JVM-side
``monotonically_increasing_id`` already is (partition, position).  The frame is written once to
freeze that layout; per-partition counts and sums (one row per partition) give the offsets.

Buckets need only the rows that stand on a bucket edge: a handful of rows is looked up by rank
and turned into literal comparisons, so the wide table is bucketed in place, without a join.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from holdfast.functions.columns import first_match
from holdfast.functions.literals import literal_rows
from holdfast.plans.store import TableStore

ROW_NO = "row_no"
_POSITION_BITS = 33
EXACT = "decimal(28,6)"


@dataclass(frozen=True)
class Key:
    """One order column without nulls; every order is completed by the id, ascending unless stated."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_first()


@dataclass(frozen=True)
class NumberedRows:
    """``frame`` carries the rank; ``frozen`` is the written layout, ``starts`` the rank before the
    first row of each range partition."""

    frame: DataFrame
    frozen: DataFrame
    order: tuple[Key, ...]
    rows: int
    totals: dict[str, float]
    starts: tuple[tuple[int, int], ...]

    def rows_at(self, ranks: Sequence[int]) -> dict[int, Row]:
        """The few rows standing at the given ranks (bounded by ``len(ranks)``).

        A rank is first turned into (partition, position), which the file reader can prune on.
        """
        firsts = [before for _, before in self.starts]
        places = {}
        for rank in {r for r in ranks if 1 <= r <= self.rows}:
            part, before = self.starts[bisect.bisect_left(firsts, rank) - 1]
            places[part, rank - before] = rank
        if not places:
            return {}
        wanted = [(F.col("_part") == part) & (F.col("_pos") == pos) for part, pos in places]
        names = [k.name for k in self.order]
        found = self.frozen.filter(reduce(or_, wanted)).select("_part", "_pos", *names).collect()
        return {places[row["_part"], row["_pos"]]: row for row in found}

    def bucket(self, upper_ranks: Sequence[int]) -> Column:
        """1-based bucket of a row: the first bucket whose last row does not precede it.

        Rows after the last edge get ``len(upper_ranks) + 1``; empty buckets are skipped.
        """
        edges = self.rows_at(upper_ranks)
        rules = [
            (_not_after(self.order, edges[rank]), number)
            for number, rank in enumerate(upper_ranks, start=1)
            if rank in edges
        ]
        rest = len(upper_ranks) + 1
        return first_match(rules, rest) if rules else F.lit(rest)


def _not_after(order: Sequence[Key], edge: Row) -> Column:
    """Row order comparison with a literal row: true when this row is at or before the edge."""
    out = F.lit(True)
    for key in reversed(order):
        column, bound = F.col(key.name), F.lit(edge[key.name])
        before = column > bound if key.descending else column < bound
        out = before | ((column == bound) & out)
    return out


def number_rows(store: TableStore, name: str, df: DataFrame, order: Sequence[Key],
                running: dict[str, str] | None = None) -> NumberedRows:
    """Number rows 1..n in a total order (``order`` must end in a unique key).

    ``running`` maps new column -> summed column: running totals in the same order.  They are added as
    decimals of six places, so they do not depend on the order in which tasks add them.
    """
    running = running or {}
    sort = [k.sort() for k in order]
    tagged = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_tag", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_tag", _POSITION_BITS))
        .withColumn("_pos", F.col("_tag").bitwiseAND((1 << _POSITION_BITS) - 1) + 1)
        .drop("_tag")
    )
    frozen = store.write(f"numbered_{name}", tagged)

    sums = [F.sum(F.col(c).cast(EXACT)).alias(f"_sum_{out}") for out, c in running.items()]
    parts = sorted(frozen.groupBy("_part").agg(F.count("*").alias("_n"), *sums).collect())

    before, rows, totals = [], 0, dict.fromkeys(running, Decimal(0))
    for part in parts:
        before.append((part["_part"], rows, *map(str, totals.values())))
        rows += part["_n"]
        for out in running:
            totals[out] += part[f"_sum_{out}"] or Decimal(0)
    fields = ["_part bigint", "_before bigint", *(f"_before_{out} string" for out in running)]
    offsets = literal_rows(store.spark, before, ", ".join(fields))

    # One offset row per range partition, so its size is bounded by the partition count.
    frame = frozen.join(F.broadcast(offsets), "_part").withColumn(
        ROW_NO, F.col("_before") + F.col("_pos")
    )
    if running:
        w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        frame = frame.withColumns({
            out: (F.col(f"_before_{out}").cast(EXACT) + F.sum(F.col(c).cast(EXACT)).over(w)).cast("double")
            for out, c in running.items()
        })
    frame = frame.select(*df.columns, ROW_NO, *running)
    starts = tuple((part, start) for part, start, *_ in before)
    whole = {out: float(total) for out, total in totals.items()}
    return NumberedRows(frame, frozen, tuple(order), rows, whole, starts)


def ntile_edges(rows: int, buckets: int) -> list[int]:
    """Last rank of each NTILE bucket except the final one."""
    size, extra = divmod(rows, buckets)
    edges, last = [], 0
    for b in range(buckets - 1):
        last += size + (1 if b < extra else 0)
        edges.append(last)
    return edges


def quantile_edges(rows: int, buckets: int) -> list[int]:
    """Last rank of each equal-quantile bucket of the ranks 1..n, except the final one.

    Edges are interpolated in floating point like a linear quantile, so a bucket edge that is a
    whole number in theory may fall just below it, as it does for the usual quantile cut.
    """
    edges = []
    for b in range(1, buckets):
        spot = (rows - 1) * (b * (1 / buckets) * 100 / 100)
        whole = math.floor(spot)
        part = spot - whole
        edge = (whole + 1) + part if part < 0.5 else (whole + 2) - (1 - part)
        edges.append(math.floor(edge))
    return edges


def share_edges(rows: int, permilles: Sequence[int], up: bool) -> list[int]:
    """Rank limits of top shares, in exact integer arithmetic, at least one row each."""
    limits = [(-(-rows * p // 1000) if up else rows * p // 1000) for p in permilles]
    return limits if up else [max(1, limit) for limit in limits]


def rank_bucket(upper_ranks: Sequence[int], rank: str = ROW_NO) -> Column:
    """Bucket of a row that already carries its rank."""
    rules = [(F.col(rank) <= edge, number) for number, edge in enumerate(upper_ranks, start=1)]
    return first_match(rules, len(upper_ranks) + 1)


def running_bands(df: DataFrame, band: Column, dims: Sequence[tuple], dim_schema: str,
                  sums: dict[str, Column], lows: dict[str, Column] | None = None) -> DataFrame:
    """Nested targets ("top 1 %, top 5 %, ...") in one pass.

    Each row is aggregated once, in the narrowest band that holds it; the few bands are then
    accumulated.  ``dims`` has one tuple per band, so a band without rows still shows up.
    ``all_<name>`` is the total over every row, inside or outside the bands.
    """
    lows = lows or {}
    cells = df.withColumn("_band", band).groupBy("_band").agg(
        *(c.cast("double").alias(name) for name, c in sums.items()),
        *(c.alias(name) for name, c in lows.items()),
    )
    rows = [(i, *dim) for i, dim in enumerate(dims, start=1)]
    rows.append((len(dims) + 1, *(None for _ in dims[0])))
    frame = literal_rows(df.sparkSession, rows, f"_band int, {dim_schema}")
    names = [c for c in frame.columns if c != "_band"]
    # A row per band: the windows below run over that many rows.
    bands = frame.join(cells, "_band", "left").fillna(0.0, list(sums))
    everything = Window.partitionBy(F.lit(1))
    running = everything.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    return bands.select(
        "_band",
        *names,
        *(F.sum(c).over(running).alias(c) for c in sums),
        *(F.min(c).over(running).alias(c) for c in lows),
        *(F.sum(c).over(everything).alias(f"all_{c}") for c in sums),
    ).filter(F.col("_band") <= len(dims))
