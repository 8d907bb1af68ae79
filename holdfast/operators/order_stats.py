"""Exact order statistics of many columns at once.

A double's bits, with the sign turned over, order like a whole number.  The values are found digit by digit
from the top: every pass counts the next digit of the values that begin like one of the cells still wanted,
in all columns together, and the driver keeps the cells that hold a wanted rank.  A pass moves counts only, at most
one per wanted cell and digit, never values, so the work on the driver does not grow with the rows and the result
does not depend on how they are dealt.

Defined results: nulls and NaN are missing and left out; minus zero is zero; a column without values has no cells
and no median.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Cells:
    """Values of a column in order, how often each stands there and how many rows are smaller.

    ``complete`` says that these are all values; else they are those at the wanted ranks.
    """

    values: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    rows: int
    complete: bool

    def at(self, rank: int) -> float:
        return float(self.values[np.searchsorted(self.before, rank, "right") - 1])


def to_ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers that order like the doubles."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_ordered(numbers: np.ndarray) -> np.ndarray:
    numbers = np.asarray(numbers, np.uint64)
    return np.where(numbers & _SIGN, numbers & ~_SIGN, ~numbers).view(np.float64)


def value_cells(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Iterable[int]], keep_all: int = 0, bits: int = 11
) -> dict[str, Cells]:
    """The values at ``ranks(rows)``, counted from zero, of each column; all values where there are few.

    As long as a column has at most ``keep_all`` cells, all of them are followed.
    """
    wanted = {c: np.zeros(1, np.uint64) for c in columns}  # beginnings of the cells that are followed
    before = {c: np.zeros(1, np.int64) for c in columns}
    rows = dict.fromkeys(columns, 0)
    complete = dict.fromkeys(columns, True)
    counts: dict[str, np.ndarray] = {}
    known = 0
    while known < 64:
        step = min(bits, 64 - known)
        found = _digit_counts(df, columns, wanted, known, step)
        for c in columns:
            cell, digit, n = found[c]
            if not known:
                rows[c] = int(n.sum())
            # Rows before a child: those before its parent and before it within the parent.
            running = np.cumsum(n) - n
            first = np.searchsorted(cell, np.arange(len(wanted[c])))
            start = running[np.minimum(first, max(len(n) - 1, 0))] if len(n) else np.zeros(len(wanted[c]), np.int64)
            children = (wanted[c][cell] << np.uint64(step)) | digit.astype(np.uint64)
            ahead = before[c][cell] + running - start[cell]
            complete[c] = complete[c] and len(children) <= keep_all
            if not complete[c] and len(children):
                places = np.unique([r for r in ranks(rows[c]) if 0 <= r < rows[c]]).astype(np.int64)
                holds = np.searchsorted(places, ahead) < np.searchsorted(places, ahead + n)
                children, ahead, n = children[holds], ahead[holds], n[holds]
            wanted[c], before[c], counts[c] = children, ahead, n
        known += step
    return {
        c: Cells(from_ordered(wanted[c]), counts[c], before[c], rows[c], complete[c]) for c in columns
    }


def _digit_counts(
    df: DataFrame, columns: Sequence[str], wanted: dict[str, np.ndarray], known: int, step: int
) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per column the (cell, digit, rows) that occur, in order; one pass over the rows."""
    names, followed = list(columns), [wanted[c] for c in columns]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[int, int]] = [{} for _ in names]
        for batch in batches:
            for i, cells in enumerate(followed):
                values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                numbers = to_ordered(values[~np.isnan(values)])
                cell = np.zeros(len(numbers), np.int64)
                if known:
                    beginning = numbers >> np.uint64(64 - known)
                    cell = np.searchsorted(cells, beginning)
                    held = cell < len(cells)
                    held[held] = cells[cell[held]] == beginning[held]
                    numbers, cell = numbers[held], cell[held]
                digit = (numbers >> np.uint64(64 - known - step)) & np.uint64((1 << step) - 1)
                key, n = np.unique((cell << step) | digit.astype(np.int64), return_counts=True)
                for k, m in zip(key.tolist(), n.tolist()):
                    sums[i][k] = sums[i].get(k, 0) + m
        flat = [(i, k, m) for i, each in enumerate(sums) for k, m in each.items()]
        at, key, n = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["at", "key", "n"]
        )

    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in names))
    merged = doubles.mapInArrow(count, "at int, key bigint, n bigint").groupBy("at", "key").agg(F.sum("n").alias("n"))
    table = merged.toArrow()  # at most a row per followed cell and digit
    at, key, n = (table[c].to_numpy() for c in ("at", "key", "n"))
    out = {}
    for i, c in enumerate(names):
        mine = np.flatnonzero(at == i)
        mine = mine[np.argsort(key[mine])]
        out[c] = (key[mine] >> step, key[mine] & ((1 << step) - 1), n[mine])
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column: the middle value, or the mean of the two in the middle."""
    cells = value_cells(df, columns, lambda n: ((n - 1) // 2, n // 2))
    return {
        c: (v.at((v.rows - 1) // 2) + v.at(v.rows // 2)) / 2 if v.rows else None for c, v in cells.items()
    }
