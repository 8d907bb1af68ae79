"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content; Spark's shuffle files are the spill files.  Each
task runs its bucket through an open-addressing table that compares complete contents and keeps, per
content, a count and the row that stays.  The table has a budget: a bucket whose distinct contents
exceed it is passed on and partitioned again by another hash, until every bucket fits.  The same table
runs before the first shuffle, so a content held by a third of all rows crosses it once per task.

Contents are equal when identical after deleting space and tab to carriage return.  The row with the
most code points in the original text stays, then the one with the smallest id; null ids come last.

Defined results: a null text counts as empty and equals every text of white space only.  Rows that
agree in id and length with the row that stays all count as kept; ``deduplicate`` returns one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import free_names
from holdfast.llm.text import small_batches
from holdfast.plans.store import TableStore

# Fixed value: the characters that do not count, space and tab to carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
TABLE_BYTES = 48 << 20
MAX_LEVELS = 40

_RECORD = "hash bigint, content binary, points bigint, doc_id bigint, rows bigint, copies bigint"
_RESOLVED = f"digest binary, fits boolean, {_RECORD}"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


class OpenAddressingTable:
    """Contents by hash with linear probing; equal hashes are told apart by the whole content."""

    def __init__(self, budget: int):
        self.budget = budget
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple[int, bool, int]] = []  # negative length, id is null, id
        self.rows: list[int] = []
        self.copies: list[int] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def full_for(self, content: bytes) -> bool:
        return bool(self.contents) and self.bytes + len(content) + 200 > self.budget

    def find(self, hashed: int, content: bytes) -> tuple[int, int]:
        """(entry or -1, slot where the search ended)."""
        mask = len(self.slots) - 1
        slot = hashed & mask
        while (entry := int(self.slots[slot])) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def insert(self, slot: int, hashed: int, content: bytes, best: tuple, rows: int, copies: int) -> None:
        self.slots[slot] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.best.append(best)
        self.rows.append(rows)
        self.copies.append(copies)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()

    def merge(self, entry: int, best: tuple, rows: int, copies: int) -> None:
        """``rows`` counts the rows tied for staying, ``copies`` all rows of the content."""
        self.copies[entry] += copies
        if best == self.best[entry]:
            self.rows[entry] += rows
        elif best < self.best[entry]:
            self.best[entry], self.rows[entry] = best, rows

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            slot = hashed & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _records(table: OpenAddressingTable) -> list[list]:
    return [
        table.hashes, table.contents, [-b[0] for b in table.best],
        [None if b[1] else b[2] for b in table.best], table.rows, table.copies,
    ]


def _batches(columns: list[list], schema: pa.Schema, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), rows):
        arrays = [pa.array(c[at:at + rows], f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


_RECORD_ARROW = pa.schema([
    ("hash", pa.int64()), ("content", pa.binary()), ("points", pa.int64()), ("doc_id", pa.int64()),
    ("rows", pa.int64()), ("copies", pa.int64()),
])
_RESOLVED_ARROW = pa.schema([("digest", pa.binary()), ("fits", pa.bool_()), *_RECORD_ARROW])


def _through_table(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[tuple[OpenAddressingTable, bool]]:
    """Runs records through a table; yields it each time it is full and at the end (flag: the end)."""
    table = OpenAddressingTable(budget)
    for batch in small_batches(batches):
        for hashed, content, points, doc_id, rows, copies in zip(*(c.to_pylist() for c in batch.columns)):
            best = (-points, doc_id is None, doc_id or 0)
            entry, slot = table.find(hashed, content)
            if entry >= 0:
                table.merge(entry, best, rows, copies)
                continue
            if table.full_for(content):
                yield table, False
                table.clear()
                _, slot = table.find(hashed, content)
            table.insert(slot, hashed, content, best, rows, copies)
    yield table, True


def collapse(records: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """Merges equal records inside each partition, before they are shuffled."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _through_table(batches, budget):
            yield from _batches(_records(table), _RECORD_ARROW)

    return records.mapInArrow(run, _RECORD)


def resolve(records: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """Resolves each bucket: a digest per content, or the records themselves if the bucket is too large."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = True
        for table, end in _through_table(batches, budget):
            fits = fits and end
            columns = _records(table)
            n = len(table)
            if fits:
                digests = [hashlib.sha256(c).digest() for c in columns[1]]
                columns[1] = [None] * n
            else:
                digests = [None] * n
            yield from _batches([digests, [fits] * n, *columns], _RESOLVED_ARROW)

    return records.mapInArrow(run, _RESOLVED)


def classes(store: TableStore, df: DataFrame, doc_id: str, text: str, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct content: digest, keep_id, keep_points, keep_rows, group_size."""
    content = normalised(F.col(text))
    pending = collapse(df.select(
        F.xxhash64(content).alias("hash"),
        content.cast("binary").alias("content"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("points"),
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.lit(1).cast("bigint").alias("rows"),
        F.lit(1).cast("bigint").alias("copies"),
    ), budget)
    resolved = []
    bucketed = pending.repartition("hash")
    for level in range(1, MAX_LEVELS):
        written = store.write(f"grace_{level}", resolve(bucketed, budget))
        resolved.append(written.filter("fits"))
        pending = written.filter("not fits").select("hash", "content", "points", "doc_id", "rows", "copies")
        rest = pending.agg(F.sum(F.octet_length("content") + 200)).first()[0]
        if not rest:
            break
        # Another hash, and twice as many buckets as the bytes that did not fit would fill.
        bucketed = pending.repartition(2 + 2 * rest // budget, F.xxhash64(F.lit(level), F.col("hash")))
    else:
        raise RuntimeError("buckets do not get smaller: too many different contents share one hash")
    out = resolved[0]
    for more in resolved[1:]:
        out = out.unionByName(more)
    return out.select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"),
        F.col("rows").alias("keep_rows"), F.col("copies").alias("group_size"),
    )


def classify(store: TableStore, df: DataFrame, doc_id: str, text: str, budget: int = TABLE_BYTES) -> DataFrame:
    """Every row with its class: doc_id, text_key, digest, keep_id, group_size, keep_rows, kept."""
    members = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("points"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
    )
    return members.join(classes(store, df, doc_id, text, budget), "digest").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    )


def deduplicate(store: TableStore, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rows = store.write("exact_classes", classify(store, df, doc_id, text))
    id_, key, content = free_names(df, "__id", "__key", "__same")
    keys = [F.col("doc_id").alias(id_), F.col("text_key").alias(key)]
    dropped = rows.filter("not kept").select(*keys)
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key))
    kept = df.join(dropped, same, "left_anti")
    tied = rows.filter("kept and keep_rows > 1").select(*keys)
    if tied.isEmpty():
        return kept
    # Repeated rows: among those tied for staying one is returned.
    tied = tied.distinct()
    repeated = kept.join(tied, same, "left_semi").withColumn(content, F.sha2(normalised(F.col(text)), 256))
    return kept.join(tied, same, "left_anti").unionByName(repeated.dropDuplicates([content]).drop(content))


def op10_exact_dedup(store: TableStore, documents: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    return classify(store, documents, "doc_id", "text", budget).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


# The same rows for a second engine: group by the whole normalised text.
OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), w AS (
  SELECT doc_id, points, sha256(content) AS text_sha256,
         first_value(doc_id) OVER best AS keep_id, first_value(points) OVER best AS keep_points,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM t WINDOW best AS (PARTITION BY content ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND points = keep_points AS kept, text_sha256 FROM w
"""
