"""Vectorised word hashing shared by the operators that work on words.

A word is a maximal run of characters outside space and tab to carriage return, with A-Z
lower-cased.  All of those are single bytes in UTF-8, so texts are handled as bytes.  A word's hash is
a polynomial over a random value per byte, taken from running sums, so a whole block of texts is
hashed by a handful of array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; bounds the arrays of a task, a single longer text is cut between words.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTE_VALUE = np.random.default_rng(20_24).integers(1, 1 << 63, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 2)
            cls.up, cls.down = (cls._of(base, size) for base in (_BASE, pow(_BASE, -1, 1 << 64)))

    @staticmethod
    def _of(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit value; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a block."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch ``start`` to ``end`` of a byte array, wherever it stands."""
    _Powers.to(len(values) + 1)
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[values] * _Powers.up[: len(values)], out=running[1:])
    return mix((running[end] - running[start]) * _Powers.down[start])


def lower_case_words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block, A-Z lower-cased, and its first byte."""
    raw = np.frombuffer(block, np.uint8)
    start, end = word_edges(raw)
    return run_hashes(_LOWER[raw], start, end), start


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of about a block, cut at white space, so no word is divided."""
    at = 0
    while at < len(text):
        to = at + BLOCK_BYTES
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield text[at:to]
        at = to


def blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Groups consecutive texts into blocks: (first, past the last, joined bytes, start of each text)."""
    first, parts, size, at = 0, [], 0, 0
    for at, text in enumerate(texts, start=1):
        text = text or b""
        if parts and size + len(text) > BLOCK_BYTES:
            yield first, at - 1, b" ".join(parts), _starts(parts)
            first, parts, size = at - 1, [], 0
        parts.append(text)
        size += len(text) + 1
    if parts:
        yield first, at, b" ".join(parts), _starts(parts)


def _starts(parts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return np.concatenate(([0], np.cumsum(sizes)[:-1]))


def hashed_words(
    texts: Iterable[bytes | None], hash_block: Callable = lower_case_words
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of texts: (first, past the last, word hashes, words before each text)."""
    for first, last, joined, starts in blocks(texts):
        if len(joined) > 2 * BLOCK_BYTES:  # one very long text
            pieces = [hash_block(piece)[0] for piece in _cut(joined)]
            yield first, last, np.concatenate(pieces, axis=-1), np.array([0])
        else:
            hashes, begin = hash_block(joined)
            yield first, last, hashes, np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and the text of each.

    A text with fewer words gives its whole sequence as one run; one without words gives none.
    """
    counts = np.diff(np.append(before, len(hashes)))
    runs = np.maximum(counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(owner)) + np.repeat(before - (np.cumsum(runs) - runs), runs)
    value = np.zeros(len(owner), np.uint64)
    left = counts[owner] - (at - before[owner])
    for step in range(width):
        there = left > step
        word = np.where(there, hashes[np.minimum(at + step, max(len(hashes) - 1, 0))] if len(hashes) else 0, 0)
        value = value * np.uint64(_BASE) + word.astype(np.uint64)
    return mix(value), owner


def binary_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def small_batches(
    batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches to at most ``rows`` rows and about ``size`` bytes, so that what is built per batch
    stays small; a longer row stands alone."""
    for batch in batches:
        ends = np.cumsum(_row_bytes(batch))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, "right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and lists of every row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            total += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return total
