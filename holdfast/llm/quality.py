"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features are runs of one and two words, as written and as shapes (capitals, small letters, digits and
further characters by class), hashed into a fixed number of weights.  A feature's value is its share
of the text's runs of that kind, so long and short texts compare.  Two equal neighbours count as one
special run, whatever the word.

Training updates follow the regularised leader per coordinate.  The labelled rows, about ``MAX_ROWS`` at
most by hash and one of those alike in id and text, are dealt to shards of about ``SHARD_ROWS``; each shard
learns by itself in one task and the weights are averaged.  Scoring is one pass over the documents with the weights, whose number is fixed.

Only the text is looked at.  Defined results: a null or empty text gets the score of the intercept; rows
without id are never held out nor trained on; several labels of one id count by their mean; without any
label nothing speaks against a document, and every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.text import binary_texts, hashed_words, mix, run_hashes, shingles, small_batches, word_edges

WEIGHT_BITS = 18
MAX_ROWS = 16_000
SHARD_ROWS = 2_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 0.05, 1e-4, 1e-4
SCALE = 4.0
THRESHOLD = 0.7
SCORE = "__score"

_REPEAT = np.uint64(0x5EED5EED5EED5EED)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")


def _words_and_shapes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes a word: as written, and of its shape with runs of one class counted once."""
    raw = np.frombuffer(block, np.uint8)
    start, end = word_edges(raw)
    shape = _SHAPE[raw]
    new = np.ones(len(raw), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[start] = True
    place = np.concatenate(([0], np.cumsum(new)))
    return np.stack([run_hashes(raw, start, end), run_hashes(shape[new], place[start], place[end])]), start


def _runs(hashes: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weight index and text of every run, kind by kind."""
    for kind, words in enumerate(hashes):
        for width in (1, 2):
            value, owner = shingles(words, before, width)
            if width == 2 and kind == 0 and len(words) > 1:
                first = _first_word(before, len(words), owner)
                same = words[first] == words[np.minimum(first + 1, len(words) - 1)]
                value = np.where(same & (first + 1 < len(words)), _REPEAT, value)
            yield (mix(value + np.uint64(2 * kind + width)) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64), owner


def _first_word(before: np.ndarray, words: int, owner: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(before, words))
    runs = np.maximum(counts - 1, np.minimum(counts, 1))
    return np.arange(len(owner)) + np.repeat(before - (np.cumsum(runs) - runs), runs)


def linear_scores(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """Intercept plus the sparse dot product of every text."""
    out = np.full(len(texts), weights[-1], np.float64)
    for first, last, hashes, before in hashed_words(texts, _words_and_shapes):
        if not hashes.shape[-1]:
            continue
        n = last - first
        for index, owner in _runs(hashes, before):
            count = np.bincount(owner, minlength=n)
            total = np.bincount(owner, weights[index], minlength=n)
            out[first:last] += SCALE * total / np.maximum(count, 1)
    return out


def sparse_rows(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight index, value) of every text, the intercept last."""
    rows = []
    for text in texts:
        index, value = [np.array([1 << WEIGHT_BITS])], [np.ones(1)]
        for _, _, hashes, before in hashed_words([text], _words_and_shapes):
            if not hashes.shape[-1]:
                continue
            for at, _ in _runs(hashes, before):
                ids, counts = np.unique(at, return_counts=True)
                index.append(ids)
                value.append(SCALE * counts / len(at))
        ids, where = np.unique(np.concatenate(index), return_inverse=True)
        rows.append((ids, np.bincount(where, np.concatenate(value))))
    return rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of per-coordinate regularised updates in seeded order."""
    size = (1 << WEIGHT_BITS) + 1
    z, squares = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weight(at):
        kept = np.abs(z[at]) > l1[at]
        rate = (BETA + np.sqrt(squares[at])) / ALPHA + L2
        return np.where(kept, -(z[at] - np.sign(z[at]) * l1[at]) / rate, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weight(at)
            gradient = (sigmoid(w @ x) - labels[i]) * x
            more = squares[at] + gradient**2
            z[at] += gradient - (np.sqrt(more) - np.sqrt(squares[at])) / ALPHA * w
            squares[at] = more
    return weight(np.arange(size))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame | None:
    """The sample (__id, __text, __label, __shard), or None if nothing is labelled; held-out ids are not used.

    Ids are sampled first, which bounds the broadcast side; an id may stand on any number of texts, so the joined
    rows are counted and sampled too.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    ids = known.count()
    if not ids:
        return None

    def share(n: int, *by) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int((1 << 30) * min(1, MAX_ROWS / n))

    known = known.filter(share(ids, "__id", F.lit(3)))
    sample = documents.select(
        F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__key")
    ).join(F.broadcast(known), "__id")  # about MAX_ROWS rows of two numbers
    rows = sample.select("__id", "__key").distinct().count()
    if not rows:
        return None
    shards = -(-min(rows, MAX_ROWS) // SHARD_ROWS)
    sample = sample.filter(share(rows, "__id", "__key", F.lit(9))).dropDuplicates(["__id", "__key"])
    shard = F.pmod(F.xxhash64("__id", "__key", F.lit(5)), F.lit(shards))
    return sample.select("__id", "__text", "__label", shard.alias("__shard"))


def train(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> np.ndarray | None:
    """Averaged weights, or None without labelled rows."""
    sample = training_rows(documents, labels, doc_id, text, label)
    if sample is None:
        return None

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__id", "ascending"), ("__text", "ascending")])
        texts = binary_texts(table["__text"].combine_chunks())
        weights = follow_the_leader(sparse_rows(texts), table["__label"].to_numpy().astype(float))
        return pa.table({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    fitted = sample.groupBy("__shard").applyInArrow(fit, "weights binary").collect()  # a row per shard, 1 MB each
    if not fitted:
        return None
    return np.mean([np.frombuffer(f["weights"], "<f4") for f in fitted], axis=0, dtype=np.float64)


def score(df: DataFrame, text: str, weights: np.ndarray | None, into: str = SCORE) -> DataFrame:
    """All columns of ``df`` and a score from 0 to 1."""
    if weights is None:
        return df.withColumn(into, F.lit(1.0))
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            linear = linear_scores(binary_texts(batch.column(text)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sigmoid(linear), pa.float64())], [*batch.schema.names, into]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())]))


def op1_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    weights = train(documents, labels, "doc_id", "text", "quality")
    scored = score(documents.select("doc_id", "text"), "text", weights)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"),
        (F.col(SCORE) >= threshold).cast("int").alias("predicted"),
    )
