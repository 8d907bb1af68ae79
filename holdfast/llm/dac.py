"""Token ids in directly addressable codes.

Ids are cut into chunks of eight bits.  Level 0 holds the lowest chunk of every id; a bitmap marks the
ids that go on, and level 1 holds the next chunk of only those, and so forth.  A directory with the
number of marks before every 512 bits turns a position on one level into its position on the next,
so any id is read by touching one chunk per level, without decoding what lies before it.

A written corpus is a folder of segment rows in document order, written through Spark's writer to any
store that Spark knows: the range partition and place of the segment, the documents in it with their
lengths, and the coded ids.  A document never spans segments.

Defined results: null texts count as empty, and an empty document holds the end id alone.  Null
document ids come first; rows with the same id are ordered by text.  An empty table writes no segment.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.literals import literal_rows
from holdfast.llm.bpe import byte_symbols
from holdfast.llm.tables import locate
from holdfast.llm.text import small_batches
from holdfast.plans.store import TableStore

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1 << 18
SEGMENT_DOCUMENTS = 4096
MEMO_WORDS = 700_000
MEMO_LENGTH = 48

#: Lead bytes of characters from U+0300 on; below there are no combining marks and lower case is taken by character.
_COMBINING = re.compile(rb"[\xcc-\xff]")
#: Runs of printable ASCII and small Latin letters, which are split into pieces here.
_PLAIN = re.compile(r"[!-;=-~\u00df-\u00f6\u00f8-\u024f]+")
# Fixed value: the split pattern that belongs to the vocabulary, for the characters of a plain run.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")
_SYMBOLS = dict(enumerate(byte_symbols()))

SEGMENTS = (
    "part int, segment int, first_id bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
)


def pack(ids: np.ndarray) -> bytes:
    """Codes unsigned 32-bit ids: magic, count, levels, then each level with its bitmap and directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, higher = (rest & 0xFF).astype(np.uint8), rest >> CHUNK_BITS
        goes_on = higher > 0
        last = not goes_on.any()
        body = struct.pack("<I", len(rest)) + chunks.tobytes()
        if not last:
            bits = np.packbits(goes_on, bitorder="little")
            body += bits.tobytes() + _directory(goes_on).tobytes()
        levels.append(body)
        if last:
            return MAGIC + struct.pack("<IB", len(ids), len(levels)) + b"".join(levels)
        rest = higher[goes_on]


def _directory(bits: np.ndarray) -> np.ndarray:
    """Marks before each run of 512 bits."""
    starts = np.arange(0, len(bits), RANK_BITS)
    counts = np.add.reduceat(bits.astype(np.uint32), starts)
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u4")


class Reader:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a coded segment")
        self.count, levels = struct.unpack_from("<IB", payload, 4)
        at, self.levels = 9, []
        for level in range(levels):
            (size,) = struct.unpack_from("<I", payload, at)
            at += 4
            chunks = np.frombuffer(payload, np.uint8, size, at)
            at += size
            bits = directory = None
            if level < levels - 1:
                bits = np.frombuffer(payload, np.uint8, -(-size // 8), at)
                at += len(bits)
                directory = np.frombuffer(payload, "<u4", -(-size // RANK_BITS), at)
                at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, directory, i)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Marks before bit ``i``: the directory entry and the bits of one 512-bit run."""
        run = i // RANK_BITS
        within = np.unpackbits(bits[run * (RANK_BITS // 8):(i >> 3) + 1], bitorder="little")
        return int(directory[run]) + int(within[: i - run * RANK_BITS].sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` to ``stop``: each level is entered at the rank of ``start``."""
        values = np.zeros(max(0, min(stop, self.count) - start), np.uint32)
        where, i = np.arange(len(values)), start
        for level, (chunks, bits, directory) in enumerate(self.levels):
            if not len(where):
                break
            values[where] |= chunks[i:i + len(where)].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if bits is None:
                break
            byte = i >> 3
            marks = np.unpackbits(bits[byte:(i + len(where) + 7) >> 3], bitorder="little")[i & 7:][: len(where)]
            where, i = where[marks.astype(bool)], self._rank(bits, directory, i)
        return values


class LibraryWords:
    """Token ids by a vocabulary that drops white space, lower-cases and splits into pieces.

    Such a tokenizer handles every run between spaces by itself, so each distinct run is encoded once
    and a bounded memo serves the repeats.  Runs of printable ASCII and Latin letters need no
    normalising beyond lower case: their pieces go straight to the library's merge model.  All others
    go through the whole tokenizer.
    """

    _loaded: dict[str, LibraryWords] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(locate(path))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merge = self.tokenizer.model.tokenize
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> LibraryWords:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def runs(text: str) -> list[str]:
        """The text between ASCII white space; in lower case where that can't change what follows."""
        raw = text.encode("utf-8")
        if b"<" not in raw and not _COMBINING.search(raw):
            raw = text.lower().encode("utf-8")
        return b"\n".join(raw.split()).decode("utf-8").split("\n") if raw.strip() else []

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_SYMBOLS)
            ids = array("I", [token.id for token in self.merge(symbols)]).tobytes()
            if len(piece) <= MEMO_LENGTH:
                self.pieces[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of every text."""
        kept = self.kept
        words = [self.runs(text) for text in texts]
        new = {w for run in words for w in run if w not in kept}
        odd = [w for w in new if not (w == w.lower() and _PLAIN.fullmatch(w))]
        coded = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        kept.update((w, array("I", c.ids).tobytes()) for w, c in zip(odd, coded))
        for w in new.difference(odd):
            kept[w] = b"".join(map(self.piece, _PIECES.findall(w)))
        out = [b"".join([kept[w] for w in run]) for run in words]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del kept[w]
        for memo in (kept, self.pieces):
            if len(memo) > MEMO_WORDS:  # what came first is mostly frequent
                for w in list(memo)[MEMO_WORDS // 2:]:
                    del memo[w]
        return out


def write_corpus(store: TableStore, df: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    """Encodes ``text`` and writes it as segments in ascending ``doc_id`` order; returns the segment rows.

    Rows are range-partitioned by (id, hash of the text), so an id shared by many rows is still
    spread; every task then codes its sorted stretch segment by segment.
    """
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = LibraryWords.load(path)
        end = np.array([end_id], "<u4").tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, held
            payload = pack(np.frombuffer(b"".join(ids), "<u4"))
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], ["part", "segment", "first_id", "n_ids", "doc_ids", "lengths", "payload"])
            segment, first, held = segment + 1, first + held, 0
            for kept in (ids, doc_ids, lengths):
                kept.clear()
            return out

        for batch in small_batches(batches, rows=128):
            texts = batch.column(1).to_pylist()
            for key, coded in zip(batch.column(0).to_pylist(), words.encode(texts)):
                coded += end
                ids.append(coded)
                doc_ids.append(key)
                lengths.append(len(coded) // 4)
                held += len(coded) // 4
                if held >= SEGMENT_IDS or len(ids) >= SEGMENT_DOCUMENTS:
                    yield flush()
        if ids:
            yield flush()

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    return store.write("token_segments", rows.select("doc_id", "text").mapInArrow(code, SEGMENTS))


def read_documents(segments: DataFrame) -> DataFrame:
    """Every document of a written corpus: doc_id, part, start in the part, n_tokens and its ids' CRC-32."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=4):
            for row in batch.to_pylist():
                reader = Reader(row["payload"])
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                sums = [
                    zlib.crc32(reader.slice(int(s), int(s + n)).astype("<u4").tobytes())
                    for s, n in zip(starts, lengths)
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(sums), pa.int32()),
                    pa.array(starts + row["first_id"], pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(
        read, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    )


def part_starts(segments: DataFrame) -> DataFrame:
    """Ids before each range partition: one row per partition of the writing job, a bounded number."""
    parts = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, before = [], 0
    for part in parts:
        rows.append((part["part"], before))
        before += part["n"]
    return literal_rows(segments.sparkSession, rows, "part int, ids_before bigint")


def ids_at(segments: DataFrame, positions: Sequence[int]) -> dict[int, int]:
    """The ids at a few positions of the whole corpus; only the segments that hold them are read."""
    out: dict[int, int] = {}
    starts = part_starts(segments)
    placed = segments.join(F.broadcast(starts), "part").withColumn("start", F.col("ids_before") + F.col("first_id"))
    for position in set(positions):
        holds = (F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)
        row = placed.filter(holds).select("start", "payload").first()
        if row is not None:
            out[position] = Reader(row["payload"])[position - row["start"]]
    return out


def op3_directly_addressable_codes(store: TableStore, documents: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the corpus, reads it back, and places every document among all ids."""
    segments = write_corpus(store, documents, "doc_id", "text", path, end_id)
    return (
        read_documents(segments)
        .join(F.broadcast(part_starts(segments)), "part")
        .select("doc_id", (F.col("ids_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
    )
