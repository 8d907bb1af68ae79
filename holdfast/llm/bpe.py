"""Byte-level byte-pair encoding, decoding and counting.

The merge loop keeps the symbols of a piece in a doubly linked list and all mergeable neighbours in
a priority queue ordered by (merge rank, position).  The smallest entry is popped, skipped if its
pair no longer stands there, and otherwise merged; the two new neighbour pairs are pushed.

Texts are first split at the added tokens' strings, then by the byte-level pattern.  Most pieces
repeat, so each worker keeps the results of short pieces in a memo of bounded size.  Decoding looks all ids
of a batch up in one array of vocabulary strings; their joined bytes are cut at the ends of the rows.

Defined results: a null text counts as empty, an empty text has no tokens, ids outside the
vocabulary decode to nothing, and bytes that are not UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.tables import locate
from holdfast.llm.text import small_batches

# Fixed value: the byte-level split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIFT = 20  # ids fit in 20 bits
#: Pieces of at most 48 characters in a memo: some 60 MB with usual words, 200 MB at the very most.
MEMO_PIECES = 300_000
MEMO_LENGTH = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves, the others take the characters from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Merge ranks by left and right symbol; ``results`` gives the new symbol of a rank."""

    def __init__(self, ranks: dict[int, int], results: list[int]):
        self.results = results
        self.gone = 1 + max([r >> _SHIFT for r in ranks] + [r & (1 << _SHIFT) - 1 for r in ranks] + results, default=0)
        nothing: dict[int, int] = {}
        self.after: list[dict[int, int]] = [nothing] * (self.gone + 1)  # the last one is for merged-away symbols
        for pair, rank in ranks.items():
            left = pair >> _SHIFT
            if self.after[left] is nothing:
                self.after[left] = {}
            self.after[left][pair & (1 << _SHIFT) - 1] = rank

    def merge(self, symbols: list[int]) -> int:
        """Merges ``symbols`` in place as far as the ranks go and returns the number of merges.

        Merged-away places become ``gone``.
        """
        n = len(symbols)
        if n < 2:
            return 0
        ranks, gone = self.after, self.gone
        heap, place, known = [], 0, ranks[symbols[0]]
        for symbol in symbols[1:]:
            if symbol in known:
                heap.append(known[symbol] * n + place)
            place += 1
            known = ranks[symbol]
        if not heap:
            return 0
        heapify(heap)
        results = self.results
        following = list(range(1, n + 1))
        before = list(range(-1, n))
        symbols.append(gone)
        merges = 0
        while heap:
            entry = heappop(heap)
            rank = entry // n
            i = entry - rank * n
            j = following[i]
            if ranks[symbols[i]].get(symbols[j]) != rank:
                continue  # stale: merged away, or another pair stands there now
            symbols[i] = new = results[rank]
            symbols[j] = gone
            merges += 1
            following[i] = j = following[j]
            before[j] = i
            known, right = ranks[new], symbols[j]
            if right in known:
                heappush(heap, known[right] * n + i)
            h = before[i]
            if h >= 0:
                known = ranks[symbols[h]]
                if new in known:
                    heappush(heap, known[new] * n + h)
        symbols.pop()
        return merges


def merge(symbols: list[int], ranks: dict[int, int], results: list[int]) -> int:
    """Merges one list in place by packed pairs; merged-away places become -1."""
    merges = Merges(ranks, results)
    done = merges.merge(symbols)
    symbols[:] = [-1 if s == merges.gone else s for s in symbols]
    return done


class Vocabulary:
    """Merge ranks and token bytes of a byte-level vocabulary file, loaded once per Python worker."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        content = _content(path)
        vocab = content["model"]["vocab"]
        self.byte_id = [vocab[s] for s in byte_symbols()]
        ranks: dict[int, int] = {}
        results: list[int] = []
        for pair in content["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(vocab[left] << _SHIFT | vocab[right], len(results))
            results.append(vocab[left + right])
        self.merges = Merges(ranks, results)
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.split = regex.compile(PATTERN)
        added = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        # Kept with the vocabulary, so the tasks that a worker runs one after another share them.
        self.counts = Memo(self.count_piece)
        self.codes = Memo(self.encode_piece)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def symbols(self, piece: str) -> list[int]:
        byte_id = self.byte_id
        return [byte_id[b] for b in piece.encode("utf-8")]

    def count_piece(self, piece: str) -> int:
        symbols = self.symbols(piece)
        return len(symbols) - self.merges.merge(symbols)

    def encode_piece(self, piece: str) -> bytes:
        """The piece's ids as packed 32-bit integers."""
        symbols = self.symbols(piece)
        if self.merges.merge(symbols):
            gone = self.merges.gone
            symbols = [s for s in symbols if s != gone]
        return array("i", symbols).tobytes()

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at added tokens: (plain text, None) or (token string, its id)."""
        if self.specials is None or not self.specials.search(text):
            yield text, None
            return
        for part in self.specials.split(text):
            if part:
                yield part, self.added.get(part)


class Strings:
    """The vocabulary strings of a file as one array, loaded once per Python worker; no merges are read."""

    _loaded: dict[str, pa.LargeBinaryArray] = {}

    @classmethod
    def load(cls, path: str) -> pa.LargeBinaryArray:
        if path not in cls._loaded:
            content = _content(path)
            value = {s: b for b, s in enumerate(byte_symbols())}
            added = {t["content"]: t["id"] for t in content["added_tokens"]}
            strings = {
                i: bytes(map(value.__getitem__, s)) for s, i in content["model"]["vocab"].items() if s not in added
            }
            strings |= {i: s.encode() for s, i in added.items()}
            cls._loaded[path] = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.large_binary())
        return cls._loaded[path]


def _content(path: str) -> dict:
    with open(locate(path), encoding="utf-8") as file:
        return json.load(file)


class Memo:
    """Results of short pieces, for a bounded number of pieces.

    Half of it keeps what comes first, which is mostly frequent.  The other half goes by use, in two
    generations: what a full generation holds is forgotten unless it is met again while the next one fills.
    """

    def __init__(self, make: Callable[[str], object], size: int = MEMO_PIECES):
        self.make, self.size = make, size
        self.kept: dict[str, object] = {}
        self.recent: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def of(self, pieces: list[str]) -> list:
        kept = self.kept
        found = list(map(kept.get, pieces))
        if None in found:
            recent, older, make = self.recent, self.older, self.make
            half, quarter = self.size // 2, self.size // 4
            for at, value in enumerate(found):
                if value is None:
                    piece = pieces[at]
                    value = recent.get(piece)
                    if value is None:
                        value = kept.get(piece)
                    if value is None:
                        value = older.get(piece)
                        if value is None:
                            value = make(piece)
                        if len(piece) <= MEMO_LENGTH:
                            if len(kept) < half:
                                kept[piece] = value
                            else:
                                recent[piece] = value
                                if len(recent) >= quarter:
                                    self.older = older = recent
                                    self.recent = recent = {}
                    found[at] = value
        return found


def count_tokens(df: DataFrame, text: str, path: str, into: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``: initial symbols minus merges; no id is produced.

    All columns of ``df`` are kept, except that ``text`` is dropped before the rows leave the task.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        memo = vocabulary.counts
        for batch in small_batches(batches):
            counts = []
            for value in batch.column(text).to_pylist():
                total = 0
                for part, special in vocabulary.segments(value or ""):
                    total += 1 if special is not None else sum(memo.of(vocabulary.split.findall(part)))
                counts.append(total)
            yield _with(batch.drop_columns([text]), into, pa.array(counts, pa.int64()))

    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(count, T.StructType([*kept, T.StructField(into, T.LongType())]))


def encode(df: DataFrame, text: str, path: str, into: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as an integer array; ``text`` itself is dropped."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in small_batches(batches):
            yield _with(batch.drop_columns([text]), into, _encoded(vocabulary, batch.column(text)))

    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str, path: str, into: str = "decoded") -> DataFrame:
    """Adds the text of an id array: the concatenated vocabulary strings; ``ids`` is kept."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Strings.load(path)
        for batch in small_batches(batches):
            yield _with(batch, into, _decoded(strings, batch.column(ids)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def encode_decode(
    df: DataFrame, text: str, path: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one node, so a task needs one Python worker; ``text`` is dropped."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, strings = Vocabulary.load(path), Strings.load(path)
        for batch in small_batches(batches):
            coded = _encoded(vocabulary, batch.column(text))
            yield _with(_with(batch.drop_columns([text]), ids, coded), decoded, _decoded(strings, coded))
        pa.default_memory_pool().release_unused()

    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([
        *kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())
    ]))


def _encoded(vocabulary: Vocabulary, texts: pa.StringArray) -> pa.ListArray:
    """The ids of every text."""
    memo, split = vocabulary.codes, vocabulary.split.findall
    packed, lengths = [], []
    for value in texts.to_pylist():
        coded = b"".join([
            piece
            for part, special in vocabulary.segments(value or "")
            for piece in ((array("i", [special]).tobytes(),) if special is not None else memo.of(split(part)))
        ])
        packed.append(coded)
        lengths.append(len(coded) // 4)
    values = np.frombuffer(b"".join(packed), np.int32)
    # A batch is cut by bytes and no text has more tokens than bytes, so 32-bit offsets hold.
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), values)


def joined_strings(strings: pa.LargeBinaryArray, ids: pa.ListArray) -> pa.LargeBinaryArray:
    """The joined vocabulary strings of every id list; nulls and ids that the vocabulary does not have give nothing."""
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    flat = ids.flatten()
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(strings))), False)
    if len(known) and not pc.all(known).as_py():
        known_before = np.concatenate(([0], np.cumsum(known.to_numpy(zero_copy_only=False))))
        flat, ends = flat.filter(known), known_before[ends]
    if not len(flat):
        return pa.array([b""] * len(ids), pa.large_binary())
    found = strings.take(flat)
    _, offsets, joined = found.buffers()
    at = np.frombuffer(offsets, np.int64)[found.offset:][: len(found) + 1]
    cuts = pa.py_buffer((at[ends] - at[0]).tobytes())
    raw = pa.py_buffer(b"") if joined is None else joined.slice(int(at[0]), int(at[-1] - at[0]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, cuts, raw])


def _decoded(strings: pa.LargeBinaryArray, ids: pa.ListArray) -> pa.Array:
    texts = joined_strings(strings, ids)
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # not all of it is UTF-8
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def op4_bpe_encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """Ids and round-tripped text of every document, as digests."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode_decode(texts, "text", path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Token count of every document, and whether it exceeds ``limit``."""
    texts = documents.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return count_tokens(texts, "text", path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
