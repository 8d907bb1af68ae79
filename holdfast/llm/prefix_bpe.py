"""Byte-level byte-pair encoding by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one token that can stand last in its encoding.  It is found from left to
right: of the vocabulary strings that end at a byte, the one whose predecessor, the last token of the prefix
before it, may stand next to it.  Two tokens may stand next to each other if no merge would have crossed
their border; that is seen by taking both apart, latest merge first, and looking at the pairs that met on
the way.  A piece's ids are read backwards from its end.

The last tokens of all prefixes, one number a byte, are a document's prefix table.  They depend only on
what stands before them, so text can be appended without touching the table so far, and after an edit the
old entries hold again as soon as as many of them as the longest token has bytes come out the same.  In a
table the last byte of a piece holds the complement of its token, which keeps the piece borders.

Ids and ranks are those of the ranks file: a pair merges into the token of its joined bytes, lowest id first,
leftmost of equals.  Decoding joins the vocabulary strings of a batch in one array and cuts it at the rows.

Defined results: a null text counts as empty; an empty text has no ids and an empty table; ids outside the
vocabulary and nulls decode to no bytes; a null id list decodes to none.  An edit beyond the end of a text is
moved to the end; a null edit leaves the row as it is.  Repeated rows and extra columns are kept as they are; only
the named columns are looked at, and a result replaces a column of its name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.bpe import Memo, joined_strings
from holdfast.llm.tables import locate
from holdfast.llm.text import small_batches

_SHIFT = 24
_NEVER = 1 << 62
#: Answers on neighbours that are kept; when they are as many they are forgotten and asked anew.
PAIRS_KEPT = 300_000
#: A piece is settled by its own characters and at most this many after them: the split pattern looks one ahead.
LOOK_AHEAD = 4


class Edit(NamedTuple):
    """The text and table after an edit, and how many table entries were computed for it."""

    text: str
    last: np.ndarray
    computed: int


class Prefixes:
    """The vocabulary of a ranks file, ready for encoding by prefixes; loaded once per Python worker."""

    _loaded: dict[tuple[str, str], Prefixes] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = ranks
        self.split = regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.length = [0] * size
        strings: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.length[rank], strings[rank] = len(token), token
        self.lengths = np.array(self.length or [0], np.int32)
        self.strings = pa.array(strings, pa.large_binary())
        self.longest = max(self.length, default=1)
        # A token's two parts, and for a pair of parts the token; single bytes have no parts.
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[int, int] = {}
        self.known: dict[int, bool] = {}
        for rank in range(size):
            if self.length[rank] > 1:
                self._take_apart(rank, strings[rank])
        self.known.clear()
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.codes = Memo(self._codes_of)

    @classmethod
    def load(cls, path: str, pattern: str) -> Prefixes:
        if (path, pattern) not in cls._loaded:
            with open(locate(path), "rb") as file:
                lines = [line.split() for line in file if line.strip()]
            cls._loaded[path, pattern] = cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)
        return cls._loaded[path, pattern]

    def _take_apart(self, rank: int, token: bytes) -> None:
        """The last merge of a token: the two neighbours that the merges before its own leave."""
        found = []
        for cut in range(1, len(token)):
            left, right = self.ids.get(token[:cut], _NEVER), self.ids.get(token[cut:], _NEVER)
            if left < rank and right < rank:
                found.append((left, right))
        for left, right in found:
            if len(found) == 1 or self.meet(left, right):
                self.parts[rank] = (left, right)
                self.joined[left << _SHIFT | right] = rank
                return

    def meet(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no pair at their border merged while both its sides stood."""
        key = left << _SHIFT | right
        answer = self.known.get(key)
        if answer is not None:
            return answer
        parts, joined = self.parts, self.joined
        left_until = right_until = _NEVER  # the merges that take the two sides away
        answer = True
        while True:
            merged = joined.get(left << _SHIFT | right)
            # Of equal ranks the leftmost merges first, which is the one inside the left token.
            if merged is not None and merged < left_until and merged <= right_until:
                answer = False
                break
            left_parts, right_parts = parts[left], parts[right]
            if left_parts is not None and (right_parts is None or left > right):
                left_until, left = left, left_parts[1]
            elif right_parts is not None:
                right_until, right = right, right_parts[0]
            else:
                break
        if len(self.known) >= PAIRS_KEPT:
            self.known.clear()
        self.known[key] = answer
        return answer

    def last_tokens(self, piece: bytes, before: list[int] | None = None) -> list[int]:
        """The last token of every prefix; ``before`` holds those of a first part that are known already."""
        last = list(before or ())
        start = len(last)
        last += [-1] * (len(piece) - start)
        meet, known, here = self.meet, self.known, -1
        # Tokens that end behind the known part begin at most one token's length before its end.
        reach = max(0, start - self.longest + 1)
        for end, (token, length) in self.ends.iter(piece[reach:].decode("latin-1")):
            end += reach
            if end == here or end < start:
                continue  # found already: the last token is unique
            first = end - length
            if first >= 0:
                previous = last[first]
                answer = known.get(previous << _SHIFT | token)
                if answer is None:
                    answer = meet(previous, token)
                if not answer:
                    continue
            last[end] = token
            here = end
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """Ids of a piece from its table."""
        ids, at = [], len(last)
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= self.length[token]
        ids.reverse()
        return ids

    def _codes_of(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ids.get(raw)  # a piece that is a token is that token
        ids = [whole] if whole is not None else self.read_back(self.last_tokens(raw))
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as packed 32-bit integers."""
        return b"".join(self.codes.of(self.split.findall(text)))

    def table(self, text: str) -> np.ndarray:
        """The text's prefix table."""
        return np.concatenate([np.zeros(0, np.int32), *map(self._piece_table, self.split.findall(text))])

    def _piece_table(self, piece: str, before: list[int] | None = None) -> np.ndarray:
        raw = piece.encode("utf-8")
        last = self.last_tokens(raw, before)
        out = np.array(last, np.int32)
        out[-1] = ~self.ids.get(raw, last[-1])
        return out

    def ids_of(self, last: np.ndarray) -> np.ndarray:
        """The ids that a prefix table holds, read backwards from its end."""
        table = np.where(last < 0, ~last, last).tolist()
        return np.array(self.read_back(table), np.int32)

    def edit(self, text: str, last: np.ndarray, at: int, removed: int, inserted: str) -> Edit:
        """Replaces ``removed`` characters at ``at`` by ``inserted`` and mends the table near the edit only."""
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + inserted + text[at + removed:]
        # Pieces that end before the edit, with what the pattern looks at, stay.
        ends = np.flatnonzero(last < 0) + 1
        safe = len(text[:max(0, at - LOOK_AHEAD)].encode("utf-8"))
        kept = int(np.searchsorted(ends, safe, "right"))
        byte = int(ends[kept - 1]) if kept else 0
        character = len(text.encode("utf-8")[:byte].decode("utf-8"))
        shift = len(new) - len(text)
        old_tail = len(text[at + removed:].encode("utf-8"))
        borders, parts, computed = set(ends.tolist()) | {0}, [last[:byte]], 0
        while character < len(new):
            # Behind the edit, a border where the old text had one: all that follows is as it was.
            if character >= at + len(inserted):
                tail = len(new[character:].encode("utf-8"))
                if tail <= old_tail and len(last) - tail in borders:
                    parts.append(last[len(last) - tail:])
                    break
            found = self.split.match(new, character)
            if found is None or not found.group():  # between pieces: no byte of the encoding
                raise ValueError("the split pattern leaves characters out")
            piece = found.group()
            mended, steps = self._mend(piece, character, at, shift, text, last, len(inserted))
            parts.append(mended)
            computed += steps
            character += len(piece)
        return Edit(new, np.concatenate(parts).astype(np.int32), computed)

    def _mend(
        self, piece: str, start: int, at: int, shift: int, text: str, last: np.ndarray, inserted: int
    ) -> tuple[np.ndarray, int]:
        """The table of a piece that begins at ``start`` of the new text, from the old entries where they hold."""
        raw = piece.encode("utf-8")
        before: list[int] = []
        offset = len(text[:start].encode("utf-8"))
        if start < at and (start == 0 or last[offset - 1] < 0):
            # The unedited beginning of an old piece: its entries are those of the same prefixes.
            same = min(len(text[start:at].encode("utf-8")), len(raw) - 1)
            old = last[offset:offset + same]
            inside = np.flatnonzero(old < 0)
            same = int(inside[0]) if len(inside) else same
            before = old[:same].tolist()
        behind = at + inserted - start  # characters of the piece up to the end of the edit
        if not 0 <= behind < len(piece):
            return self._piece_table(piece, before), len(raw) - len(before)
        # Entry by entry past the edit, until as many as the longest token has bytes agree with the old ones.
        tail = len(piece[behind:].encode("utf-8"))
        old_start = len(text[:start + len(piece) - shift].encode("utf-8")) - tail
        old = last[old_start:old_start + tail]
        step, done = 4 * self.longest, before
        while True:
            to = min(len(raw), max(len(done) + step, len(raw) - tail + self.longest))
            done = self.last_tokens(raw[:to], done)
            checked = to - (len(raw) - tail)
            if to == len(raw) or (
                checked >= self.longest
                and done[to - self.longest:to] == old[checked - self.longest:checked].tolist()
            ):
                break
        computed = len(done) - len(before)
        rest = old[len(old) - (len(raw) - len(done)):] if len(done) < len(raw) else np.zeros(0, np.int32)
        if len(rest) and (rest[-1] >= 0 or (rest[:-1] < 0).any()):  # the old piece ended elsewhere
            done, rest = self.last_tokens(raw, done), np.zeros(0, np.int32)
            computed = len(done) - len(before)
        out = np.concatenate((np.array(done, np.int32), rest)).astype(np.int32)
        final = int(out[-1]) if out[-1] >= 0 else ~int(out[-1])
        out[-1] = ~self.ids.get(raw, final)
        return out, computed


def encode(df: DataFrame, text: str, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """Adds the ids of ``text`` as an integer array; ``text`` itself is dropped."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Prefixes.load(path, pattern)
        for batch in small_batches(batches):
            yield _put(batch, {into: _id_lists([words.encode(t or "") for t in batch.column(text).to_pylist()])}, text)

    return df.mapInArrow(run, _schema(df, {into: T.ArrayType(T.IntegerType())}, text))


def decode(df: DataFrame, ids: str, path: str, pattern: str, into: str = "decoded") -> DataFrame:
    """Adds the bytes of an id array."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Prefixes.load(path, pattern).strings
        for batch in small_batches(batches):
            yield _put(batch, {into: joined_strings(strings, batch.column(ids)).cast(pa.binary())})

    return df.mapInArrow(run, _schema(df, {into: T.BinaryType()}))


def encode_decode(
    df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one node, so a task needs one Python worker; ``text`` is dropped."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Prefixes.load(path, pattern)
        for batch in small_batches(batches):
            lists = _id_lists([words.encode(t or "") for t in batch.column(text).to_pylist()])
            yield _put(batch, {ids: lists, decoded: joined_strings(words.strings, lists).cast(pa.binary())}, text)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, _schema(df, {ids: T.ArrayType(T.IntegerType()), decoded: T.BinaryType()}, text))


def prefix_tables(df: DataFrame, text: str, path: str, pattern: str, into: str = "last") -> DataFrame:
    """Adds the prefix table of ``text``, one integer a byte."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Prefixes.load(path, pattern)
        for batch in small_batches(batches):
            yield _put(batch, {into: _lists([words.table(t or "") for t in batch.column(text).to_pylist()])})

    return df.mapInArrow(run, _schema(df, {into: T.ArrayType(T.IntegerType())}))


def ids_of_tables(df: DataFrame, last: str, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """Adds the ids that prefix tables hold; no text is needed."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Prefixes.load(path, pattern)
        for batch in small_batches(batches):
            tables = [np.array(t or [], np.int32) for t in batch.column(last).to_pylist()]
            yield _put(batch, {into: _lists([words.ids_of(t) for t in tables])})

    return df.mapInArrow(run, _schema(df, {into: T.ArrayType(T.IntegerType())}))


def edit_tables(
    df: DataFrame, text: str, last: str, at: str, removed: str, inserted: str, path: str, pattern: str,
    computed: str = "computed",
) -> DataFrame:
    """Replaces ``removed`` characters at ``at`` by ``inserted`` in text and table; an edit at the end appends.

    Adds how many table entries were computed anew; the others were taken over.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Prefixes.load(path, pattern)
        for batch in small_batches(batches):
            texts, tables, steps = [], [], []
            for t, table, where, gone, new in zip(*(batch.column(c).to_pylist() for c in (text, last, at, removed, inserted))):
                if where is None or (not gone and not new):
                    edited = Edit(t or "", np.array(table or [], np.int32), 0)
                else:
                    edited = words.edit(t or "", np.array(table or [], np.int32), where, gone or 0, new or "")
                texts.append(edited.text)
                tables.append(edited.last)
                steps.append(edited.computed)
            yield _put(batch, {text: pa.array(texts, pa.string()), last: _lists(tables), computed: pa.array(steps, pa.int64())})

    return df.mapInArrow(run, _schema(df, {
        text: T.StringType(), last: T.ArrayType(T.IntegerType()), computed: T.LongType()
    }))


def _schema(df: DataFrame, added: dict[str, T.DataType], dropped: str | None = None) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name != dropped and f.name not in added]
    return T.StructType([*kept, *(T.StructField(name, kind) for name, kind in added.items())])


def _put(batch: pa.RecordBatch, added: dict[str, pa.Array], dropped: str | None = None) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != dropped and n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added.values()], [*names, *added])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *rows]))


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    return _lists([np.frombuffer(p, np.int32) for p in packed])


def op12_prefix_dp(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids and round-tripped bytes of every document, as digests."""
    coded = encode_decode(documents.select("doc_id", "text"), "text", path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
