from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from holdfast.llm import dac
from holdfast.llm.tables import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    (5, "Hello, World's  end"), (None, "first"), (1, None), (2, ""), (3, " \n "), (4, "É́ne 日本 ΑΣ ß x² \x1c  y"),
    (9, "spam eggs " * 9000), (7, "<|endoftext|>a<|startoftext|> b"), (8, "y" * 3000), (5, "Hello, World's  end"),
    (5, "Another"),
]


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
    ids[rng.integers(0, 3000, 500)] = 3
    reader = dac.Reader(dac.pack(ids))
    assert (reader.slice(0, len(ids)) == ids).all()
    for i in (0, 1, 511, 512, 513, 1024, 2999):
        assert reader[i] == ids[i]
    for a, b in ((0, 0), (5, 9), (510, 1030), (2990, 3000)):
        assert (reader.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader[3000]


def test_no_ids():
    reader = dac.Reader(dac.pack(np.array([], np.uint32)))
    assert len(reader) == 0 and len(reader.slice(0, 5)) == 0


def test_documents_like_the_library(docs_of, store, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_DOCUMENTS", 3)
    got = [tuple(r) for r in dac.op3_directly_addressable_codes(store, docs_of(TEXTS), PATH).collect()]
    library = Tokenizer.from_file(PATH)
    want, start, every = [], 0, []
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(want, key=key)
    for _, s, n, _ in sorted(got, key=lambda r: r[1]):  # the starts follow on one another in id order
        assert s == start
        start += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == [d for d, _ in rows]


def test_runs_and_pieces_like_the_library():
    library, words = Tokenizer.from_file(PATH), dac.LibraryWords(PATH)
    texts = [f"a{chr(c)}b {chr(c)}X it{chr(c)}s'll {chr(c)}" for c in range(0x400) if not 0xD800 <= c < 0xE000]
    texts += ["J\u030c E\u0301 ΑΣ. İstanbul", "can't WE'LL 12ab'3's --'--", "<|ENDOFTEXT|> <|endoftext|>x", "\U0001f642 ok"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_access_to_the_written_corpus(docs_of, store):
    docs = docs_of([(i, f"word{i} again") for i in range(50)])
    segments = dac.write_corpus(store, docs, "doc_id", "text", PATH, 2)
    library = Tokenizer.from_file(PATH)
    every = [t for i in range(50) for t in (*library.encode(f"word{i} again", add_special_tokens=False).ids, 2)]
    assert dac.ids_at(segments, [0, 7, len(every) - 1, len(every)]) == {p: every[p] for p in (0, 7, len(every) - 1)}


def test_empty_table(docs_of, store):
    assert dac.op3_directly_addressable_codes(store, docs_of([]), PATH).count() == 0
