from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdfast.llm import bpe
from holdfast.llm.tables import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\n c\t"), (5, "Don't we'LL 12345 x²½"), (6, "end<|endoftext|>  next"),
    (7, "<|endoftext|>"), (8, "né́ 日本語 🙂 \x00\x1c"), (9, "spam " * 20_000), (10, "x" * 50_000), (1, None), (11, "a  b\n\n c\t"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_like_the_library(docs_of, library):
    got = bpe.op4_bpe_encode_decode(docs_of(TEXTS).withColumn("ids", F.lit(1)), PATH).collect()
    want = []
    for doc_id, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((
            doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
        ))
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_like_the_library(docs_of, library):
    got = bpe.op8_token_counts(docs_of(TEXTS), PATH).collect()
    want = []
    for doc_id, text in TEXTS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table_and_unknown_ids(spark, docs_of):
    assert bpe.op8_token_counts(docs_of([]), PATH).count() == 0
    assert bpe.op4_bpe_encode_decode(docs_of([]), PATH).count() == 0
    ids = spark.createDataFrame([([72, None, -1, 10**6, 50256],), ([],), (None,), ([94],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, "ids", PATH).collect()] == ["i<|endoftext|>", "", "", "�"]


def test_merge_skips_stale_entries():
    # ab, bc and abc: after "ab" is merged, the entry of "bc" is stale.
    ranks = {1 << 20 | 2: 0, 2 << 20 | 3: 1, 4 << 20 | 3: 2}
    symbols = [1, 2, 3, 2, 3]
    assert bpe.merge(symbols, ranks, [4, 5, 6]) == 3
    assert [s for s in symbols if s >= 0] == [6, 5]


def test_memo_forgets_but_stays_right():
    memo = bpe.Memo(len, size=4)
    for n in range(1, 20):
        assert memo.of(["x" * n, "x", "yy"]) == [n, 1, 2]
    assert len(memo.kept) <= 4
