from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from holdfast.llm import prefix_bpe
from holdfast.llm.tables import split_pattern, tokenizer_file

PATH, PATTERN = tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern()
PIECES = [
    "a", "b", "the", "in", " ", "  ", "\n", "'s", "'ll", "é", "日", "🙂", "x" * 9, "-" * 7, "=", "1", "22", "́", "\x1c", "\x85",
    "ß", "_", "\x00", "<|endoftext|>",
]
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\n c\t"), (5, "Don't we'LL 12345 x²½"), (6, "end<|endoftext|>  next"),
    (8, "né́ 日本語 🙂 \x00\x1c"), (9, "spam " * 20_000), (10, "x" * 50_000), (1, None), (None, "a  b\n\n c\t"),
]


@pytest.fixture(scope="module")
def words():
    return prefix_bpe.Prefixes.load("byte_bpe_50k.tiktoken", PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, longest):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(longest)))


def test_like_the_library(docs_of, library):
    got = prefix_bpe.op12_prefix_dp(docs_of(TEXTS).withColumn("ids", F.lit(1)), PATH, PATTERN).collect()
    want = []
    for doc_id, text in TEXTS:
        ids = library.encode_ordinary(text or "")
        want.append((
            doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode_bytes(ids)).hexdigest(),
        ))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_random_texts_and_every_character(words, library):
    rng = random.Random(3)
    texts = [random_text(rng, 40) for _ in range(1500)]
    texts += ["".join(f"a{chr(c)} b{chr(c)}" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000) for low in range(0, 0x30000, 512)]
    for text in texts:
        want = library.encode_ordinary(text)
        assert np.frombuffer(words.encode(text), np.int32).tolist() == want
        assert words.ids_of(words.table(text)).tolist() == want


def test_another_vocabulary(library):
    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    other = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = prefix_bpe.Prefixes.load("byte_bpe_multi_50k.tiktoken", PATTERN)
    rng = random.Random(4)
    for _ in range(500):
        text = random_text(rng, 40)
        assert np.frombuffer(words.encode(text), np.int32).tolist() == other.encode_ordinary(text)


def test_every_prefix_has_its_own_encoding(words, library):
    raw = "unbelievably"
    last = words.last_tokens(raw.encode())
    for n in range(1, len(raw) + 1):
        assert words.read_back(last[:n]) == library.encode_ordinary(raw[:n])


def test_edits_equal_encoding_anew(words):
    rng = random.Random(5)
    for _ in range(2000):
        text = random_text(rng, 40)
        at, removed, inserted = rng.randrange(len(text) + 1), rng.randrange(5), random_text(rng, 4)
        edited = words.edit(text, words.table(text), at, removed, inserted)
        assert edited.text == text[:at] + inserted + text[at + removed:]
        assert np.array_equal(edited.last, words.table(edited.text)), (text, at, removed, inserted)


def test_edits_and_appends_compute_little(words):
    rng = random.Random(6)
    long = "".join(rng.choice(["an", "th", "e", "x", "re", "ing", "o"]) for _ in range(30_000))
    text = long + " " + long[::-1] + " some words" * 5_000
    table = words.table(text)
    for at, inserted in ((20_000, "Q"), (70_000, "QQ"), (len(text), "bab tail")):
        edited = words.edit(text, table, at, 2, inserted)
        assert np.array_equal(edited.last, words.table(edited.text)) and edited.computed <= 8 * words.longest


def test_tables_as_columns(docs_of, words):
    rows = [(1, "Hello wor"), (2, None), (3, "one two"), (4, "gone"), (5, "é edge")]
    edits = {1: (9, 0, "ld again"), 2: (0, 0, "new"), 3: (3, 1, ""), 4: (None, 2, "x"), 5: (99, 5, "!")}
    tables = prefix_bpe.prefix_tables(docs_of(rows), "text", PATH, PATTERN)
    for n, (name, kind) in enumerate((("at", "int"), ("gone", "int"), ("new", "string"))):
        value = F.create_map(*[x for k, v in edits.items() for x in (F.lit(k), F.lit(v[n]).cast(kind))])
        tables = tables.withColumn(name, value[F.col("doc_id")])
    edited = prefix_bpe.edit_tables(tables, "text", "last", "at", "gone", "new", PATH, PATTERN)
    got = {r.doc_id: r for r in prefix_bpe.ids_of_tables(edited, "last", PATH, PATTERN).collect()}
    want = {1: "Hello world again", 2: "new", 3: "onetwo", 4: "gone", 5: "é edge!"}
    assert {i: r.text for i, r in got.items()} == want
    assert {i: r.ids for i, r in got.items()} == {
        i: np.frombuffer(words.encode(t), np.int32).tolist() for i, t in want.items()
    }


def test_encode_and_decode_alone(spark, docs_of):
    coded = prefix_bpe.decode(prefix_bpe.encode(docs_of(TEXTS), "text", PATH, PATTERN), "ids", PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in coded.collect()) == sorted((t or "").encode() for _, t in TEXTS)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    ids = spark.createDataFrame([([72, None, -1, 10**6, 50255],), ([],), (None,)], "ids array<int>")
    strings = prefix_bpe.Prefixes.load(PATH, PATTERN).strings
    want = strings[72].as_py() + strings[50255].as_py()
    assert [bytes(r.decoded) for r in prefix_bpe.decode(ids, "ids", PATH, PATTERN).collect()] == [want, b"", b""]


def test_empty_table(docs_of):
    assert prefix_bpe.op12_prefix_dp(docs_of([]), PATH, PATTERN).count() == 0
    assert prefix_bpe.prefix_tables(docs_of([]), "text", PATH, PATTERN).count() == 0
