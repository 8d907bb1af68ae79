from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from holdfast.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def second_engine(frame):
    documents = frame.toPandas()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", documents)
    try:
        return sorted(con.execute(divergence.OP11_SQL).fetchall())
    finally:
        con.close()


def result(store, frame):
    return sorted(tuple(r) for r in divergence.op11_count_cells(store, frame).select(*COLUMNS).collect())


def corpus(spark, seed, sources=5):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 9 == 0 else f"Wörd{chr(97 + i % 26)}" if i % 5 == 0 else "w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(120)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "de", None])
        source = None if i % 17 == 0 else f"s{rng.randrange(sources)}" if rng.random() < 0.6 else "hot"
        text = " ".join(rng.choice(words[:rng.choice([8, 60, 120])]) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text + rng.choice(["", "!", "-x9y", "\n\x00\x7f", "ΑΣ İ"]), lang, source))
    rows += [(1000, None, "en", "s0"), (1001, "", "en", "none"), (1002, " 1 2 ", "xx", "alone"), (1003, "few", "yy", "a"), (1004, None, "yy", "b")]
    rows += [(1005, "twice twice", "en", "s1")] * 40 + [(1006, "ÀB " * 50_000, "de", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_second_engine(spark, store, seed):
    docs = corpus(spark, seed)
    got = result(store, docs.selectExpr("*", "1 as term", "2 as n", "3 as value"))
    assert got == second_engine(docs)
    assert {r[2] for r in got} == {"pair", "term"}


def test_many_tiles_and_chunks_give_the_same(spark, store, monkeypatch):
    docs = corpus(spark, 3, sources=9)
    want = second_engine(docs)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 40)
    assert result(store, docs) == want


def test_without_kept_terms_pairs_have_value_zero(spark, store):
    rows = [(1, "some words", "en", "a"), (2, "other words", "en", "b"), (3, None, None, None), (4, "", "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert result(store, docs) == second_engine(docs) == [
        ("", "", "pair", "z", 0, 1), ("", "z", "pair", "", 0, 1), ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1),
    ]


def test_empty_table(spark, store):
    assert result(store, spark.createDataFrame([], "doc_id long, text string, lang string, source string")) == []


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, kept = 9 * 10**15, 10**16 + 7, 10**9
    frame = spark.createDataFrame([(n, total, kept)], "n long, total long, v long")
    got = frame.select(divergence.share(frame.n, frame.total, frame.v)).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_partial_distances():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 5, (40, 6))
    base = np.array([7, 1, 3, 0, 9, 2])
    term, place = np.nonzero(whole)
    full = np.where(whole > 0, whole, base[None, :])
    left, right = np.array([0, 3]), np.arange(6)
    got = divergence.partial_distances(term, place, whole[term, place], base, left, right)
    used = whole.any(1)
    want = np.abs(full[used][:, left, None] - full[used][:, None, right]).sum(0)
    assert (got == want).all()
