from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import quality

WORDS = "the an reed stone walks over hill and river with many slow birds".split()


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng)
        if bad:
            word = "".join(rng.choice("abcdefgh") for _ in range(6))
            text = [" ".join(w.upper() + "!!" for w in text.split()), " ".join([word] * 60), text.replace(" ", "%%% ")][i % 3]
        docs.append((i, text))
        if i < 320:
            labels.append((i, 0 if bad else 1))
    docs += [(900, None), (901, ""), (None, prose(rng)), (5, docs[5][1]), (902, prose(rng, 250_000))]
    labels += [(903, 1), (None, 0), (7, None), (8, 0), (8, 1), (8, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(docs_of, labelled):
    docs, labels = labelled
    frame = docs_of(docs).withColumn("score", F.lit("clash"))
    got = quality.op1_quality(frame, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in held) and len(held) > 50
    assert {r.predicted for r in got if r.doc_id in (None, 902)} == {1}
    again = quality.op1_quality(frame.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_an_id_on_many_rows_does_not_fill_a_shard(docs_of, spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_ROWS", 400)
    monkeypatch.setattr(quality, "SHARD_ROWS", 100)
    docs = [(1, f"text {i}") for i in range(3000)] + [(3, "the same text")] * 2000 + [(i, f"t {i}") for i in range(4, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 3))
    rows = quality.training_rows(docs_of(docs), labels, "doc_id", "text", "quality").collect()
    assert 300 < len(rows) < 500 and len({(r[0], r[1]) for r in rows}) == len(rows)
    sizes = [sum(r["__shard"] == s for r in rows) for s in range(4)]
    assert sum(sizes) == len(rows) and max(sizes) < 150


def test_without_labels_nothing_is_rejected(docs_of, labelled):
    docs, labels = labelled
    assert {r.predicted for r in quality.op1_quality(docs_of(docs), labels.limit(0)).collect()} == {1}
    assert quality.op1_quality(docs_of([]), labels).count() == 0


def test_scores_are_the_dot_products_of_the_training_rows():
    weights = np.random.default_rng(1).normal(size=(1 << quality.WEIGHT_BITS) + 1)
    texts = [b"a", None, b"", b"Some text some text", b"x x x", ("é " * 900_000).encode(), b"A1 b2, c3."]
    want = [weights[at] @ x for at, x in quality.sparse_rows(texts)]
    assert np.allclose(quality.linear_scores(texts, weights), want)


def test_updates_match_the_plain_formula():
    rows = [(np.array([0, 2]), np.array([1.0, 2.0])), (np.array([0, 1]), np.array([0.5, 1.0]))]
    got = quality.follow_the_leader(rows, np.array([1.0, 0.0]))
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << quality.WEIGHT_BITS else quality.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        s = -1 if z[i] < 0 else 1
        return -(z[i] - s * l1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(2):
            at, x = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for i, wi, xi in zip(at, w, x):
                g = (p - (1.0, 0.0)[k]) * xi
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose([got[i] for i in range(3)], [weight(i) for i in range(3)])
