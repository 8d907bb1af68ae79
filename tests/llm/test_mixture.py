from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.llm import mixture


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in fixed)
        weights = sum(weight[s] for s in names if s not in fixed)
        target = {s: cap * sizes[s] if s in fixed else rest * weight[s] / weights for s in names}
        over = {s for s in names if target[s] > cap * sizes[s]}
        if not over:
            return target
        fixed |= over


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    sources = [None, "a", "b", "B", "é", "tiny", "none"]
    rows = [(i, "w " * int(rng.lognormvariate(3, 1)), rng.choice(sources[:5])) for i in range(900)]
    rows += [(1000 + i, "same size text", "a") for i in range(500)]
    return rows + [(2000, "one two", "tiny"), (2001, None, "none"), (2002, "", "a"), (None, "x y z", "b"), (3, "w w", "a"), (3, "w w", "a")]


def test_targets_and_taken(docs_of, store, corpus):
    docs = docs_of(corpus).withColumn("target", F.lit("clash"))
    got = mixture.op2_entropy_mix(store, docs).collect()
    assert len(got) == len(corpus)
    sizes, taken = {}, {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= max(3, 0.002 * want[source]), source
    assert taken["tiny"] == 6 and taken["none"] == 0
    again = mixture.op2_entropy_mix(store, docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_are_an_exponential_tilt(docs_of, store, corpus):
    import math

    by_source = {}
    for r in mixture.op2_entropy_mix(store, docs_of(corpus)).collect():
        if r.size and 1e-9 < r.rate < 3 - 1e-9:
            by_source.setdefault(r.source, set()).add(round(math.log(r.rate) / r.size, 6))
    assert by_source and all(max(v) - min(v) < 1e-5 for v in by_source.values())


def test_the_mix_repeats_rows(docs_of, store, corpus):
    docs = docs_of(corpus).withColumn("copies", F.lit(1))
    mixed = mixture.repeat(store, docs, "doc_id", "text", "source")
    assert mixed.columns == docs.columns
    want = sum(r.copies for r in mixture.op2_entropy_mix(store, docs).collect())
    assert mixed.count() == want


def test_rows_alike_but_for_other_columns_keep_their_own_copies(spark, docs_of, store):
    from collections import Counter

    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)]
    docs = docs_of(rows).withColumn("row_no", F.lit("own"))
    for n, lang in enumerate(("de", "fr", "nl")):
        docs = docs.unionByName(docs_of([(3, "w w w w ", "b"), (None, "w w", "b")]).withColumn("lang", F.lit(lang)).withColumn("row_no", F.lit("own")))
    copies = {}
    for r in mixture.op2_entropy_mix(store, docs).collect():
        copies.setdefault((r.doc_id, r.source, r.size), []).append(r.copies)
    got = Counter((r.doc_id, r.source, len(r.text.split()), r.lang) for r in mixture.repeat(store, docs, "doc_id", "text", "source").collect())
    for (doc_id, source, size), each in copies.items():
        variants = sorted(v for (d, s, z, _), v in got.items() if (d, s, z) == (doc_id, source, size))
        assert variants == sorted(c for c in each if c), (doc_id, source)
    assert len(copies[3, "b", 4]) == 4 and sum(copies[3, "b", 4]) > 1 and sum(copies[None, "b", 2]) > 1


def test_empty_table(docs_of, store):
    assert mixture.op2_entropy_mix(store, docs_of([])).count() == 0
    assert mixture.repeat(store, docs_of([]), "doc_id", "text", "source").count() == 0
    assert [r.taken for r in mixture.op2_entropy_mix(store, docs_of([(1, None), (2, " ")])).collect()] == [0, 0]
