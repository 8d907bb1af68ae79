from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.llm import neardup
from holdfast.llm.components import components


def brute(rows, width=2):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        runs = {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()
        sets.append(runs)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        smallest[r] = doc_id if smallest.get(r) is None else min(smallest[r], doc_id if doc_id is not None else smallest[r])
    return sorted(
        ((d, len(s), smallest[root(i)], d == smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts = [fresh(rng.choice([3, 5, 6, 12, 40, 120])) for _ in range(n)]
    base = fresh(60)
    for _ in range(120):  # chains and clusters around the threshold
        words = list(rng.choice([base, rng.choice(texts)]))
        for _ in range(rng.randrange(0, 1 + max(1, len(words) // 7))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


SPECIAL = [
    (1000, None), (1001, ""), (1002, " \n"), (1003, "Solo"), (1004, "sOLO"), (1005, "solo "), (1006, "É x"), (1007, "é x"),
    (None, "no id here at all"), (1008, "no id here at all"), (1009, "same row"), (1009, "same row"), (1010, "a b " * 40_000),
    (1011, "b a " * 40_000),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(docs_of, store, seed):
    rows = corpus(seed) + SPECIAL
    docs = docs_of(rows).withColumn("node", F.lit("clash")).withColumn("bands", F.lit(1)).repartition(3)
    got = neardup.op7_minmax_near_dedup(store, docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_of_each_group_stays(docs_of, store):
    rows = corpus(5, 60) + SPECIAL
    docs = docs_of(rows).withColumn("__in", F.lit(1))
    got = neardup.one_of_each(store, docs, "doc_id", "text", 2)
    assert got.columns == docs.columns
    want = {d for d, _, _, kept in brute(rows) if kept}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_rows_without_id_and_one_id_on_unlike_texts_stay(docs_of, store):
    long = " ".join(f"w{i}" for i in range(60))
    near, far = long.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [
        (None, "first text without id"), (None, "another one, unlike it"), (None, ""), (None, None), (None, ""),
        (1, long), (1, far), (2, near), (3, far + " end"), (None, "linked without id"), (None, "linked without id"),
    ]
    got = neardup.one_of_each(store, docs_of(rows), "doc_id", "text", 2).collect()
    want = [*rows[:7], (None, "linked without id")]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(docs_of, store):
    assert neardup.op7_minmax_near_dedup(store, docs_of([])).count() == 0
    assert neardup.op7_minmax_near_dedup(store, docs_of([(1, None)])).collect()[0][:] == (1, 0, 1, True)


@pytest.mark.parametrize("part_links", [7, 1_000_000])
def test_components_of_paths_and_stars(spark, store, monkeypatch, part_links):
    monkeypatch.setattr("holdfast.llm.components.PART_LINKS", part_links)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(components(store, spark.createDataFrame(links, "a long, b long").repartition(20)).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
