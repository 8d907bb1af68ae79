from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from holdfast.llm import shards

TEXTS = [(1, None), (2, ""), (2, ""), (None, "n"), (3, "é" * 1000), *((i, "t" * (i % 90)) for i in range(4, 700))]


def test_sizes_are_near_and_positions_have_no_gaps(docs_of, store):
    docs = docs_of(TEXTS).withColumn("slot", F.lit("clash"))
    got = shards.op6_virtual_slots(store, docs, shards=5).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in TEXTS
    )
    for shard in range(5):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    loads = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(loads) - min(loads) <= 100
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    again = shards.op6_virtual_slots(store, docs.repartition(7), shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rebalancing_edits_the_map():
    rng = random.Random(3)
    sizes = {s: rng.randrange(1, 1000) for s in range(4096)}
    first = shards.first_map(sizes, 8)
    grown = shards.rebalance(first, sizes, 9)
    moved = [s for s in range(4096) if first.shard_of[s] != grown.shard_of[s]]
    assert grown.version == 2 and 0 < len(moved) < 4096 / 4
    loads = grown.loads(sizes)
    assert max(loads) <= 1.06 * sum(loads) / 9 and min(loads) >= 0.9 * sum(loads) / 9
    shrunk = shards.rebalance(grown, sizes, 8)
    assert max(shrunk.shard_of) == 7 and max(shrunk.loads(sizes)) <= 1.06 * sum(loads) / 8
    hot = sizes | {0: 200_000}
    cooled = shards.rebalance(first, hot)
    before, after = first.loads(hot), cooled.loads(hot)
    assert max(after) < max(before)


def test_versions_are_kept(spark, store, tmp_path):
    folder = f"{tmp_path}/map"
    first = shards.first_map({}, 3, slots=64)
    second = shards.rebalance(first, {s: 1 for s in range(64)}, 4)
    shards.save_map(spark, first, folder)
    shards.save_map(spark, second, folder)
    assert shards.load_map(spark, folder, 1) == first
    assert shards.load_map(spark, folder, 2) == second


def test_empty_table(docs_of, store):
    assert shards.op6_virtual_slots(store, docs_of([])).count() == 0
