"""Near-duplicate groups by min-max hashing.

A text's set holds its distinct runs of ``width`` words.  Under every permutation both the smallest and the
largest value are kept, so one evaluation gives two signature values that agree with probability equal
to the Jaccard similarity.  Bands of ``BAND_ROWS`` values put texts into buckets; a pair at the
threshold of 0.8 shares no bucket with probability below 3e-6.

Equal sets are one node.  First, nodes are gathered into coarse clusters by a sketch of one byte per
signature value: in each bucket a few leaders are compared with the other members that are not yet in
the leader's cluster, buckets within one cluster are done, and the others go on with sixteen times as many
leaders, without those already compared.  So two members of a bucket end up in one cluster or were
compared and are far apart; the work follows the members, not their pairs.

Then links are confirmed on the full sets: those of leaders and members at once, which joins most of a
cluster, and what is left in blocks of bounded size.  Two blocks meet in one task, which gives at
most a link per node; blocks inside one confirmed component do not meet.

Defined results: texts without words, or null, have an empty set and are linked with nothing; a text of
fewer words than ``width`` has its whole sequence as its one element; rows without id take part, but a
component is named by its smallest id; repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.tables import free_names
from holdfast.llm.text import binary_texts, hashed_words, mix, shingles, small_batches
from holdfast.plans.store import TableStore

PERMUTATIONS = 128
BAND_ROWS = 6
BANDS_EACH = PERMUTATIONS // BAND_ROWS
SIMILAR_PERCENT = 80
# Of 256 sketch values 205 agree at the threshold on average; five deviations are 32.
SKETCH_LINK = 172
SKETCH_CLUSTER = 112
BLOCK_ELEMENTS = 60_000
BLOCK_NODES = 600
COLUMNS_AT_ONCE = 4096
ROUNDS = 60

_RANDOM = np.random.default_rng(2_718)
_FACTORS = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _RANDOM.integers(1, 1 << 63, (2 * BANDS_EACH, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGEST_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def distinct_sets(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct runs of every text in one array, and how many each text has."""
    values, owner = shingles(hashes, before, width)
    bounds = np.searchsorted(owner, np.arange(len(before) + 1))
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[start:end].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(before))


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every set under every permutation: (2 * permutations, sets)."""
    out = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    for p, factor in enumerate(_FACTORS):
        permuted = values * factor
        out[p] = np.minimum.reduceat(permuted, starts)
        out[PERMUTATIONS + p] = np.maximum.reduceat(permuted, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band; a band holds values of different permutations, all minima or all maxima."""
    out = np.empty((signature.shape[1], 2 * BANDS_EACH), np.uint64)
    for b in range(2 * BANDS_EACH):
        first = (b % BANDS_EACH) * BAND_ROWS + (PERMUTATIONS if b >= BANDS_EACH else 0)
        rows = signature[first:first + BAND_ROWS]
        out[:, b] = mix((mix(rows) * _BAND_FACTORS[b][:, None]).sum(0, dtype=np.uint64) + np.uint64(b))
    return out.view(np.int64)


def set_rows(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Every row: doc_id, text_key, set_key, n_shingles, bands, sketch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = binary_texts(batch.column(2))
            sizes = np.zeros(len(texts), np.int64)
            keys: list[bytes | None] = [None] * len(texts)
            all_bands: list = [None] * len(texts)
            sketches: list[bytes | None] = [None] * len(texts)
            for first, last, hashes, before in hashed_words(texts):
                values, counts = distinct_sets(hashes, before, width)
                sizes[first:last] = counts
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                starts = (np.cumsum(counts) - counts)[some]
                digest = np.stack([np.add.reduceat(mix(values ^ seed), starts) for seed in _DIGEST_SEEDS], axis=1)
                signature = signatures(values, starts)
                banded, sketch = bands(signature), (signature & np.uint64(0xFF)).astype(np.uint8).T
                for at, i in enumerate(some + first):
                    keys[i], all_bands[i], sketches[i] = digest[at].tobytes(), banded[at], sketch[at].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes),
                pa.array(all_bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ], ["doc_id", "text_key", "set_key", "n_shingles", "bands", "sketch"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "doc_id bigint, text_key bigint, set_key binary, n_shingles bigint, bands array<bigint>, sketch binary"
    )


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """The sorted sets of (node, text) rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets: list[np.ndarray] = []
            for _, _, hashes, before in hashed_words(binary_texts(batch.column(1))):
                values, counts = distinct_sets(hashes, before, width)
                sets += np.split(values.view(np.int64), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, elements array<bigint>")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs whose sketches agree often enough for one cluster; columns a, b, sketch_a, sketch_b."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=4096):
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3)
            )
            agree = (left == right).sum(1)
            counted = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(agree, pa.int32())], ["a", "b", "agree"]
            )
            yield counted.filter(pa.array(agree >= SKETCH_CLUSTER))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint, agree int")


def read_sets(store: TableStore, df: DataFrame, text: str, doc_id: str, nodes: DataFrame, width: int) -> DataFrame:
    """Full sets (node, elements) of some nodes, made again from the documents."""
    wanted = nodes.select("node", "doc_id", "text_key").hint("merge")
    texts = df.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__key"), F.col(text).alias("text"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key"))
    return store.write("sets", full_sets(texts.join(wanted, same), width).dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    whole = F.size("set_a") + F.size("set_b") - F.col("common")
    return (
        pairs.join(left, "a").join(right, "b").withColumn("common", common)
        .filter(100 * F.col("common") >= SIMILAR_PERCENT * whole).select("a", "b")
    )


def groups(store: TableStore, df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Every row: doc_id, text_key, n_shingles, component_id, component, kept.

    ``component`` tells groups apart whatever their ids; it is null for rows with an empty set.
    """
    rows = store.write("set_rows", set_rows(df, doc_id, text, width))
    some = rows.filter("n_shingles > 0")
    nodes = store.write("nodes", some.dropDuplicates(["set_key"]).withColumn("node", F.monotonically_increasing_id()))
    linked = _linked(store, df, doc_id, text, width, nodes)

    first = some.groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    placed = nodes.select("set_key", "node").join(first, "set_key").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "component").select("set_key", "component_id", "component")
    return rows.join(named, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component",
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _clusters(store: TableStore, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Coarse clusters (node, component) and the pairs (a, b, agree) that made them."""
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "node", "n_shingles"
    )
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    open_ = store.write("buckets", banded.join(shared, "bucket"))
    sketches = nodes.select("node", "sketch")
    linked, found = store.spark.createDataFrame([], "node bigint, component bigint"), None
    for level in range(ROUNDS):
        if open_.isEmpty():
            return linked, found
        # Leaders: the smallest node of each of 16^level parts of a bucket.
        part = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << min(4 * level, 40)))
        placed = open_.join(linked, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
        leaders = placed.groupBy("bucket", part.alias("part")).agg(
            F.min(F.struct("node", "n_shingles", "own")).alias("leader")
        )
        leaders = store.write("leaders", leaders.select("bucket", "leader.*").toDF("bucket", "leader", "leader_size", "leader_in"))
        led = placed.join(leaders, "bucket").filter(
            (F.col("own") != F.col("leader_in"))
            & (100 * F.least("n_shingles", "leader_size") >= SIMILAR_PERCENT * F.greatest("n_shingles", "leader_size"))
        )
        pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        near = store.write("near", agreeing(
            pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        ))
        if not near.isEmpty():
            found = near if found is None else found.unionByName(near)
            old = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
            linked = components(store, near.select("a", "b").unionByName(old))
        gone = leaders.select(F.col("bucket").alias("__bucket"), "leader")
        rest = open_.join(gone, (F.col("bucket") == F.col("__bucket")) & (F.col("node") == F.col("leader")), "left_anti")
        rest = rest.join(linked, "node", "left").withColumn("own", F.coalesce("component", "node"))
        mixed = rest.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high")
        mixed = mixed.select(F.col("bucket").alias("__bucket"))
        kept = rest.join(mixed, F.col("bucket") == F.col("__bucket"), "left_semi")
        open_ = store.write("buckets", kept.select("bucket", "node", "n_shingles"))
    raise RuntimeError("buckets were not worked off")


def _linked(store: TableStore, df: DataFrame, doc_id: str, text: str, width: int, nodes: DataFrame) -> DataFrame:
    """Components (node, component) of the confirmed links, for nodes that have any."""
    clusters, pairs = _clusters(store, nodes)
    if pairs is None:
        return clusters
    members = clusters.withColumnRenamed("component", "cluster").join(
        nodes.select("node", "n_shingles", "doc_id", "text_key"), "node"
    )
    sets = read_sets(store, df, text, doc_id, members, width)
    links = store.write("links", confirmed(pairs.filter(F.col("agree") >= SKETCH_LINK).select("a", "b"), sets))
    linked = components(store, links)

    # What is left: clusters of more than one component.
    placed = members.select("node", "cluster", "n_shingles").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    open_ = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = open_.filter("low <> high").select("cluster")
    placed = store.write("placed", placed.join(open_, "cluster"))
    if placed.isEmpty():
        return linked
    more = store.write("block_links", _block_links(store, placed, sets))
    return components(store, links.unionByName(more))


def _block_links(store: TableStore, placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of one cluster, from blocks of about ``BLOCK_ELEMENTS`` elements and
    at most about ``BLOCK_NODES`` sets.

    A component that fills a block has blocks of its own, and those do not meet each other.
    """
    placed = placed.withColumn("cost", F.greatest("n_shingles", F.lit(BLOCK_ELEMENTS // BLOCK_NODES)))
    sizes = placed.groupBy("cluster", "component").agg(F.sum("cost").alias("elements"))
    own = F.when(F.col("elements") >= BLOCK_ELEMENTS, F.col("component")).otherwise(F.lit(-1))
    tagged = placed.join(sizes, ["cluster", "component"]).withColumn("tag", own)
    parts = tagged.groupBy("cluster", "tag").agg(
        F.ceil(F.sum("cost") / BLOCK_ELEMENTS).cast("int").alias("parts")
    )
    draw = F.xxhash64("node", F.lit(23))
    blocks = tagged.join(parts, ["cluster", "tag"]).select(
        "cluster", "node", "tag", F.pmod(draw, F.col("parts")).cast("int").alias("part")
    )
    blocks = store.write("blocks", blocks)
    kinds = blocks.select("cluster", "tag", "part").distinct()
    other = kinds.toDF("cluster", "tag_b", "part_b")
    ordered = (F.col("tag") < F.col("tag_b")) | ((F.col("tag") == F.col("tag_b")) & (F.col("part") <= F.col("part_b")))
    meets = (F.col("tag") != F.col("tag_b")) | (F.col("tag") == -1)
    # Pairs of blocks, not of rows: a cluster has a block per BLOCK_ELEMENTS elements.
    meetings = kinds.join(other, "cluster").filter(ordered & meets).select(
        "cluster", F.struct("tag", "part").alias("left"), F.struct("tag_b", "part_b").alias("right"),
        F.xxhash64("cluster", "tag", "part", "tag_b", "part_b").alias("meeting"),
    )
    sides = meetings.select("cluster", "meeting", F.explode(F.array_distinct(F.array(
        F.col("left"), F.struct(F.col("right.tag_b").alias("tag"), F.col("right.part_b").alias("part"))
    ))).alias("block")).select("cluster", "meeting", "block.*")
    rows = sides.join(blocks, ["cluster", "tag", "part"]).select("meeting", "node").join(sets, "node")

    def link(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        elements = [np.asarray(e, np.int64) for e in table["elements"].to_pylist()]
        first = first_linked(elements)
        linked = first != np.arange(len(nodes))
        return pa.table({"a": pa.array(nodes[linked]), "b": pa.array(nodes[first[linked]])})

    return rows.select("meeting", "node", "elements").groupBy("meeting").applyInArrow(link, "a bigint, b bigint")


def first_linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its component under the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2^24 are exact
    for start in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, (start, start + COLUMNS_AT_ONCE))
        present = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        present[owner[low:high], column[low:high] - start] = 1
        common += present @ present.T
    similar = 100 * common >= SIMILAR_PERCENT * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(similar, True)
    first = np.arange(len(sets))
    while True:
        lower = np.where(similar, first[None, :], len(sets)).min(1)
        lower = lower[lower]
        if (lower == first).all():
            return first
        first = lower


def one_of_each(store: TableStore, df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """The rows of ``df`` that stay, one of each group and all with an empty set, with all their columns.

    Of a group stays the smallest id, nulls last, and of its texts the one with the smallest hash; of rows alike
    in both, any one.
    """
    rows = store.write("near_groups", groups(store, df, doc_id, text, width)).filter("n_shingles > 0")
    id_, key = free_names(df, "__id", "__key")
    first = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    ).select(F.col("first.doc_id").alias(id_), F.col("first.text_key").alias(key), F.lit(True).alias("stays"))
    # One text is in one group, so id and text name the group too.
    alike = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    is_first = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("text_key") == F.col(key))
    alike = store.write("near_rows", alike.join(first, is_first, "left").select("doc_id", "text_key", "n", "stays"))
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key))
    keys = [F.col("doc_id").alias(id_), F.col("text_key").alias(key)]
    kept = df.join(alike.filter("stays is null").select(*keys), same, "left_anti")
    again = alike.filter("stays and n > 1").select(*keys)
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(again, same, "left_anti").unionByName(repeated)


def op7_minmax_near_dedup(store: TableStore, documents: DataFrame, width: int = 2) -> DataFrame:
    return groups(store, documents, "doc_id", "text", width).select("doc_id", "n_shingles", "component_id", "kept")
