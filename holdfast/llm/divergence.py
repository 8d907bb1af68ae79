"""Divergence audit of a language's sources by smoothed term shares.

Terms are counted per (lang, source).  Each language keeps the terms of at least ``MIN_DOCS`` of its
documents, V of them, and every group gives a kept term the share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), where N is the group's count over kept terms.

*Terms of a group*: how far a term's share in the group lies above its share in the language depends on two
numbers only, its count here and its count in the language.  Terms are grouped into such cells, the value is
computed once a cell, cells of one value are merged, and the values are ranked with the number of their terms
running along.  Only the values that begin within the first ``TOP`` ranks are expanded into terms again, in UTF-8
order.

*Pairs of sources* sum the distance of shares over all kept terms.  A term that neither source has gives
the same distance each time, so only terms that occur are looked at: chunks of them meet the sources, in tiles of
bounded size, as whole-number matrices, and give one partial sum per pair and chunk.

Counts are combined before every shuffle, so a group with a third of all texts fills no task.  All arithmetic is on
whole numbers, decimals where a product may leave 64 bits.

Defined results: null text, lang and source count as empty strings; every group that occurs has its pairs, also
without any term; without kept terms all values are 0; a language with one source has no pairs; ties go by
UTF-8 order; repeated rows count as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.store import TableStore

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
UNIT = 1_000_000_000
#: Everything but letters and characters beyond ASCII separates terms.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
TILE_SOURCES = 256
CHUNK_ROWS = 200_000
_BLOCK_CELLS = 1 << 20


def terms_of(text: Column) -> Column:
    """All terms of a text, A-Z in lower case."""
    # Of ASCII alone, lower case is that of A-Z; elsewhere only A-Z may change.
    plain = F.char_length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BREAKS), "")


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n occurrences, docs that have it."""
    rows = df.select(
        *(F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))),
        F.sort_array(terms_of(F.coalesce(F.col(text), F.lit("")))).alias("terms"),
    )
    # Sorted, a document's first of equal terms is told by its neighbour.
    each = rows.select("lang", "source", "terms", F.posexplode("terms").alias("at", "term"))
    first = (F.col("at") == 0) | (F.get("terms", F.col("at") - 1) != F.col("term"))
    return each.select("lang", "source", "term", first.cast("int").alias("first")).groupBy("lang", "source", "term").agg(
        F.count("*").alias("n"), F.sum("first").alias("docs")
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly; needs a kept term."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + SMOOTH * kept).cast("decimal(20,0)")
    return F.call_function("div", over, under) + F.lit(1).cast("bigint")


def kept_terms(store: TableStore, counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n and lang_n, the count in the language, for kept terms."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = whole.filter(F.col("docs") >= min_docs).drop("docs")
    return store.write("kept_terms", counts.drop("docs").join(kept, ["lang", "term"]))


def group_totals(store: TableStore, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group: lang, source, total, v (kept terms of the language) and lang_total."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    once = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    whole = once.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    return store.write("group_totals", groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "v", "lang_total"))
    ))


def term_part(store: TableStore, kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` terms of every group whose share exceeds that of the language."""
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("terms"))
    here, there = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    cells = cells.join(totals, group).select(*group, "n", "lang_n", "terms", (here - there).alias("value"))
    cells = store.write("count_cells", cells.filter("value > 0"))

    values = cells.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    falling = Window.partitionBy(*group).orderBy(F.col("value").desc())
    # Each value has a term at least, so the first ranks lie among as many values.
    values = values.withColumn("place", F.row_number().over(falling)).filter(F.col("place") <= top)
    ahead = F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("ahead") < top)

    open_cells = cells.drop("terms").join(values.select(*group, "value", "ahead"), [*group, "value"])
    expanded = kept.join(open_cells, [*group, "n", "lang_n"])
    by_term = Window.partitionBy(*group, "value").orderBy("term")
    ranked = expanded.withColumn("place", F.row_number().over(by_term)).filter(F.col("place") <= top)
    return ranked.withColumn("rank", (F.col("ahead") + F.col("place")).cast("int")).filter(F.col("rank") <= top).select(
        *group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"
    )


def partial_distances(
    terms: np.ndarray, place: np.ndarray, shares: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Sums of |p - q| over the given terms, for each source of ``left`` and each of ``right``.

    Entry i says that term ``terms[i]`` has the share ``shares[i]`` in source ``place[i]``; all others have ``base``.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    names, row = np.unique(terms, return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, place, shares = row[order], place[order], shares[order]
    step = max(1, _BLOCK_CELLS // max(len(base), 1))
    for start in range(0, len(names), step):
        low, high = np.searchsorted(row, (start, start + step))
        block = np.repeat(base[:, None], min(step, len(names) - start), axis=1)
        block[place[low:high], row[low:high] - start] = shares[low:high]
        there = block[right]
        for i, one in enumerate(left):
            out[i] += np.abs(there - block[one]).sum(1)
    return out


def pair_part(store: TableStore, kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources by the distance of their shares."""
    base = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.when(F.col("v") > 0, F.col("v")))).otherwise(0)
    sources = totals.withColumn("base", base)
    most = totals.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tiles = -(-most // TILE_SOURCES) or 1
    tile = F.pmod(F.xxhash64("source", F.lit(31)), F.lit(tiles)).cast("int")
    sources = store.write("audit_sources", sources.withColumn("tile", tile))
    chunks = -(-kept.count() * 2 // CHUNK_ROWS) or 1
    chunk = F.pmod(F.xxhash64("term", F.lit(37)), F.lit(chunks)).cast("int")

    # A tile's rows go to its meetings: itself, and every tile before and behind it.
    def meetings(rows: DataFrame, tile: str, mark: str) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
        low, high = F.least(tile, "other").alias(f"low{mark}"), F.greatest(tile, "other").alias(f"high{mark}")
        return rows.select("*", other).select(*rows.columns, low, high)

    def keys(mark: str) -> list[str]:
        return [f"lang{mark}", f"low{mark}", f"high{mark}", f"chunk{mark}"]

    shares = kept.join(sources.select("lang", "source", "total", "v", "tile"), ["lang", "source"]).select(
        "lang", "source", "term", "tile", chunk.alias("chunk"), share(F.col("n"), F.col("total"), F.col("v")).alias("p")
    )
    every = sources.select(
        *(F.col(c).alias(f"{c}_") for c in ("lang", "source", "tile", "base")),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk_"),
    )

    def meet(key: tuple, entries: pa.Table, held: pa.Table) -> pa.Table:
        lang, low, high, _ = (k.as_py() for k in key)
        held = held.sort_by("source_")
        names, of, base = held["source_"].to_pylist(), held["tile_"].to_numpy(), held["base_"].to_numpy()
        place = {name: i for i, name in enumerate(names)}
        left, right = np.flatnonzero(of == low), np.flatnonzero(of == high)
        terms = pc.dictionary_encode(entries["term"].combine_chunks())
        terms = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy()
        where = np.array([place[s] for s in entries["source"].to_pylist()], np.int64)
        sums = partial_distances(terms, where, entries["p"].to_numpy(), base, left, right).ravel()
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        given = np.flatnonzero((a < b) | (low != high))
        return pa.table({
            "lang": pa.array([lang] * len(given), pa.string()),
            "a": pa.array([names[i] for i in a[given]], pa.string()), "b": pa.array([names[i] for i in b[given]], pa.string()),
            "sum": pa.array(sums[given], pa.int64()), "seen": pa.array([len(np.unique(terms))] * len(given), pa.int64()),
            "base_a": pa.array(base[a[given]], pa.int64()), "base_b": pa.array(base[b[given]], pa.int64()),
        })

    left, right = meetings(shares, "tile", ""), meetings(every, "tile_", "_")
    parts = left.groupBy(*keys("")).cogroup(right.groupBy(*keys("_"))).applyInArrow(
        meet, "lang string, a string, b string, sum bigint, seen bigint, base_a bigint, base_b bigint"
    )
    pairs = parts.groupBy("lang", "a", "b").agg(
        F.sum("sum").alias("sum"), F.sum("seen").alias("seen"), F.first("base_a").alias("base_a"), F.first("base_b").alias("base_b")
    )
    kept_of = totals.groupBy("lang").agg(F.max("v").alias("v"))
    pairs = pairs.join(kept_of, "lang")
    unseen = (F.col("v") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b"))
    pairs = store.write("source_pairs", pairs.select("lang", "a", "b", (F.col("sum") + unseen).alias("value")))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    order = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), "b")  # a row per source of the language
    return both.select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value",
        F.row_number().over(order).cast("int").alias("rank"),
    )


def audit(
    store: TableStore, df: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part, item, value, rank: the pairs of sources and the leading terms of every group."""
    counts = store.write("term_counts", term_counts(df, text, lang, source))
    groups = df.select(*(
        F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))
    )).distinct()
    kept = kept_terms(store, counts, min_docs)
    totals = group_totals(store, groups, kept)
    return pair_part(store, kept, totals).unionByName(term_part(store, kept, totals, top))


def op11_count_cells(store: TableStore, documents: DataFrame) -> DataFrame:
    return audit(store, documents, "text", "lang", "source")


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p,
         1 + (1000000000 * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN totals t USING (lang, source) JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)
  FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
