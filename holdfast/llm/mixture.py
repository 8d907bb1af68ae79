"""Mixing sources to target weights by entropy balancing.

Documents get rates as close to one copy as possible, in relative entropy, such that each source's
expected words equal its target and no rate exceeds the cap.  The solution tilts exponentially: a
document with ``size`` words has the rate min(cap, exp(dual * size / mean size of its source)).  The
convex dual is solved by Newton steps; each step is one distributed aggregate over cells of equal
(source, size), which share a rate.  Steps outside the bracket known so far are replaced by halving.

The rates are rounded into whole copies cell by cell, from large sizes to small: each cell takes the
number of copies that brings the source's words nearest to the running sum of the exact rates, so what
one cell misses the next ones make up.  In a cell, the documents that get one copy more are the first
by hash.

Targets: the n-th source by code point (null last) weighs 1, 2, 3, repeating, and gets that share of
all words; a target stops at ``cap`` times its source's words, the excess going to the others by weight.

Everything is summed in whole numbers or decimals, so reruns agree whatever the order of tasks.

Defined results: a null text has no words and takes none; a source without words has target 0; an empty
table gives no rows; repeated rows are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import free_names
from holdfast.operators.ranking import ROW_NO, Key, number_rows
from holdfast.plans.store import TableStore

CAP = 3
WEIGHTS = (1, 2, 3)
STEPS = 60
GAP = 1e-9
_MONEY = "decimal(38,9)"


def words(text: Column) -> Column:
    """Runs of characters outside space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(store: TableStore, rows: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per source: source_key, source_null, docs, source_size, target."""
    totals = rows.groupBy("source_null", "source_key").agg(
        F.count("*").alias("docs"), F.sum("size").alias("source_size")
    )
    numbered = number_rows(store, "sources", totals, [Key("source_null"), Key("source_key")]).frame
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col(ROW_NO) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = store.write("sources", numbered.withColumn("weight", weight).drop(ROW_NO))

    # Filling up: a source whose share exceeds its limit is fixed there, and the shares are dealt anew.
    # Fixed sources are exactly those with the smallest limit per weight, so one number tells them.
    every = sources.agg(F.sum("source_size").alias("words")).first()["words"] or 0
    level = -1.0
    while True:
        limit = F.col("source_size") * cap
        fixed = limit <= F.col("weight") * level
        part = sources.agg(
            F.sum(F.when(fixed, limit)).alias("fixed"), F.sum(F.when(~fixed, F.col("weight"))).alias("weights"),
        ).first()
        share = (every - (part["fixed"] or 0)) / part["weights"] if part["weights"] else math.inf
        if share <= level or not part["weights"]:
            break
        level = share
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", target if every else F.lit(0.0))


def solve(store: TableStore, cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds the dual of each source by safeguarded Newton steps on the cells (source, size, n)."""
    keys = ["source_null", "source_key"]
    duals = sources.select(
        *keys, "target", (F.col("source_size") / F.col("docs")).alias("mean"),
        (F.col("target") >= F.col("source_size") * cap).alias("at_cap"),
        F.lit(0.0).alias("dual"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(1.0).alias("gap"),
    )
    for _ in range(STEPS):
        rate = rate_of(cap)
        words_taken = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words_taken * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        state = cells.join(duals, keys).groupBy(*keys).agg(
            *(F.first(c).alias(c) for c in ("target", "mean", "at_cap", "dual", "low", "high")),
            F.sum(words_taken.cast(_MONEY)).cast("double").alias("taken"),
            F.sum(slope.cast(_MONEY)).cast("double").alias("slope"),
        )
        miss = F.col("taken") - F.col("target")
        state = state.withColumns({
            "low": F.when(miss < 0, F.col("dual")).otherwise(F.col("low")),
            "high": F.when(miss > 0, F.col("dual")).otherwise(F.col("high")),
            "gap": F.when(F.col("at_cap") | (F.col("target") <= 0), 0.0).otherwise(
                F.abs(miss) / F.greatest("target", F.lit(1.0))
            ),
        })
        newton = F.col("dual") - miss / F.col("slope")
        middle = (
            F.when(F.col("high") == math.inf, F.col("low") + F.abs("low") + 1.0)
            .when(F.col("low") == -math.inf, F.col("high") - F.abs("high") - 1.0)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("dual")) <= 4.0)
        step = F.when(F.col("gap") <= GAP, F.col("dual")).when(inside, newton).otherwise(middle)
        duals = store.write("duals", state.withColumn("dual", step).select(*duals.columns))
        worst = duals.agg(F.max("gap")).first()[0]
        if worst is None or worst <= GAP:
            return duals
    raise RuntimeError(f"a source's words are still {worst:.3g} of its target away after {STEPS} steps")


def rate_of(cap: int) -> Column:
    """The tilted rate of a cell joined with its source's dual."""
    tilt = F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))
    return F.when(F.col("at_cap"), F.lit(float(cap))).when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.round(F.exp(tilt), 12)
    )


def round_cells(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """Whole copies of each cell: ``copies`` for each of its documents, one more for the first ``extra``.

    One group is one source's cells, at most as many as there are text lengths, never its documents.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in frames:
            cell = cell.sort_values("size", ascending=False)
            size, n = cell["size"].to_numpy(), cell["n"].to_numpy()
            exact = np.cumsum(n * size * cell["rate"].to_numpy())
            taken, copies = 0, np.zeros(len(cell), np.int64)
            for i in range(len(cell)):
                if size[i]:
                    copies[i] = min(max(round((exact[i] - taken) / size[i]), 0), cap * n[i])
                    taken += int(copies[i] * size[i])
                else:
                    copies[i] = n[i]
            yield cell.assign(copies=copies // n, extra=copies % n)[
                ["source_null", "source_key", "size", "first_row", "copies", "extra", "rate"]
            ]

    return cells.groupBy("source_null", "source_key").applyInPandas(
        lambda cell: next(run(iter([cell]))),
        "source_null int, source_key string, size bigint, first_row bigint, copies bigint, extra bigint, rate double",
    )


def mix(store: TableStore, df: DataFrame, doc_id: str, text: str, source: str, cap: int = CAP) -> DataFrame:
    """Every document: doc_id, text_key, source, size, source_size, target, rate, copies, taken."""
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.col(source).isNull().cast("int").alias("source_null"),
        F.coalesce(F.col(source), F.lit("")).alias("source_key"),
        words(F.col(text)).alias("size"),
    ).withColumn("draw", F.xxhash64("doc_id", "text_key", F.lit(29)))
    rows = store.write("sized", rows)
    sources = store.write("targets", source_targets(store, rows, cap))
    # Equal (source, size) lie next to each other in one order, split by hash; the first row of a cell gives ranks.
    order = [Key(k) for k in ("source_null", "source_key", "size", "draw", "doc_id")]
    numbered = number_rows(store, "documents", rows, order).frame
    keys = ["source_null", "source_key"]
    cells = store.write("cells", numbered.groupBy(*keys, "size").agg(
        F.count("*").alias("n"), F.min(ROW_NO).alias("first_row")
    ))
    duals = solve(store, cells, sources, cap)
    rated = cells.join(duals.select(*keys, "dual", "mean", "at_cap"), keys).withColumn("rate", rate_of(cap))
    rounded = store.write("rounded", round_cells(rated.select(*keys, "size", "n", "first_row", "rate"), cap))
    extra = (F.col(ROW_NO) - F.col("first_row") < F.col("extra")).cast("bigint")
    return (
        numbered.join(rounded, [*keys, "size"])
        .join(sources.select(*keys, "source_size", "target"), keys)
        .withColumn("copies", F.col("copies") + extra)
        .select(
            "doc_id", "text_key", F.when(F.col("source_null") == 0, F.col("source_key")).alias("source"),
            "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def repeat(store: TableStore, df: DataFrame, doc_id: str, text: str, source: str, cap: int = CAP) -> DataFrame:
    """The mix itself: rows of ``df`` with all their columns, each as often as its copies say.

    Rows alike in id, text and source have copies that differ by one at most; which of them have one more is
    settled by a hash of all columns.
    """
    key, times, rows, draw, place, row, of, first_row, copy = free_names(
        df, "__key", "__times", "__rows", "__draw", "__place", "__row", "__of", "__first", "__copy"
    )
    copies = mix(store, df, doc_id, text, source, cap).groupBy("doc_id", "text_key", "source").agg(
        F.sum("copies").alias(times), F.count("*").alias(rows)
    ).filter(F.col(times) > 0)
    wanted = store.write("copies", copies.select(F.struct("doc_id", "text_key", "source").alias(key), times, rows))
    same = F.struct(F.col(doc_id), F.xxhash64(text), F.col(source)).eqNullSafe(F.col(key))
    taken = df.join(wanted, same)
    single = taken.filter(F.col(rows) == 1).select(*df.columns, times)
    if not wanted.filter(F.col(rows) > 1).isEmpty():
        # Rows alike in everything are told apart by where they stand, so a hot one is still numbered by many tasks.
        alike = taken.filter(F.col(rows) > 1).select(
            key, F.xxhash64(*df.columns).alias(draw), F.monotonically_increasing_id().alias(place),
            F.struct(*df.columns).alias(row), times, rows,
        )
        numbered = number_rows(store, "alike", alike, [Key(key), Key(draw), Key(place)]).frame
        first = numbered.groupBy(F.col(key).alias(of)).agg(F.min(ROW_NO).alias(first_row))
        more = (F.col(ROW_NO) - F.col(first_row) < F.col(times) % F.col(rows)).cast("bigint")
        each = numbered.join(first, F.col(key).eqNullSafe(F.col(of))).select(
            f"{row}.*", (F.floor(F.col(times) / F.col(rows)) + more).alias(times)
        )
        single = single.unionByName(each.filter(F.col(times) > 0))
    return single.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(*df.columns)


def op2_entropy_mix(store: TableStore, documents: DataFrame) -> DataFrame:
    return mix(store, documents, "doc_id", "text", "source").select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate"
    )
