"""Distinct customers from bitmaps against sets."""

from __future__ import annotations

import random

from holdfast.operators import bitmaps


def test_rollups_equal_sets(spark, store):
    rng = random.Random(1)
    months = ["2000-01", "2000-02", "2000-03", "2000-07", "2001-12", "2002-01"]
    rows = sorted({(f"c{rng.randrange(60)}", rng.choice(months)) for _ in range(200)})
    rows = [(c, m, rng.choice(["low", "high"])) for c, m in rows]
    frame = spark.createDataFrame(rows, "customer_id string, snapshot_month string, tier string")
    # Numbers far apart, so that several ranges take part.
    numbers = spark.createDataFrame(
        [(c, 1 + i * 9001) for i, c in enumerate(sorted({r[0] for r in rows}))], "customer_id string, customer_number bigint"
    )
    bits = bitmaps.monthly_bitmaps(frame, numbers, "tier")
    assert bits.select("range").distinct().count() > 5
    got = {(r.kind, r.period, r.tier): r.customers for r in bitmaps.distinct_rollups(bits, "tier").collect()}

    want: dict[tuple, set] = {}
    order = [f"{y}-{m:02}" for y in (2000, 2001, 2002) for m in range(1, 13)]
    present = {m for _, m, _ in rows}
    for customer, month, tier in rows:
        at = order.index(month)
        periods = [("month", month), ("quarter", f"{month[:4]}-Q{(int(month[5:]) + 2) // 3}"), ("year", month[:4]), ("all", "All")]
        periods += [("trailing_3_months", order[at + n]) for n in range(3) if order[at + n] in present]
        for kind, period in periods:
            for t in (tier, "All"):
                want.setdefault((kind, period, t), set()).add(customer)
    for month in present:
        before = order[order.index(month) - 1] if order.index(month) else None
        both = {c for c, m, _ in rows if m == month} & {c for c, m, _ in rows if m == before}
        if both:
            want["retained", month, "All"] = both
    assert got == {k: len(v) for k, v in want.items()}


def test_numbers_are_whole_and_dense(spark, store):
    frame = spark.range(1000).selectExpr("concat('c', id) as customer_id").repartition(5)
    numbers = [r.customer_number for r in bitmaps.customer_numbers(store, frame).collect()]
    assert sorted(numbers) == list(range(1, 1001))


def test_no_customers(spark, store):
    frame = spark.createDataFrame([], "customer_id string, snapshot_month string, tier string")
    bits = bitmaps.monthly_bitmaps(frame, bitmaps.customer_numbers(store, frame), "tier")
    assert bitmaps.distinct_rollups(bits, "tier").count() == 0
