from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from holdfast.llm import grace

TEXTS = [
    (1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "c"), (7, "c"), (8, "é é"), (None, "éé "),
    (9, "a\xa0b"), (10, "long " * 30_000), (11, "long " * 30_000 + " "), (12, "AB"), (13, "ab\x0b\x0c\r"),
]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(d, keep[0], len(members), (d, p) == keep, sha) for d, p in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [grace.TABLE_BYTES, 450])
def test_like_brute_force(docs_of, store, budget):
    rows = TEXTS + [(100 + i, f"text {i % 37}" + " " * (i % 5)) for i in range(300)]
    docs = docs_of(rows).withColumn("digest", F.lit("clash")).repartition(3)
    got = grace.op10_exact_dedup(store, docs, budget).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_rows_that_stay(docs_of, store):
    docs = docs_of(TEXTS).withColumn("hash", F.lit(1))
    got = grace.deduplicate(store, docs, "doc_id", "text")
    assert got.columns == docs.columns
    want = {(d, sha) for d, _, _, kept, sha in brute(TEXTS) if kept}
    assert len(want) == got.count()
    assert {r.doc_id for r in got.collect()} == {d for d, _ in want}


def test_empty_table(docs_of, store):
    assert grace.op10_exact_dedup(store, docs_of([])).count() == 0
    assert grace.deduplicate(store, docs_of([]), "doc_id", "text").count() == 0


def test_sql_form(spark, store):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(grace.OP10_SQL).fetchall()
    got = grace.op10_exact_dedup(store, spark.read.parquet(path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_table_compares_contents_under_one_hash():
    table = grace.OpenAddressingTable(1000)
    for content in (b"x", b"y", b"z"):
        entry, slot = table.find(7, content)
        assert entry == -1
        table.insert(slot, 7, content, (0, False, 1), 1, 1)
    assert [table.find(7, c)[0] for c in (b"x", b"y", b"z", b"w")] == [0, 1, 2, -1]
