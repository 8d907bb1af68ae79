from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from holdfast.llm.tables import tokenizer_file

from test_neardup import brute as near_groups

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, store):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = docs.filter("doc_id < 3").withColumns({"doc_id": F.col("doc_id") + 5000, "source": F.lit(None).cast("string")})
    docs = docs.unionByName(extra).unionByName(docs.filter("doc_id = 7"))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(6000).cast("bigint"), "text": F.lit(None).cast("string")}))
    out = [store.write("stage", docs)]
    for _, stage in pipeline.STAGES:
        out.append(store.write("stage", stage(spark, out[-1], SF_DIR)))
    return out


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_quality_keeps_good_and_rejects_bad(spark, stages):
    kept = {d for d, _ in rows_of(stages[1])}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in labels)
    assert right >= 0.95 * len(labels)


def test_exact_copies(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    best = {}
    for doc_id, text in before:
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best[content] = min(best.get(content, (1, 0)), (-len(text or ""), doc_id))
    assert sorted(d for d, _ in after) == sorted(d for _, d in best.values())


def test_near_copies(stages):
    want = [d for d, _, _, kept in near_groups(rows_of(stages[2]), 5) if kept]
    assert sorted(d for d, _ in rows_of(stages[3])) == sorted(want)


def test_mix(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    words = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert {d for d, _ in after} <= {d for d, _ in before}
    assert abs(words(after) - words(before)) <= 0.05 * words(before)
    assert max(after.count(r) for r in set(after)) <= 3


def test_encoding(stages):
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = sorted((d, library.encode(t or "", add_special_tokens=False).ids, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows_of(stages[4]))
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in stages[5].collect()) == want


def test_empty_table(spark, store, docs_of):
    docs = docs_of([])
    for _, stage in pipeline.STAGES:
        docs = store.write("stage", stage(spark, docs, SF_DIR))
        assert docs.count() == 0


CLASHING = (
    "__id", "__key", "__same", "__times", "__rows", "__draw", "__place", "__row", "__of", "__first", "__copy", "__score",
    "__bucket", "component", "component_id", "node", "kept", "hash", "content", "rows", "copies", "size", "n", "stays", "digest",
)


def test_clashing_names(spark, store):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3))
    for n, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(n))
    for name, stage in pipeline.STAGES[:-1]:
        docs = store.write("clash", stage(spark, docs, SF_DIR))
        row = docs.first()
        assert [row[c] for c in CLASHING] == list(range(len(CLASHING))), name
    assert pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()
