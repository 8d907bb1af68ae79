"""Corpus pipeline: documents through quality, exact and near duplicates, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.  All but the last
return the columns of ``documents``; the mix repeats a document as often as its copies say.

Near duplicates are sets of five-word runs with a similarity of 0.8 or more.  Defined results for nulls, empty
texts, ties, repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, grace, mixture, neardup, quality
from holdfast.llm.tables import free_names, read, store_of

SHINGLE_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the stage's own input, does not reject."""
    weights = quality.train(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    (score,) = free_names(docs, quality.SCORE)
    scored = quality.score(docs, "text", weights, into=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace.deduplicate(store_of(spark), docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(store_of(spark), docs, "doc_id", "text", SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.repeat(store_of(spark), docs, "doc_id", "text", "source")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the text they decode to as a digest."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), "text", "byte_bpe_50k.json")
    return coded.select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe encoding", encode_tokens),
]

#: Training, banding and merging have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents`` table; each result is written and read by the next."""
    store = store_of(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.write(name.replace(" ", "_"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
