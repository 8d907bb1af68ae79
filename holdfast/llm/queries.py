"""The queries of this subpackage, by name: each reads its whole table and applies one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import (
    bpe, dac, divergence, grace, hardneg, mixture, neardup, pivots, prefix_bpe, quality, secrets, shards,
)
from holdfast.llm.tables import read, split_pattern, store_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality": lambda spark, sf_dir: quality.op1_quality(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ),
    "op2_entropy_mix": lambda spark, sf_dir: mixture.op2_entropy_mix(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op3_directly_addressable_codes": lambda spark, sf_dir: dac.op3_directly_addressable_codes(
        store_of(spark), read(spark, sf_dir, "documents"), "word_bpe_49k.json"
    ),
    "op4_bpe_encode_decode": lambda spark, sf_dir: bpe.op4_bpe_encode_decode(
        read(spark, sf_dir, "documents"), "byte_bpe_50k.json"
    ),
    "op5_owner_frequency": lambda spark, sf_dir: secrets.op5_owner_frequency(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op6_virtual_slots": lambda spark, sf_dir: shards.op6_virtual_slots(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op7_minmax_near_dedup": lambda spark, sf_dir: neardup.op7_minmax_near_dedup(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op8_token_counts": lambda spark, sf_dir: bpe.op8_token_counts(
        read(spark, sf_dir, "documents"), "byte_bpe_50k.json"
    ),
    "op9_pivot_top_k": lambda spark, sf_dir: pivots.op9_pivot_top_k(
        store_of(spark), read(spark, sf_dir, "embeddings")
    ),
    "op10_exact_dedup": lambda spark, sf_dir: grace.op10_exact_dedup(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op11_count_cells": lambda spark, sf_dir: divergence.op11_count_cells(
        store_of(spark), read(spark, sf_dir, "documents")
    ),
    "op12_prefix_dp": lambda spark, sf_dir: prefix_bpe.op12_prefix_dp(
        read(spark, sf_dir, "documents"), "byte_bpe_50k.tiktoken", split_pattern()
    ),
    "op13_one_bit_negatives": lambda spark, sf_dir: hardneg.op13_one_bit_negatives(
        store_of(spark), read(spark, sf_dir, "embeddings")
    ),
}

ORACLE_SQL: dict[str, str] = {
    "op9_pivot_top_k": pivots.OP9_SQL,
    "op10_exact_dedup": grace.OP10_SQL,
    "op11_count_cells": divergence.OP11_SQL,
    "op13_one_bit_negatives": hardneg.OP13_SQL,
}
