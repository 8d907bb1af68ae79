"""Input tables, tokenizer files and written tables of the operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from holdfast.plans.store import TableStore


#: Python workers are reused by stage after stage, so what a task frees must go back to the machine: a fixed
#: threshold for giving back, few arenas, and Arrow on the same allocator.  Blocks of a few MB stay on the heap, as
#: mapping them anew for every array costs more time than the arrays' work.
WORKER_MEMORY = {
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(32 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(64 << 20),
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver has it; a cluster has it installed or ships it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The split pattern that belongs to the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def locate(path: str) -> str:
    """A vocabulary file on this machine: a path as it is, a bare name in the installed package."""
    return path if os.path.dirname(path) else tokenizer_file(path)


def store_of(spark: SparkSession) -> TableStore:
    """A fresh folder for written tables, in the shared folder that the session names."""
    return TableStore(importable(spark))
