"""Written tables between layers.

A layer that several queries share is written once to the shared folder named by
``spark.checkpoint.dir`` and read back.  That cuts the lineage, gives column pruning to every
reader, and survives the loss of any executor.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from holdfast.plans.workers import importable

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private temporary one only for local sessions."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_CONF} to a folder that all executors share.")
    return tempfile.mkdtemp(prefix="holdfast-")


def run_together(actions: Sequence[Callable[[], object]]) -> list:
    """Runs independent Spark actions from driver threads; results keep the order."""
    if len(actions) < 2:
        return [action() for action in actions]
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(action) for action in actions]]


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = importable(spark)
        base = root or shared_folder(spark)
        self.root = f"{base}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self._writes = itertools.count()
        self._tables: list[str] = []
        self._drop_when_session_ends()

    def _drop_when_session_ends(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        files = path.getFileSystem(conf)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def fresh(self, name: str) -> str:
        """A folder not used before: a frame read from an earlier write stays valid."""
        return f"{self.root}/{name}-{next(self._writes)}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.fresh(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """A written table that Spark knows to be dealt by ``key``, so joins on it move no row.

        ``df`` should come dealt by the key already, else every task writes a file for each bucket.  The catalog
        entry has a name of its own and goes with ``drop_tables`` or, in a session's own catalog, with the session.
        """
        path, table = self.fresh(name), f"holdfast_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def drop_tables(self) -> None:
        """Takes the bucketed tables out of the catalog; their files go with the session."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
