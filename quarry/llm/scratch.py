"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table written there survives the loss of any executor and cuts the lineage of what reads it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only if there is none and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return _checkpoint_dir(spark).rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


#: Rows of texts that go to a Python worker at once; Spark's default of 10,000 is made for narrow rows.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts travel in batches of ``TEXT_ROWS`` rows from now on, unless the session has a setting of its own.  A batch
    is held several times on its way, so its size bounds the memory of executors and workers.  Very long texts make
    smaller batches: Spark closes one at ``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(TEXT_ROWS))


def without(df: DataFrame, results: tuple[str, ...], needed: tuple[str, ...]) -> DataFrame:
    """``df`` without columns that have the name of a result, whatever its case; what is needed can't be one of them."""
    taken = {r.lower() for r in results}
    if clash := [c for c in needed if c.lower() in taken]:
        raise ValueError(f"{clash} can't be read and replaced at once")
    return df.select(*(c for c in df.columns if c.lower() not in taken)) if taken & {c.lower() for c in df.columns} else df


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written[path] = spark
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table which nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before the driver
            return


class Table:
    """An intermediate Parquet table: its path, and a fresh DataFrame over it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


#: Ids that may be sent to every task: 8 MB of them.
SENT_IDS = 1 << 20


def few(table: Table) -> DataFrame:
    """A table of one column of ids, marked for broadcast if it is counted to have ``SENT_IDS`` rows at most; beyond that
    the join that reads it shuffles."""
    return F.broadcast(table.df) if table.df.count() <= SENT_IDS else table.df


def materialize(df: DataFrame, label: str) -> Table:
    """Writes ``df`` to the shared folder once; readers start from the files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return Table(spark, path, df.schema)
