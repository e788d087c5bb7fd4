"""Session defaults, the shared scratch folder and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A driver-side list at most this long may be broadcast as a lookup table.
LOOKUP_ROWS = 200_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "quadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    ``forceOptimizeSkewedJoin`` lets adaptive execution split a hot subject even in
    the middle of a chain of joins on the same key.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="quadloom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    """Write a table; the shuffle files of the write go with it and do not wait for a collection
    of garbage on the driver."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files."""
    path = scratch_path(df.sparkSession, label)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder, dropped at the end of a ``with`` block or before.
    What the block returns must not read them: write it with ``materialise`` first."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[table for table, _ in self._held])

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Like ``materialise``; a write that fails leaves its folder to the end of the block."""
        path = scratch_path(self.spark, label)
        self._held.append((None, path))
        _write(df, path)
        self._held[-1] = (self.spark.read.schema(df.schema).parquet(path), path)
        return self._held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Delete the folders of these tables; others are left alone."""
        gone = [held for held in self._held if any(held[0] is t for t in tables)]
        self._held = [held for held in self._held if not any(held[0] is t for t in tables)]
        for _, path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def lookup(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A DataFrame from a driver-side list, broadcast only when its length is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= LOOKUP_ROWS else df
