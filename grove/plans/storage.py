"""Where intermediate tables are kept: the folder of spark.checkpoint.dir, which driver and executors share.

Stored tables live as long as results may read them. Operators can't know when that ends, so the folder is the cluster's to
clean (spark.cleaner.referenceTracking.cleanCheckpoints does it for tables that the driver has let go of); discard() removes
what a caller knows to be done with.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "grove-checkpoints"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that are worth a file of their own.
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, stored: lineage ends here, and no executor's loss takes them away.

    rows, where it is known, bounds the row count: a table of few rows is then written as few files.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if rows is not None and rows // FILE_ROWS + 1 < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(rows // FILE_ROWS + 1)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The same rows, stored, dealt to parts and sorted by key, so that a join by it moves the other side only.

    Adaptive execution would forget how the rows are dealt, so it is off while they are.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    shared_dir(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(parts, key).sortWithinPartitions(key).checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)
