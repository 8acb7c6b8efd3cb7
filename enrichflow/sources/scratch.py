"""Folders for tables that one job writes and the next reads.

All folders of a Spark application lie in one folder of its own; ``clear`` removes it when its results have been written elsewhere.
"""
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _home(spark: SparkSession) -> str:
    """The application's folder in ``spark.checkpoint.dir``, which all executors share; local mode may use the warehouse instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/enrichflow-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new folder of the application."""
    return f"{_home(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove everything this application has written to its folders; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run inside hand Python workers about ``size`` bytes at a time, or one row; Spark's 64 MB fit no small executor, its buffers being twice that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(frame: DataFrame, path: str | None = None, by: str | None = None, group: int | None = None) -> DataFrame:
    """The frame, computed once and stored; it is read back, so a lost executor costs no earlier work.

    ``by`` gives each value of a column a folder of its own, which a filter on it reads alone. ``group`` is for rows of megabytes: a
    row group ends at so many bytes, since a reader holds one whole, and Spark counts no bytes before a group's 100th row.
    """
    path = path or folder(frame.sparkSession)
    writer = frame.write.option("compression", "zstd")
    if by is not None:
        writer = frame.hint("rebalance", by).write.option("compression", "zstd").partitionBy(by)
    if group is not None:
        writer = writer.option("parquet.block.size", group).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
