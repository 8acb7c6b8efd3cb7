"""One text file per row on a mounted file system, in the folders ``key=value/…`` of Spark's partitioned tables.

Rows of one folder meet in one task, which replaces the folder's files one by one: each is written under another name and renamed,
so a reader never sees half a file and a task that runs again changes nothing.
"""
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")  # what Spark escapes in the name of a partition's folder
_NULL = "__HIVE_DEFAULT_PARTITION__"
_TOGETHER = 1000  # files read for one Arrow batch
_BATCH_BYTES = 1 << 24


def mounted_path(spark: SparkSession, folder: str) -> str | None:
    """The folder's path in the local tree, NULL if Spark reaches it in another way."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toUri().getPath() if files.getUri().getScheme() == "file" else None


def _named(key: str, value: str | None) -> str:
    return f"{key}=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else _NULL)


def _value(name: str) -> str | None:
    value = name.partition("=")[2]
    return None if value == _NULL else unquote(value)


def _replace(folder: str, values: Iterator[str | None]) -> None:
    """Make these texts the files of a folder."""
    os.makedirs(folder, exist_ok=True)
    kept = set()
    for n, value in enumerate(values):
        name, draft = f"part-{n:05d}.txt", f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "wb") as file:
            file.write((value or "").encode() + b"\n")
        os.replace(draft, f"{folder}/{name}")
        kept.add(name)
    for name in os.listdir(folder):
        if not name.startswith(".") and name not in kept:
            os.remove(f"{folder}/{name}")


def write(texts: DataFrame, root: str, keys: Sequence[str]) -> None:
    """Rows (keys, value) as files; folders of other keys stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (*keys, "value")))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for values, same in groupby(rows(batches), itemgetter(slice(len(keys)))):
            _replace("/".join((root, *map(_named, keys, values))), (r[-1] for r in same))
            done += 1
        yield pa.record_batch({"n": pa.array([done], pa.int64())})

    os.makedirs(root, exist_ok=True)
    plain = texts.select(*(F.col(k).cast("string").alias(k) for k in keys), "value")
    dealt = plain.repartition(*keys).sortWithinPartitions(*keys, "value")
    dealt.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


def _shown(folder: str) -> Iterator[str]:
    with os.scandir(folder) as found:
        yield from (e.name for e in found if not e.name.startswith((".", "_")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(keys, body) of all files. A task lists the folders of one run; tasks of their own read the files."""
    tops = sorted(n for n in _shown(root) if "=" in n)
    nested = bool(tops) and tops[0].startswith("run_id=")
    keys = ["run_id", "file_name"] if nested or not tops else ["file_name"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column("folder").to_pylist():
                names = []
                for name in _shown(f"{root}/{top}") if nested else [None]:
                    names.append(top if name is None else f"{top}/{name}")
                    if len(names) == _TOGETHER:
                        yield pa.record_batch({"folder": pa.array(names, pa.string())})
                        names = []
                yield pa.record_batch({"folder": pa.array(names, pa.string())})

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=[*keys, "body"])

        columns, size = [[] for _ in (*keys, "body")], 0
        for part in batches:
            for folder in part.column("folder").to_pylist():
                values = [_value(n) for n in folder.split("/")]
                for name in _shown(f"{root}/{folder}"):
                    with open(f"{root}/{folder}/{name}", "rb") as file:
                        body = file.read()
                    for column, value in zip(columns, (*values, body.decode())):
                        column.append(value)
                    size += len(body)
                    if size > _BATCH_BYTES or len(columns[0]) == _TOGETHER:
                        yield batch()
                        columns, size = [[] for _ in columns], 0
        yield batch()

    cores = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(t,) for t in tops], "folder string").repartition(max(1, min(len(tops), 4 * cores)), "folder")
    spread = folders.mapInArrow(listed, "folder string").repartition(8 * cores)
    return spread.mapInArrow(loaded, ", ".join(f"{c} string" for c in (*keys, "body")))
