"""A keyed table that a stream keeps up to date, batch by batch.

Rows lie in buckets of their key. A micro-batch rewrites only the buckets that it touches, in a folder of its own, and then records for each
bucket which batch holds it. A batch always starts from the record before it, so a replay writes the same rows again
and changes nothing, and reading the table reads one version of each bucket, not all past batches.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from enrichflow.operators.keyed import last_per_key

BUCKETS = 64
_BUCKET, _RECORD = "_bucket", "bucket int, held_by bigint"


@dataclass(frozen=True)
class KeyedTable:
    """``reduce`` turns stored and new rows of a key into the one that stays; it must not depend on how rows are split into batches.

    ``schema`` is that of the rows. ``buckets`` is fixed for the life of the table.
    """

    root: str
    keys: Sequence[str]
    schema: T.StructType
    reduce: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS
    _known: dict[int, dict[int, int]] = field(default_factory=dict, repr=False, compare=False)  # records that this object wrote

    def _record(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Which batch holds each bucket: at most ``buckets`` rows."""
        mine = [b for b in self._known if before is None or b < before]
        if mine:
            return self._known[max(mine)]
        try:
            records = spark.read.schema(f"{_RECORD}, batch_id bigint").parquet(f"{self.root}/record")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            records = records.filter(F.col("batch_id") < before)
        last = records.agg(F.max("batch_id")).first()[0]
        return {r["bucket"]: r["held_by"] for r in records.filter(F.col("batch_id") == last).collect()} if last is not None else {}

    def _read(self, spark: SparkSession, record: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/rows/batch_id={batch}/{_BUCKET}={bucket}" for bucket, batch in sorted(record.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def current(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch."""
        return self._read(spark, self._record(spark))

    def hit(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys of these rows: at most ``buckets``."""
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def touched(self, keys: DataFrame, hit: set[int] | None = None) -> DataFrame:
        """Rows of the given keys; reads their buckets only, which may be handed over."""
        spark = keys.sparkSession
        hit = self.hit(keys) if hit is None else hit
        rows = self._read(spark, {b: held for b, held in self._record(spark).items() if b in hit})
        return rows.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def apply(self, batch: DataFrame, batch_id: int, hit: set[int] | None = None) -> None:
        """Merge the rows of one batch; ``hit`` may name the buckets that its keys lie in."""
        spark = batch.sparkSession
        before = self._record(spark, batch_id)
        hit = self.hit(batch) if hit is None else hit
        stored = self._read(spark, {b: held for b, held in before.items() if b in hit})
        merged = self.reduce(stored.unionByName(batch.select(*self.schema.names))).select(*self.schema.names, self._bucket())
        path = f"{self.root}/rows/batch_id={batch_id}"
        merged.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        after = {b: held for b, held in before.items() if b not in hit} | dict.fromkeys(_folders(spark, path), batch_id)
        record = spark.createDataFrame(sorted(after.items()), _RECORD).coalesce(1)
        record.write.mode("overwrite").parquet(f"{self.root}/record/batch_id={batch_id}")
        self._known.clear()
        self._known.update({batch_id: after} | ({batch_id - 1: before} if batch_id else {}))


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Buckets that a batch wrote; one that only has keys without rows has no folder."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there)
    names = [entry.getPath().getName() for entry in listed]
    return [int(name.split("=")[1]) for name in names if name.startswith(f"{_BUCKET}=")]


def latest_by(keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: last_per_key(rows, keys, order)


def start_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``act`` on every micro-batch; it must do the same again when a batch is replayed."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
