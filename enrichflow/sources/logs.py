"""Append logs and result tables as JSON lines."""
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from enrichflow.functions.strings import strip
from enrichflow.operators.contracts import unknown_fields
from enrichflow.operators.keyed import last_per_key
from enrichflow.schemas import LONG, TEXT, row

LINE = "_line"
_BAD = "_bad"
# Written with every line: its run, the call that wrote it, the time of the append and the place in it.
PLACE = row(run_id=TEXT, attempt=TEXT, batch=LONG, line=LONG)


def read_log(spark: SparkSession, path: str, schema: T.StructType, violations: Column | None = None) -> DataFrame:
    """Usable rows of an append log; blank, malformed, unknown-field and contract-breaking lines are skipped.

    A missing path is an empty log. Rows also have ``run_id`` and ``attempt``. ``_line`` orders the lines as they
    were appended: batch number and place in the batch. Lines of other writers without them come first, in the order
    of file time, file, block and position in the block (the last only compares lines of one block, which share a task).
    """
    schema = T.StructType([f for f in schema.fields if f.name not in PLACE.names])
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        line_type = T.StructType().add("batch", T.LongType())
        return spark.createDataFrame([], T.StructType([*schema.fields, *PLACE.fields[:2], T.StructField(LINE, line_type)]))
    rows, _ = _parsed(_placed_lines(text), schema)
    return rows if violations is None else rows.filter(F.size(violations) == 0)


_FILE = {"at": "_metadata.file_modification_time", "file": "_metadata.file_path", "block": "_metadata.file_block_start"}


def _placed_lines(text: DataFrame) -> DataFrame:
    return text.select("value", *(F.col(source).alias(name) for name, source in _FILE.items()))


def _parsed(text: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of lines with their place in a file."""
    known = T.StructType([*schema.fields, *PLACE.fields])
    shape = T.StructType([*known.fields, T.StructField(_BAD, T.StringType())])
    line = F.struct("at", "file", "block", F.monotonically_increasing_id().alias("pos"))
    parsed = (
        text.select("value", line.alias(LINE))
        .filter(strip(F.col("value")) != "")
        .withColumn("r", F.from_json("value", shape, {"columnNameOfCorruptRecord": _BAD}))
        .withColumn("good", F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull() & ~_has_unknown(F.col("value"), known))
    )
    names = [*schema.names, "run_id", "attempt"]
    order = F.struct("r.batch", "r.line", f"{LINE}.*")
    rows = parsed.filter("good").select(*(F.col(f"r.{name}").alias(name) for name in names), order.alias(LINE))
    return rows, parsed.filter(F.coalesce(~F.col("good"), F.lit(True))).select("value", f"{LINE}.file", f"{LINE}.block")


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The lines of an append log as they arrive, with the file they come from; ``take_log`` reads its micro-batches."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return _placed_lines(lines)


def take_log(schema: T.StructType, good: str, bad: str, violations: Column | None = None) -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of ``stream_log``: usable rows go to ``good``, all other lines to the quarantine ``bad``.

    Each batch has a folder ``batch_id=N`` in both, which a replay overwrites. Rows have ``_line`` as those of ``read_log``, so the newest line of a key
    does not depend on when files arrive.
    """
    schema = T.StructType([f for f in schema.fields if f.name not in PLACE.names])

    def take(batch: DataFrame, batch_id: int) -> None:
        rows, rest = _parsed(batch, schema)
        if violations is not None:
            checked = rows.withColumn("_broken", F.size(violations) > 0)
            broken = checked.filter("_broken").drop("_broken")
            rows = checked.filter(F.coalesce(~F.col("_broken"), F.lit(False))).drop("_broken")
            refused = broken.select(F.to_json(F.struct(*schema.names)).alias("value"), f"{LINE}.file", f"{LINE}.block")
            rest = rest.unionByName(refused)
        rows.write.mode("overwrite").parquet(f"{good}/batch_id={batch_id}")
        rest.write.mode("overwrite").parquet(f"{bad}/batch_id={batch_id}")

    return take


def _has_unknown(text: Column, schema: T.StructType) -> Column:
    found = F.coalesce(F.size(unknown_fields(text, schema)) > 0, F.lit(True))
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            inner = F.get_json_object(text, f"$.{field.name}")
            found = found | F.coalesce(F.size(unknown_fields(inner, field.dataType)) > 0, F.lit(False))
    return found


def latest_logged(log: DataFrame, *keys: str) -> DataFrame:
    """Last line of each key (by default ``paper_key``)."""
    return last_per_key(log, keys or ["paper_key"], [LINE]).drop(LINE)


def append_log(rows: DataFrame, path: str, attempt: str | None = None) -> str:
    """Append rows as JSON lines with explicit nulls; returns the id of the attempt.

    The batch number is the driver's clock in nanoseconds, so appends of one second keep their order.
    """
    attempt = attempt or uuid.uuid4().hex
    run = F.col("run_id") if "run_id" in rows.columns else F.lit(None).cast("string")
    placed = rows.drop(LINE).withColumns(
        {"run_id": run, "attempt": F.lit(attempt), "batch": F.lit(time.time_ns()), "line": F.monotonically_increasing_id()}
    )
    placed.write.mode("append").option("ignoreNullFields", "false").json(path)
    return attempt


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Result table in which a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
