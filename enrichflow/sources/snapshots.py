"""Versioned run tables, report rows, manifest and summary.

A version is its own directory, so a job never overwrites what it reads. The result table is
written first and the other tables are projected from the written files: one computation, nothing
cached, and a lost executor only repeats a scan.
"""
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from enrichflow import fixed_values as V
from enrichflow.operators.contracts import require_run_ids
from enrichflow.operators.reports import final_reports
from enrichflow.operators.texts import qa_records
from enrichflow.sources import report_files


SNAPSHOT = ("paper-results", "papers", "likes-results", "qa-results", V.REPORTS)


def version_path(root: str, table: str, version: int) -> str:
    return f"{root}/{table}/version={version}"


def write_table(
    df: DataFrame, path: str, run: str | None = "run_id", kind: str = "parquet", clustered: bool = False
) -> None:
    """Replace the partitions of the runs present in ``df``; other runs of the directory stay.

    Rows are rebalanced by run first: a run gets few files, and AQE splits a run too big for one task.
    ``clustered`` skips that shuffle for rows read from a table written this way.
    """
    by_run = run is not None and run in df.columns
    writer = (df.hint("rebalance", run) if by_run and not clustered else df).write.mode("overwrite").format(kind)
    if kind == "parquet":
        writer = writer.option("compression", "zstd")
    if kind == "json":
        writer = writer.option("ignoreNullFields", "false")
    if by_run:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(run)
    writer.save(path)


RUNS = "runs"  # per version: run_id, its rows and their print, and the version whose files hold it


def _recorded(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    try:
        return spark.read.parquet(version_path(root, RUNS, version))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    """A table of a version; runs that it took over unchanged are read from the versions that wrote them, run by run."""
    reader = spark.read.option("mergeSchema", "false")
    record = _recorded(spark, root, version) if table in SNAPSHOT else None
    held = sorted(r[0] for r in record.select("held_by").distinct().collect()) if record is not None else []  # at most one per version
    if not held or held == [version]:
        return reader.parquet(version_path(root, table, version))
    parts = [
        reader.parquet(version_path(root, table, old)).join(record.filter(F.col("held_by") == old).select("run_id"), "run_id", "left_semi")
        for old in held
    ]
    return reduce(DataFrame.unionByName, parts)


def _prints(results: DataFrame) -> DataFrame:
    """(run_id, n, print): a hash over all rows of each run, whatever their order."""
    rest = F.xxhash64(F.to_json(F.struct(*(c for c in results.columns if c != "run_id")), {"ignoreNullFields": "false"}))
    return results.select("run_id", rest.alias("h")).groupBy("run_id").agg(
        F.count("*").alias("n"), F.concat_ws(":", F.hex(F.bit_xor("h")), F.hex(F.sum(F.pmod("h", F.lit(1 << 30))))).alias("print"))


def _recorded_as(prints: DataFrame, version: int) -> DataFrame:
    return prints.withColumn("held_by", F.lit(version).cast("bigint"))


def write_snapshot(results: DataFrame, root: str, version: int, base: int | None = None) -> DataFrame:
    """Write results, records, likes, question-answer rows and reports of one version; returns the stored results.

    Runs whose rows are those of the version ``base`` are not written again: the version's record names the version that holds them.
    Without a base the record is made of the stored rows, so the results are computed once.
    """
    spark = results.sparkSession
    path, before = version_path(root, "paper-results", version), None if base is None else _recorded(spark, root, base)
    if before is None:
        write_table(results, path)
        stored = spark.read.schema(results.schema).parquet(path)
        settle(_recorded_as(_prints(stored), version), version_path(root, RUNS, version))
    else:
        known = before.select("run_id", "n", "print", F.col("held_by").alias("held_before"))
        record = _recorded_as(_prints(results), version).join(known, ["run_id", "n", "print"], "left")
        record = record.withColumn("held_by", F.coalesce("held_before", "held_by")).drop("held_before")
        record = settle(record, version_path(root, RUNS, version))
        changed = record.filter(F.col("held_by") == version).select("run_id")
        if changed.first() is None and record.first() is not None:
            return read_table(spark, root, "paper-results", version)
        write_table(results.join(changed, "run_id", "left_semi"), path)
        stored = spark.read.schema(results.schema).parquet(path)
    order = [c for c in stored.columns if c in ("run_id", "batch", "ord")]
    tables = {
        "papers": stored.select(*order, "paper.*"),
        "likes-results": stored.select(*order, "likes.*"),
        "qa-results": qa_records(stored),
        V.REPORTS: final_reports(stored),
    }
    for name, rows in tables.items():
        write_table(rows, version_path(root, name, version), clustered=True)
    return stored if before is None else read_table(spark, root, "paper-results", version)


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write a frame that several jobs need and read it back: parsed once, safe against lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_jsonl(table: DataFrame, path: str, *order: str) -> None:
    """JSON lines whose part files, read in name order, follow ``order``."""
    sorted_rows = table.repartitionByRange(*order).sortWithinPartitions(*order) if order else table
    sorted_rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_report_files(reports: DataFrame, folder: str) -> None:
    """Each report as a text file in its own folder, ``run_id=…/file_name=…``, on any file system that Spark writes to.

    Folders of reports that are not among these rows stay. The text sink ends a file with a line break of its own. Where the folder is
    on a file system that the executors mount, tasks write the files themselves: the sink takes several processes and renames a file there.
    """
    if "run_id" in reports.columns:
        require_run_ids(reports)
    keys = [c for c in reports.columns if c in ("run_id", "file_name")]
    texts = reports.select(*keys, F.regexp_replace("body", "\n\\z", "").alias("value"))
    mounted = report_files.mounted_path(reports.sparkSession, folder)
    if mounted is not None:
        report_files.write(texts, mounted, keys)
        return
    texts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(folder)


def read_report_files(spark: SparkSession, folder: str) -> DataFrame:
    """(run columns, file_name, body) of exported reports."""
    mounted = report_files.mounted_path(spark, folder)
    if mounted is not None:
        return report_files.read(spark, mounted)
    return spark.read.text(folder, wholetext=True).withColumnRenamed("value", "body")


def write_manifest(manifest: DataFrame, path: str) -> None:
    write_table(manifest, path, run=None, kind="json")


def write_summary(lines: DataFrame, path: str, run: str = "run_id") -> None:
    """Text lines sorted by run, section and record order; a folder per run."""
    order = [run, "section", *(c for c in lines.columns if c in ("batch", "ord"))]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(run, F.col("text")).write.mode(
        "overwrite"
    ).partitionBy(run).text(path)
