"""The whole run as composed DataFrames: discover, select, enrich, join, persist, aggregate.

Everything up to enrichment is one lazy plan. Enrichment output is appended to its log and read
back, because a second action over it would repeat its side effects.
"""
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from enrichflow import fixed_values as V
from enrichflow.operators import contracts, counts, enrich, extract, joins, keyed, reports, selection, texts
from enrichflow.schemas import ANALYSIS_RESULT, LIKES_RESULT, RECORD_TASK
from enrichflow.sources import logs, snapshots
from enrichflow.sources.scratch import folder, written


@dataclass(frozen=True)
class Discovery:
    parsed: DataFrame
    unique: DataFrame
    rejected: DataFrame
    failures: DataFrame
    counts: DataFrame


def discover(pages: DataFrame, listing: extract.Listing = extract.CATALOGUE, store: str | None = None) -> Discovery:
    """Records, quarantine, failures and counters of a page table.

    With ``store`` the parsed pages are written there once and everything else reads that table;
    without it each consumer parses the pages again (fine for one consumer).
    """
    parsed = extract.parse_listings(pages, listing)
    if store is not None:
        parsed = snapshots.settle(parsed, store)
    records = extract.listed_records(parsed, listing)
    unique = extract.unique_records(records)
    return Discovery(
        parsed=parsed,
        unique=unique,
        rejected=extract.quarantined(records),
        failures=extract.page_failures(parsed),
        counts=extract.discovery_counts(parsed, records),
    )


@dataclass(frozen=True)
class Branch:
    """Results of a branch for every task, and the part that was produced now."""

    results: DataFrame
    fresh: DataFrame


RUN_KEY = ("run_id", "paper_key")


def _latest(log: DataFrame, tasks: DataFrame) -> DataFrame:
    """Last logged row of each task by run and paper; a line without a run counts for every run that has its paper."""
    wanted = tasks.select(*RUN_KEY).distinct()
    mine = log.withColumnRenamed("run_id", "_run").join(wanted, "paper_key")
    mine = mine.filter(F.col("_run").isNull() | (F.col("_run") == F.col("run_id"))).drop("_run", "attempt")
    return logs.latest_logged(mine, *RUN_KEY)


def analyse(
    tasks: DataFrame,
    log_path: str,
    make_function: Callable[[], Callable[[dict], dict]] | None,
    mode: str,
    max_new: int = 0,
    partitions: int | None = None,
    stop_on_auth_failure: bool = True,
    wave: int = 10_000,
    reports_path: str | None = None,
) -> Branch:
    """Analysis branch: resume from the log, call in waves, append each wave, merge. ``tasks`` need run_id and ord.

    A wave is the next ``wave`` tasks of each run in order. Tasks are ranked once and stored by wave, so a wave reads its own
    tasks only, however many waves there are. It is logged (and its interim reports and question-answer
    rows written under ``reports_path``) before the next one starts, so a failure keeps all finished waves and the next
    call goes on from there. A run with an authorization failure in a wave starts no further one; which rows that
    defers depends on the order alone. ``max_new`` above 0 caps the new calls of a run. Deferred rows are returned
    but not logged, so they are tried again in the next run. Without a function the remaining tasks fail as
    skipped, also unlogged.
    """
    spark = tasks.sparkSession
    logged = logs.read_log(spark, log_path, ANALYSIS_RESULT, contracts.analysis_violations())
    resumed = joins.resume_analyses(tasks, _latest(logged, tasks), mode)
    done = _previous(resumed)
    remaining = resumed.filter(~F.col("done")).drop("done", "previous")
    if make_function is None:
        skipped = enrich.unavailable(remaining, V.SKIPPED_NO_MODEL_ACCESS, mode)
        return Branch(results=joins.merge_by_priority([done, skipped], tasks, *RUN_KEY), fresh=skipped)
    done = written(done)
    placed = selection.in_waves(remaining, wave, max_new)
    capped = written(placed, by="wave")
    scheduled = capped.filter("wave IS NOT NULL")
    attempt, closed = uuid.uuid4().hex, folder(spark)
    ends = written(scheduled.groupBy("run_id").agg(F.max("wave").alias("last")))
    last = ends.agg(F.max("last")).first()[0]
    for number in range(0 if last is None else last + 1):
        now, open_runs = scheduled.filter(F.col("wave") == number), ends.filter(F.col("last") >= number)
        if number and stop_on_auth_failure:
            stopped = spark.read.schema("run_id string").parquet(closed)
            now, open_runs = (rows.join(stopped, "run_id", "left_anti") for rows in (now, open_runs))
            if open_runs.isEmpty():
                break
        attempts = written(enrich.enrich_rows(now.drop("wave"), make_function, mode, partitions))
        logs.append_log(attempts, log_path, attempt)
        if reports_path is not None:
            _write_wave(now, attempts, reports_path)
        failed = attempts.filter(enrich.is_auth_failure(F.col("error_detail"))).select("run_id").distinct()
        failed.write.mode("append").parquet(closed)
    tried = logs.read_log(spark, log_path, ANALYSIS_RESULT).filter(F.col("attempt") == attempt)
    fresh = _latest(tried, scheduled)
    late = selection.deferred(capped.filter("wave IS NULL"), V.DEFERRED_BY_LIMIT, mode)
    closed = selection.deferred(scheduled.join(fresh.select(*RUN_KEY), list(RUN_KEY), "left_anti"), V.DEFERRED_BY_CUTOFF, mode)
    merged = joins.merge_by_priority([done, fresh, closed, late], tasks, *RUN_KEY)
    return Branch(results=merged, fresh=fresh)


def _write_wave(tasks: DataFrame, attempts: DataFrame, path: str) -> None:
    """Interim reports and question-answer rows of the tasks of a wave."""
    interim = reports.interim_reports(tasks, attempts)
    paper = F.struct(*(c for c in RECORD_TASK.names if c in tasks.columns)).alias("paper")
    found = tasks.select("run_id", "paper_key", "ord", paper).join(attempts.select(*RUN_KEY, "analysis"), list(RUN_KEY))
    interim.write.mode("append").parquet(f"{path}/interim-reports")
    texts.qa_records(found).write.mode("append").parquet(f"{path}/qa-log")


def _previous(resumed: DataFrame) -> DataFrame:
    return resumed.filter("done").select("previous.*")


def collect_likes(tasks: DataFrame, log_path: str, responses: DataFrame) -> Branch:
    """Metric branch over a response table: resume from the log, evaluate, check, append, merge."""
    spark = tasks.sparkSession
    logged = logs.read_log(spark, log_path, LIKES_RESULT, contracts.likes_violations())
    resumed = joins.resume_likes(tasks, _latest(logged, tasks))
    remaining = resumed.filter(~F.col("done")).drop("done", "previous")
    found = written(enrich.metric_results(remaining, responses).select("run_id", *LIKES_RESULT.names))
    if joins.completeness(remaining, found, *RUN_KEY).first() is not None:
        raise ValueError(V.LIKES_MISMATCH)
    done = written(_previous(resumed))
    attempt = logs.append_log(found, log_path)
    tried = logs.read_log(spark, log_path, LIKES_RESULT).filter(F.col("attempt") == attempt)
    fresh = _latest(tried, tasks)
    merged = joins.merge_by_priority([done, fresh], tasks, *RUN_KEY)
    return Branch(results=merged, fresh=fresh)


def persist_results(
    spark: SparkSession,
    tasks: DataFrame,
    analysis_log: str,
    likes_log: str,
    root: str,
    version: int,
    existing_version: int | None = None,
    analyses: DataFrame | None = None,
    likes: DataFrame | None = None,
) -> DataFrame:
    """Join the branches, upsert into the stored results and write the next version.

    Branches not passed are read from their logs. A log is first reduced to the selected keys, so
    that rows of an earlier, wider selection do not count as orphans. A version holds the runs of
    ``tasks`` only; stored runs outside them are pruned by partition and stay in their version, and runs
    without a changed row are taken over by reference.
    """
    contracts.require_run_ids(tasks)
    if analyses is None:
        analyses = _latest(logs.read_log(spark, analysis_log, ANALYSIS_RESULT, contracts.analysis_violations()), tasks)
    if likes is None:
        likes = _latest(logs.read_log(spark, likes_log, LIKES_RESULT, contracts.likes_violations()), tasks)
    analyses = snapshots.settle(analyses, snapshots.version_path(root, "latest-analyses", version))
    likes = snapshots.settle(likes, snapshots.version_path(root, "latest-likes", version))
    joined = joins.join_results(tasks, analyses, likes, strict=True)
    incoming = joined.withColumn("paper_key", F.col("paper.paper_key"))
    if existing_version is None:
        merged = incoming.withColumn("batch", F.lit(version).cast("bigint"))
    else:
        runs = tasks.select("run_id").distinct()
        existing = snapshots.read_table(spark, root, "paper-results", existing_version).join(
            runs, "run_id", "left_semi"
        )
        merged = keyed.upsert(existing, incoming, ["run_id", "paper_key"]).drop("accepted")
        merged = merged.withColumn("batch", F.coalesce("batch", F.lit(version).cast("bigint")))
    return snapshots.write_snapshot(
        merged.select("run_id", "paper_key", "batch", "ord", "paper", "likes", "analysis", "status", "warnings"),
        root,
        version,
        existing_version,
    )


def aggregate_run(
    stored: DataFrame,
    disposed: DataFrame,
    failures: DataFrame,
    run_input: dict,
    root: str,
    version: int,
    started_at: datetime,
    finished_at: datetime,
    page_count: int = 0,
    tasks: DataFrame | None = None,
) -> DataFrame:
    """Write manifest, warnings and summary of the stored results; returns the manifest.

    ``tasks`` are the tasks that a run with a limit started from; without them all selected records count as tasks.
    """
    spark = stored.sparkSession
    warnings = counts.warning_rows(failures, selection.rejected_links(disposed, "run_id"), "run_id")
    shown = F.struct(
        *(
            (F.array(*(F.lit(x) for x in v)).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v)).alias(k)
            for k, v in run_input.items()
        )
    )
    manifest = reports.manifest_rows(
        stored, counts.initial_counts(disposed, "run_id", tasks=tasks), warnings, shown, started_at, finished_at, page_count
    )
    path = snapshots.version_path(root, "manifest", version)
    snapshots.write_manifest(manifest, path)
    snapshots.write_table(warnings, snapshots.version_path(root, "warnings", version))
    saved = spark.read.schema(manifest.schema).json(path)
    snapshots.write_summary(
        reports.summary_lines(stored, saved), snapshots.version_path(root, "conference-summary", version)
    )
    return saved
