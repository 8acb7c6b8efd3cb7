"""Queries on task state, reports, storage and streams."""
from datetime import datetime

from pyspark.sql import functions as F, types as T

from enrichflow import fixed_values as V
from enrichflow.operators import counts, reports, selection, taskstate, texts
from enrichflow.plans import flow
from enrichflow.queries import tables
from enrichflow.queries.joining import CUT, JOINED_SQL, PROTECTED_SQL, event_rows, joined
from enrichflow.queries.registry import query
from enrichflow.queries.tables import QUESTIONS, prop_number, table
from enrichflow.schemas import JOINED_RESULT, LIKES_RESULT
from enrichflow.sources import logs, snapshots
from enrichflow.sources.scratch import folder
from enrichflow.streaming import latest

LOG_SQL = """
log AS (
  SELECT 'run' || (user_id % 4) AS run_id, event_id AS seq, user_id, event_type AS kind,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         NOT (event_type IN ('purchase', 'error') AND CAST(json_extract(props, '$.k') AS BIGINT) < 10) AS same_id
  FROM events
),
enq AS (SELECT run_id, user_id, min(seq) AS enq FROM log WHERE kind = 'view' GROUP BY ALL),
clm AS (SELECT run_id, user_id, min(seq) AS clm FROM log JOIN enq USING (run_id, user_id)
        WHERE kind = 'click' AND seq > enq GROUP BY ALL),
res AS (SELECT run_id, user_id, min(seq) AS res FROM log JOIN clm USING (run_id, user_id)
        WHERE kind IN ('purchase', 'error') AND same_id AND seq > clm GROUP BY ALL),
state AS (
  SELECT run_id, user_id, 'arxiv:' || user_id AS paper_key, CAST(user_id AS VARCHAR) AS arxiv_id, enq AS seq, clm, res,
         CASE WHEN log.kind = 'purchase' THEN 'SUCCESS' WHEN log.kind = 'error' THEN 'FAILED'
              WHEN clm IS NOT NULL THEN 'CLAIMED' ELSE 'PENDING' END AS state,
         CASE WHEN clm IS NULL THEN 0 ELSE 1 END AS attempts,
         CASE WHEN log.kind = 'purchase' THEN log.k END AS likes,
         CASE WHEN log.kind = 'purchase' THEN log.k || CASE WHEN log.k = 1 THEN ' Like' ELSE ' Likes' END END AS raw_text,
         CASE WHEN log.kind = 'error' THEN 'ALPHAXIV_LIKES_UNAVAILABLE' END AS error_code
  FROM enq LEFT JOIN clm USING (run_id, user_id) LEFT JOIN res USING (run_id, user_id)
       LEFT JOIN log ON log.run_id = enq.run_id AND log.user_id = enq.user_id AND log.seq = res
),
audit AS (
  SELECT log.run_id, 'arxiv:' || log.user_id AS paper_key, log.seq,
         CASE log.kind WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'success' ELSE 'failure' END AS kind,
         CASE WHEN log.seq = clm OR log.seq = res THEN NULL
              WHEN s.seq IS NULL OR log.seq < s.seq THEN 'UNKNOWN_TASK'
              WHEN log.kind = 'click' THEN 'NOT_PENDING'
              WHEN NOT same_id THEN 'OTHER_IDENTITY'
              WHEN log.seq > res AND state = 'SUCCESS' THEN 'ALREADY_SUCCEEDED'
              ELSE 'NOT_CLAIMED' END AS reason
  FROM log LEFT JOIN state s ON log.run_id = s.run_id AND log.user_id = s.user_id
  WHERE log.kind IN ('click', 'purchase', 'error')
)"""
STATE_SQL = (
    "WITH" + LOG_SQL + " SELECT run_id, paper_key, state, attempts, likes, raw_text, error_code FROM state"
)


def folded(spark, sf_dir):
    return taskstate.fold_states(tables.task_events(spark, sf_dir))


def task_offers(spark, sf_dir, renamed_runs=None):
    """What a batch offers to a stored task table: inserted, existing and conflicting rows by identity.

    Tasks are enqueued before and after a cut; those of ``renamed_runs`` (None: all) may come back under another title.
    """
    events = tables.task_events(spark, sf_dir)
    marked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (prop_number() >= 90).alias("renamed"),
        (F.col("ts") < F.lit(CUT).cast("timestamp")).alias("early"),
    )
    offers = events.filter(F.col("kind") == "enqueue").join(marked, "seq")
    changes = F.col("renamed") if renamed_runs is None else F.col("renamed") & F.col("run_id").isin(*renamed_runs)
    title = F.when(changes, F.concat("title", F.lit(" changed"))).otherwise(F.col("title"))
    offers = offers.withColumn("title", title)
    first = F.min_by(F.struct("title", "arxiv_url", "arxiv_id"), "seq")
    stored = offers.filter("early").groupBy("run_id", "paper_key").agg(first.alias("t")).select("run_id", "paper_key", "t.*")
    return taskstate.insert_tasks(stored, offers.filter("NOT early"))


@query(
    f"""
WITH offers AS (
  SELECT 'run' || (user_id % 4) AS run_id, 'arxiv:' || user_id AS paper_key, event_id,
         'user ' || user_id || CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 90 THEN ' changed' ELSE '' END AS title,
         ts < TIMESTAMP '{CUT}' AS early
  FROM events WHERE event_type = 'view'),
stored AS (SELECT run_id, paper_key, arg_min(title, event_id) AS title FROM offers WHERE early GROUP BY ALL),
new AS (SELECT run_id, paper_key, title, min(event_id) AS first, count(*) AS n FROM offers WHERE NOT early GROUP BY ALL),
owner AS (SELECT run_id, paper_key, arg_min(title, first) AS title FROM new GROUP BY ALL),
j AS (SELECT new.*, s.title IS NOT NULL AS known, new.title = coalesce(s.title, o.title) AS same
      FROM new JOIN owner o USING (run_id, paper_key) LEFT JOIN stored s USING (run_id, paper_key))
SELECT run_id, paper_key, title, CAST(CASE WHEN same AND NOT known THEN 1 ELSE 0 END AS BIGINT) AS inserted,
       CASE WHEN same THEN n - CASE WHEN known THEN 0 ELSE 1 END ELSE 0 END AS existing,
       CASE WHEN same THEN 0 ELSE n END AS conflicts
FROM j"""
)
def q_task_insert(spark, sf_dir):
    inserts = task_offers(spark, sf_dir)
    return inserts.select("run_id", "paper_key", "title", "inserted", "existing", "conflicts")


@query(
    "WITH" + LOG_SQL + """
SELECT run_id, arg_min(paper_key, seq) AS paper_key, min(seq) AS seq, 1 AS attempts FROM (
  SELECT s.run_id, s.paper_key, s.seq FROM state s WHERE s.state <> 'CLAIMED') GROUP BY run_id"""
)
def q_task_next(spark, sf_dir):
    """Finished tasks count as pending here, so that every run has a next one."""
    tasks = folded(spark, sf_dir)
    reset = tasks.filter("state <> 'CLAIMED'").withColumn("state", F.lit("PENDING")).withColumn("attempts", F.lit(0))
    return taskstate.next_pending(reset).select("run_id", "paper_key", "seq", "attempts")


@query(STATE_SQL)
def q_task_fold(spark, sf_dir):
    return folded(spark, sf_dir).select(
        "run_id", "paper_key", "state", "attempts", "likes", "raw_text", "error_code"
    )


@query("WITH" + LOG_SQL + " SELECT run_id, paper_key, seq, kind, reason FROM audit WHERE reason IS NOT NULL")
def q_task_audit(spark, sf_dir):
    return taskstate.audit_rows(tables.task_events(spark, sf_dir), folded(spark, sf_dir))


@query(
    "WITH" + LOG_SQL + """
SELECT run_id, seq, paper_key, arxiv_id, likes, raw_text, state AS status, error_code FROM state
WHERE state IN ('SUCCESS', 'FAILED')"""
)
def q_task_terminal(spark, sf_dir):
    return taskstate.terminal_results(folded(spark, sf_dir), "run_id")


@query(
    "WITH" + LOG_SQL + """
SELECT r.run_id, s.state, count(t.paper_key) AS n
FROM (SELECT DISTINCT run_id FROM state) r CROSS JOIN (SELECT unnest(['PENDING', 'CLAIMED', 'SUCCESS', 'FAILED']) AS state) s
LEFT JOIN state t ON t.run_id = r.run_id AND t.state = s.state GROUP BY ALL"""
)
def q_task_states(spark, sf_dir):
    return taskstate.run_states(folded(spark, sf_dir))


_HEAD = "'# ' || text || chr(10) || chr(10) || '- arXiv: ' || doc_id || chr(10) || '- Status: ' || "
_BODY = (
    "chr(10) || chr(10) || '## Questions' || chr(10) || chr(10) || '1. What is new?' || chr(10) || '2. What is missing?' "
    "|| chr(10) || chr(10) || '## Answers' || chr(10) || chr(10) || coalesce(answer, 'Unavailable') || chr(10)"
)
_FINAL = (
    _HEAD + "status || chr(10) || '- Likes: ' || coalesce(CAST(likes AS VARCHAR), 'FAILED') || chr(10) || '- Warnings: ' || "
    "coalesce(nullif(warnings, ''), 'None') || " + _BODY
)
_INTERIM = (
    _HEAD + "CASE WHEN a_ok THEN 'ANALYSIS_COMPLETED' ELSE 'ANALYSIS_FAILED' END || chr(10) || '- Likes: Pending' || chr(10) "
    "|| '- Warnings: ' || CASE WHEN a_ok THEN 'Likes collection pending' ELSE a_code END || " + _BODY
)


@query("WITH" + JOINED_SQL + f" SELECT paper_key, doc_id || '.md' AS file_name, md5({_FINAL}) AS body FROM results")
def q_report_md(spark, sf_dir):
    return reports.final_reports(joined(spark, sf_dir)).select("paper_key", "file_name", F.md5("body").alias("body"))


@query(
    "WITH" + JOINED_SQL + f"""
SELECT paper_key, doc_id || '.md' AS file_name, md5({_INTERIM}) AS body FROM results
WHERE a_code IS NULL OR a_code <> 'MISSING_ANALYSIS_RESULT'"""
)
def q_interim_md(spark, sf_dir):
    made = reports.interim_reports(tables.record_tasks(spark, sf_dir), tables.analyses(spark, sf_dir))
    return made.select("paper_key", "file_name", F.md5("body").alias("body"))


@query(
    "WITH" + JOINED_SQL + """
SELECT paper_key, CASE WHEN a_ok THEN md5(answer) END AS answer, CASE WHEN a_ok THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM results"""
)
def q_qa_records(spark, sf_dir):
    return texts.qa_records(joined(spark, sf_dir)).select("paper_key", F.md5("answer").alias("answer"), "status")


RUN_INPUT = {"conference": "CVPR", "year": 2026}
STARTED, FINISHED = datetime(2026, 1, 1), datetime(2026, 1, 2)


def manifest(spark, sf_dir):
    results = joined(spark, sf_dir)
    shown = F.struct(*(F.lit(v).alias(k) for k, v in RUN_INPUT.items()))
    tasks = tables.record_tasks(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(tables.document_key().alias("paper_key"), F.lit(True).alias("has"))
    disposed = tasks.join(labelled, "paper_key", "left").withColumn(
        "disposition", F.when(F.col("has"), selection.SELECTED).otherwise(selection.INVALID_LINK)
    ).withColumn("position", F.lit(0))
    rejected = selection.rejected_links(disposed, "run_id")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(tables.document_key().alias("paper_key"))
    failures = tasks.join(toxic, "paper_key").select(
        "run_id", F.lit(0).alias("position"), F.lit(V.PAGE_UNAVAILABLE).alias("error_code")
    )
    return results, reports.manifest_rows(
        results,
        counts.initial_counts(disposed, "run_id"),
        counts.warning_rows(failures, rejected, "run_id"),
        shown,
        STARTED,
        FINISHED,
    )


@query(
    "WITH" + JOINED_SQL + """,
first AS (SELECT source, count(*) AS discovered, count(*) FILTER (l_code = 'MISSING_LIKES_RESULT') AS skipped FROM results GROUP BY 1),
lost AS (SELECT source, count(*) AS lost FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT source AS run_id, run_status AS status, 2026 AS year, TIMESTAMP '2026-01-01 00:00:00' AS started_at,
       TIMESTAMP '2026-01-02 00:00:00' AS finished_at, discovered, skipped, discovered - skipped AS selected_at_start, selected,
       likes_success, likes_failed, analysis_success, analysis_failed, completed, partial, failed,
       coalesce(concat_ws('; ', '0 DAY_PAGE_UNAVAILABLE ' || lost, CASE WHEN skipped > 0 THEN '1 INVALID_ARXIV_URL ' || skipped END), '')
         AS warnings
FROM runs JOIN first USING (source) LEFT JOIN lost USING (source)"""
)
def q_manifest(spark, sf_dir):
    _, rows = manifest(spark, sf_dir)
    shown = F.transform(
        "warnings",
        lambda w: F.concat(w["phase"].cast("string"), F.lit(" "), w["code"], F.lit(" "), w["n"].cast("string")),
    )
    return rows.select(
        "run_id", "status", "input.year", "started_at", "finished_at", "counts.discovered", "counts.skipped",
        "selected_at_start", "counts.selected", "counts.likes_success", "counts.likes_failed",
        "counts.analysis_success", "counts.analysis_failed", "counts.completed", "counts.partial", "counts.failed",
        F.array_join(shown, "; ").alias("warnings"),
    )


@query(
    "WITH" + JOINED_SQL + """
SELECT source AS run_id, 0 AS section, CAST(NULL AS BIGINT) AS ord, '# CVPR 2026 Research Summary' AS text FROM runs
UNION ALL SELECT source, unnest([1, 3, 5]), NULL, '' FROM runs
UNION ALL SELECT source, 2, NULL, 'Run status: ' || run_status FROM runs
UNION ALL SELECT source, 4, NULL, 'Selected: ' || selected || '; Completed: ' || completed || '; Partial: ' || partial
                                  || '; Failed: ' || failed || '.' FROM runs
UNION ALL SELECT source, 6, NULL, '| arXiv ID | Status | Likes |' FROM runs
UNION ALL SELECT source, 7, NULL, '|---|---|---:|' FROM runs
UNION ALL SELECT source, 8, doc_id, '| ' || doc_id || ' | ' || status || ' | ' || coalesce(CAST(likes AS VARCHAR), 'FAILED') || ' |'
FROM results"""
)
def q_summary(spark, sf_dir):
    results, rows = manifest(spark, sf_dir)
    return reports.summary_lines(results, rows)


@query(
    "WITH" + JOINED_SQL + f"""
SELECT source AS run_id, paper_key, status, likes, warnings, md5({_FINAL}) AS body FROM results"""
)
def q_persist_roundtrip(spark, sf_dir):
    """Branches appended to logs (with repeats), read back, joined, stored, stored again over the first version."""
    root = folder(spark)
    tasks = tables.record_tasks(spark, sf_dir).withColumns(
        {
            "conference": F.lit("CVPR"),
            "year": F.lit(2026),
            "authors": F.array().cast("array<string>"),
            "detail_url": F.col("arxiv_url"),
            "pdf_url": F.col("arxiv_url"),
            "conference_day": F.lit("Day 1"),
        }
    )
    found = tables.likes(spark, sf_dir)
    stale = found.withColumns(
        {"status": F.lit(V.FAILED), "likes": F.lit(None).cast("bigint"), "raw_text": F.lit(None).cast("string"),
         "error_code": F.lit("STALE")}
    )
    logs.append_log(stale.select(*LIKES_RESULT.names), f"{root}/{V.LIKES_LOG}")
    logs.append_log(found.select(*LIKES_RESULT.names), f"{root}/{V.LIKES_LOG}")
    analyses = tables.analyses(spark, sf_dir).withColumns(
        {
            "error_detail": F.lit(None).cast("string"),
            "analysis_mode": F.lit("structured_llm"),
            "questions": F.array(*(F.lit(q) for q in QUESTIONS)),
        }
    )
    logs.append_log(analyses, f"{root}/{V.ANALYSIS_LOG}")
    paths = (f"{root}/{V.ANALYSIS_LOG}", f"{root}/{V.LIKES_LOG}", root)
    flow.persist_results(spark, tasks, *paths, version=1)
    flow.persist_results(spark, tasks, *paths, version=2, existing_version=1)
    stored = snapshots.read_table(spark, root, "paper-results", 2)
    saved = snapshots.read_table(spark, root, V.REPORTS, 2).select("paper_key", "body")
    return stored.join(saved, "paper_key").select(
        "run_id",
        "paper_key",
        "status",
        "likes.likes",
        F.array_join("warnings", ", ").alias("warnings"),
        F.md5("body").alias("body"),
    )


@query("WITH" + JOINED_SQL + f" SELECT source AS run_id, doc_id || '.md' AS file_name, md5({_FINAL}) AS body FROM results")
def q_report_files(spark, sf_dir):
    """Final reports written as files and read back whole."""
    path = folder(spark)
    snapshots.export_report_files(reports.final_reports(joined(spark, sf_dir)), path)
    return snapshots.read_report_files(spark, path).select("run_id", "file_name", F.md5("body").alias("body"))


@query(
    "WITH" + JOINED_SQL + """
SELECT paper_key, md5(text) AS title, status, likes, warnings, CASE WHEN a_ok THEN answer END AS answer FROM results"""
)
def q_strict_results(spark, sf_dir):
    """Joined results exported as JSON lines in record order and read back strictly."""
    path = folder(spark)
    snapshots.export_jsonl(joined(spark, sf_dir).select(*JOINED_RESULT.names, "ord"), path, "ord")
    shape = T.StructType([*JOINED_RESULT.fields, T.StructField("ord", T.LongType())])
    return logs.read_results(spark, path, shape).select(
        "paper.paper_key", F.md5("paper.title").alias("title"), "status", "likes.likes",
        F.array_join("warnings", ", ").alias("warnings"), F.col("analysis.raw_answer").alias("answer"),
    )


@query(
    "WITH" + JOINED_SQL + """
SELECT source AS run_id, '# CVPR 2026 Research Summary' AS text FROM runs
UNION ALL SELECT source, unnest(['', '', '']) FROM runs
UNION ALL SELECT source, 'Run status: ' || run_status FROM runs
UNION ALL SELECT source, 'Selected: ' || selected || '; Completed: ' || completed || '; Partial: ' || partial
                         || '; Failed: ' || failed || '.' FROM runs
UNION ALL SELECT source, unnest(['| arXiv ID | Status | Likes |', '|---|---|---:|']) FROM runs
UNION ALL SELECT source, '| ' || doc_id || ' | ' || status || ' | ' || coalesce(CAST(likes AS VARCHAR), 'FAILED') || ' |' FROM results"""
)
def q_summary_files(spark, sf_dir):
    """Manifest and summary written, the summary made from the manifest as it was read back."""
    path = folder(spark)
    results, rows = manifest(spark, sf_dir)
    snapshots.write_manifest(rows, f"{path}/manifest")
    saved = spark.read.schema(rows.schema).json(f"{path}/manifest")
    snapshots.write_summary(reports.summary_lines(results, saved), f"{path}/summary")
    return spark.read.text(f"{path}/summary").select("run_id", F.col("value").alias("text"))


@query(
    "WITH" + JOINED_SQL + """
SELECT 'papers' AS name, paper_key, md5(text) AS value FROM results
UNION ALL SELECT 'likes-results', paper_key, coalesce(CAST(likes AS VARCHAR), l_code) FROM results
UNION ALL SELECT 'qa-results', paper_key, coalesce(answer, 'FAILED') FROM results"""
)
def q_snapshot_tables(spark, sf_dir):
    """The tables of a stored version besides results and reports, read back."""
    root = folder(spark)
    rows = joined(spark, sf_dir).withColumn("batch", F.lit(1).cast("bigint"))
    snapshots.write_snapshot(rows, root, 1)

    def part(name, value):
        stored = snapshots.read_table(spark, root, name, 1)
        return stored.select(F.lit(name).alias("name"), "paper_key", value.alias("value"))

    return (
        part("papers", F.md5("title"))
        .unionByName(part("likes-results", F.coalesce(F.col("likes").cast("string"), "error_code")))
        .unionByName(part("qa-results", F.coalesce("answer", "status")))
    )


PARTS = 4


def replayed(spark, rows, order: str, path: str):
    """Rows written as files that arrive in ``order`` and streamed again.

    A micro-batch takes as many files as the largest part has, so the number of batches, each of which merges what it finds with
    what is stored, does not grow with the rows.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = (high - low) // PARTS + 1
    files = [0]
    for part in range(PARTS):
        piece = rows.filter(F.col(order).between(low + part * step, low + (part + 1) * step - 1))
        piece.write.mode("append").parquet(path)
        files.append(len(spark.read.schema(rows.schema).parquet(path).inputFiles()))
    most = max(after - before for before, after in zip(files, files[1:]))
    return latest.file_stream(spark, path, rows.schema, files_per_trigger=most)


@query(PROTECTED_SQL)
def q_stream_latest(spark, sf_dir):
    root = folder(spark)
    rows = event_rows(spark, sf_dir)
    stream = replayed(spark, rows, "event_id", f"{root}/in")
    table = latest.latest_table(f"{root}/table", rows.schema, ["user_id"], ["event_id"], buckets=8)
    latest.start_upserts(stream, table, f"{root}/state").awaitTermination()
    return table.current(spark).select("user_id", F.col("number").alias("event_id"), "status")


def streamed_steps(spark, sf_dir):
    root = folder(spark)
    rows = tables.task_events(spark, sf_dir)
    stream = replayed(spark, rows, "seq", f"{root}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, latest.ROCKS)
    try:
        latest.start_sink(latest.stream_task_steps(stream), f"{root}/out", f"{root}/state").awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{root}/out").drop("batch_id")


@query(STATE_SQL)
def q_stream_state(spark, sf_dir):
    return latest.states_from_steps(streamed_steps(spark, sf_dir)).drop("seq")


@query(
    "WITH" + JOINED_SQL + f"""
SELECT paper_key, doc_id || '.md' AS file_name,
       md5({_FINAL}) AS body
FROM results WHERE a_code IS NULL OR a_code <> 'MISSING_ANALYSIS_RESULT'"""
)
def q_stream_report(spark, sf_dir):
    """Analyses stream in first, likes later."""
    root = folder(spark)
    analyses, found = tables.analyses(spark, sf_dir), tables.likes(spark, sf_dir)
    likes = F.struct(*LIKES_RESULT.names)
    rows = (
        analyses.select("paper_key", F.lit(0).cast("bigint").alias("seq"),
                        F.struct("status", "analysis", "error_code").alias("analysis_result"))
        .unionByName(
            found.select(
                "paper_key", F.lit(1).cast("bigint").alias("seq"), likes.alias("likes_result")
            ),
            allowMissingColumns=True,
        )
    )
    stream = replayed(spark, rows, "seq", f"{root}/in")
    feed = latest.ReportFeed(f"{root}/feed", rows.schema, tables.record_tasks(spark, sf_dir), buckets=8)
    latest.start_reports(stream, feed, f"{root}/state").awaitTermination()
    written = feed.reports.current(spark)
    return written.select("paper_key", "file_name", F.md5("body").alias("body"))
