"""Enrichment, logs, storage and the whole run on small literal tables."""
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from enrichflow.operators import contracts, counts, enrich, reports, selection
from enrichflow.plans import flow
from enrichflow.schemas import ANALYSIS_RESULT, JOINED_RESULT, LIKES_RESULT, PAGE
from enrichflow.sources import logs, snapshots
from tests.test_extract import ARXIV, DAY, record
from tests.test_joins import analyses, bad, liked, likes, ok, tasks, unliked


def factory(fail=(), message="broken token=abc"):
    def make():
        def call(task):
            if task["arxiv_id"] in fail:
                raise RuntimeError(message)
            return {"research_problem": "p", "method_summary": "m " + task["title"], "raw_answer": "answer",
                    "answer_by_question": {"q1": "yes"}}

        return call

    return make


def test_failure_stays_in_its_row(spark):
    found = enrich.enrich_rows(tasks(spark, "1", "2", "3"), factory({"2"}), "structured_llm", partitions=1)
    rows = {r.paper_key: r for r in found.collect()}
    assert [rows[f"arxiv:{i}"].status for i in "123"] == ["SUCCESS", "FAILED", "SUCCESS"]
    failed = rows["arxiv:2"]
    assert (failed.error_code, failed.error_detail) == ("PAPER_ANALYSIS_FAILED", "RuntimeError: broken token=<redacted>")
    good = rows["arxiv:1"]
    assert good.analysis.answer_by_question == {"q1": "yes"} and good.analysis.datasets == []
    assert good.analysis_mode == "structured_llm" and good.questions == ["q1", "q2"]
    assert found.select(F.size(contracts.analysis_violations()).alias("n")).agg(F.max("n")).first()[0] == 0
    gone = enrich.unavailable(tasks(spark, "1"), "NO_ACCESS").first()
    assert (gone.status, gone.error_code) == ("FAILED", "NO_ACCESS")


@pytest.mark.parametrize(("message", "deferred"), [("HTTP 401", 3), ("Unauthorized user", 3), ("HTTP 429", 0)])
def test_cut_off_over_a_log(spark, message, deferred):
    attempts = spark.createDataFrame(
        [("r", i, "FAILED" if i == 2 else "SUCCESS", None, f"RuntimeError: {message}" if i == 2 else None) for i in range(6)],
        "run_id string, ord int, status string, error_code string, error_detail string",
    )
    logged, later = enrich.after_cut_off(enrich.cut_off(attempts.repartition(4)))
    assert (logged.count(), later.count()) == (6 - deferred, deferred)
    assert {r.ord for r in later.collect()} == ({3, 4, 5} if deferred else set())


@pytest.mark.parametrize("partitions", [1, 4])
def test_cut_off_between_waves_ignores_partitions(spark, tmp_path, partitions):
    work = tasks(spark, *"12345678").withColumn("run_id", F.lit("r")).unionByName(tasks(spark, *"123").withColumn("run_id", F.lit("s")))
    made = flow.analyse(work, f"{tmp_path}/log", factory({"3"}, "HTTP 401"), "structured_llm", partitions=partitions, wave=2,
                        reports_path=str(tmp_path))
    late = made.results.filter("error_code = 'ANALYSIS_DEFERRED_AUTHORIZATION_CIRCUIT_OPEN'")
    assert {(r.run_id, r.paper_key[-1]) for r in late.collect()} == {("r", i) for i in "5678"}
    assert made.results.count() == 11 and made.fresh.count() == 7
    assert spark.read.parquet(f"{tmp_path}/interim-reports").count() == spark.read.parquet(f"{tmp_path}/qa-log").count() == 7


def test_tasks_are_stored_once_for_all_waves(spark, tmp_path):
    """Seven waves over one run: the task table is ranked and stored by wave once, and a wave reads its own folder."""
    work = spark.range(70).selectExpr("'r' AS run_id", "id AS ord", "concat('arxiv:', id) AS paper_key", "array('q') AS questions",
                                      "CAST(id AS STRING) AS arxiv_id", "'t' AS title")
    stored = []
    real, flow.written = flow.written, lambda frame, *a, **k: stored.append(k.get("by")) or real(frame, *a, **k)
    try:
        made = flow.analyse(work, f"{tmp_path}/log", factory(), "structured_llm", wave=10)
    finally:
        flow.written = real
    assert stored.count("wave") == 1 and len(stored) == 3 + 7  # done rows, tasks, ends of runs, and the attempts of each wave
    assert made.fresh.count() == 70
    placed = selection.in_waves(work, 10, 35)
    assert {(r.wave, r["count"]) for r in placed.groupBy("wave").count().collect()} == {(0, 10), (1, 10), (2, 10), (3, 5), (None, 35)}
    waves = real(placed, by="wave")
    assert "PartitionFilters: [isnotnull(wave" in waves.filter("wave = 2")._jdf.queryExecution().executedPlan().toString()


def test_finished_waves_stay_when_a_later_one_fails(spark, tmp_path):
    work, log = tasks(spark, *"12345").withColumn("run_id", F.lit("r")), f"{tmp_path}/log"

    def dying():
        def call(task):
            if task["arxiv_id"] == "3":
                raise SystemExit("executor lost")
            return {"raw_answer": "a"}

        return call

    with pytest.raises(Exception):
        flow.analyse(work, log, dying, "structured_llm", partitions=1, wave=2)
    assert spark.read.json(log).count() == 2
    again = flow.analyse(work, log, factory(), "structured_llm", wave=2)
    assert again.fresh.count() == 3 and {r.status for r in again.results.collect()} == {"SUCCESS"}


def test_a_run_without_options_defers_nothing(spark, tmp_path):
    work = spark.range(1000).selectExpr("'r' AS run_id", "id AS ord", "concat('arxiv:', id) AS paper_key", "array('q') AS questions", "'1' AS arxiv_id",
                                        "'t' AS title")
    assert flow.analyse(work, f"{tmp_path}/log", factory(), "structured_llm").results.filter("status = 'SUCCESS'").count() == 1000


def test_two_runs_with_one_paper_and_old_failures(spark, tmp_path):
    both = tasks(spark, "1", "2").withColumn("run_id", F.lit("r")).unionByName(tasks(spark, "1").withColumn("run_id", F.lit("s")))
    a_log, l_log = f"{tmp_path}/a", f"{tmp_path}/l"
    flow.analyse(both, a_log, factory({"2"}, "OLD failure"), "structured_llm")
    metric = '{"data":{"paper_group":{"metrics":{"public_total_votes":%d}}}}'
    answers = spark.createDataFrame([("1", 200, metric % 5), ("1", 200, metric % 4), ("1", 500, None)], "arxiv_id string, http_status int, payload string")
    assert flow.collect_likes(both, l_log, answers).fresh.count() == 3
    stored = flow.persist_results(spark, both, a_log, l_log, str(tmp_path), version=1)
    assert {(r.run_id, r.paper_key[-1]): (r.status, r.likes.likes) for r in stored.collect()} == {
        ("r", "1"): ("COMPLETED", 5), ("s", "1"): ("COMPLETED", 5), ("r", "2"): ("FAILED", None)}
    more = both.unionByName(tasks(spark, "0").withColumns({"run_id": F.lit("r"), "ord": F.lit(-1)}))
    now = flow.analyse(more, a_log, factory({"0"}, "HTTP 401"), "structured_llm", wave=1)
    got = {(r.run_id, r.paper_key[-1]): r.error_code for r in now.results.collect()}
    assert got[("r", "2")] == "ANALYSIS_DEFERRED_AUTHORIZATION_CIRCUIT_OPEN" and got[("r", "0")] == "PAPER_ANALYSIS_FAILED"


def test_appends_of_one_second_keep_their_order(spark, tmp_path):
    log = f"{tmp_path}/log"
    for n in (3, 9, 4):
        logs.append_log(likes(spark, liked("1", n)), log)
    assert [r.likes for r in logs.latest_logged(logs.read_log(spark, log, LIKES_RESULT)).collect()] == [4]


def test_metric_results(spark):
    payload = '{"data":{"paper_group":{"metrics":{"public_total_votes":%s}}}}'
    responses = spark.createDataFrame(
        [("1", 200, payload % 25), ("2", 404, None), ("3", 500, payload % 1), ("4", 200, payload % "true"), ("5", 200, payload % 1)],
        "arxiv_id string, http_status int, payload string",
    )
    rows = {r.arxiv_id: r for r in enrich.metric_results(tasks(spark, *"123456"), responses).collect()}
    assert (rows["1"].likes, rows["1"].raw_text) == (25, "25 Likes") and rows["5"].raw_text == "1 Like"
    codes = [rows[i].error_code for i in "123456"]
    assert codes == [None, "ALPHAXIV_LIKES_NOT_FOUND", *["ALPHAXIV_LIKES_UNAVAILABLE"] * 2, None, "ALPHAXIV_LIKES_UNAVAILABLE"]


def test_fallback(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = spark.createDataFrame([("a", "x"), ("b", " ")], "k string, v string")
    two = spark.createDataFrame([("a", "y"), ("b", "z")], "k string, v string")
    got = {r.k: (r.v, r.source, r.error_code) for r in enrich.with_fallback(keys, one, two, "k", "v").collect()}
    assert got == {"a": ("x", "primary", None), "b": ("z", "fallback", None), "c": (None, None, "ALPHAXIV_EVIDENCE_UNAVAILABLE")}


def test_log_skips_bad_lines_and_last_line_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_log(spark, path, LIKES_RESULT).count() == 0
    good = dict(zip(LIKES_RESULT.names, liked("1", 3)))
    lines = [
        json.dumps(dict(zip(LIKES_RESULT.names, unliked("1")))), "", "   ", "{broken", json.dumps(good | {"extra": 1}),
        json.dumps(good | {"likes": 4}), json.dumps(good), json.dumps(dict(zip(LIKES_RESULT.names, liked("2")))), "[1]", '"x"',
    ]
    os.makedirs(path)
    with open(f"{path}/part-0.json", "w") as out:
        out.write("\n".join(lines))
    log = logs.read_log(spark, path, LIKES_RESULT, contracts.likes_violations())
    assert log.count() == 3
    assert {r.arxiv_id: r.likes for r in logs.latest_logged(log).collect()} == {"1": 3, "2": 3}
    logs.append_log(likes(spark, unliked("2")), path)
    newest = logs.latest_logged(logs.read_log(spark, path, LIKES_RESULT, contracts.likes_violations()))
    assert {r.arxiv_id: r.status for r in newest.collect()} == {"1": "SUCCESS", "2": "FAILED"}
    with open(f"{path}/part-0.json") as lines_in:
        assert "null" in lines_in.read()


def test_log_rejects_unknown_nested_fields(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(analyses(spark, ok("arxiv:1"), bad("arxiv:2")), path)
    assert logs.read_log(spark, path, ANALYSIS_RESULT, contracts.analysis_violations()).count() == 2
    (name,) = [n for n in os.listdir(path) if n.endswith(".json") and "arxiv:1" in open(f"{path}/{n}").read()][:1]
    text = open(f"{path}/{name}").read().replace('"research_problem"', '"zz":1,"research_problem"')
    os.makedirs(f"{path}2")
    open(f"{path}2/{name}", "w").write(text)
    keys = [r.paper_key for r in logs.read_log(spark, path + "2", ANALYSIS_RESULT).collect()]
    assert "arxiv:1" not in keys


def test_result_table_is_strict(spark, tmp_path):
    path = str(tmp_path / "results.json")
    open(path, "w").write("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        logs.read_results(spark, path, JOINED_RESULT).collect()


def pages(spark):
    first = record("Graph models", "/content/a.html", ARXIV) + record("Video graphs", "/content/b.html", ARXIV.replace("00001", "00002"))
    second = record("No link", "/content/c.html") + record("Cooking", "/content/d.html", ARXIV.replace("00001", "00003"))
    third = record("More graphs", "/content/e.html", ARXIV.replace("00001", "00004"))
    rows = [(0, 0, DAY[0], first, None), (1, 1, DAY[1], second, None), (2, 2, DAY[2], None, "DAY_PAGE_UNAVAILABLE"),
            (3, 3, f"{DAY[2]}x", third, None)]
    return spark.createDataFrame(rows, PAGE)


def test_whole_run_with_resume(spark, tmp_path):
    root = str(tmp_path)
    found = flow.discover(pages(spark), store=f"{root}/parsed")
    picked, disposed = selection.select_records(found.unique, ["graph"], ["q1", "q2"])
    work = picked.withColumn("run_id", F.lit("run-1"))
    metric = '{"data":{"paper_group":{"metrics":{"public_total_votes":%d}}}}'
    answers = spark.createDataFrame([("2503.00001", 200, metric % 5), ("2503.00002", 404, None)], "arxiv_id string, http_status int, payload string")
    a_log, l_log = f"{root}/a", f"{root}/l"

    first = flow.analyse(work, a_log, factory({"2503.00002"}), "structured_llm", max_new=2)
    status = {r.paper_key[-1]: (r.status, r.error_code) for r in first.results.collect()}
    assert status == {"1": ("SUCCESS", None), "4": ("SUCCESS", None), "2": ("FAILED", "ANALYSIS_DEFERRED_RUN_LIMIT")}
    assert spark.read.json(a_log).count() == 2
    flow.collect_likes(work, l_log, answers)
    stored = flow.persist_results(spark, work, a_log, l_log, root, version=1)
    assert {r.paper.arxiv_id[-1]: r.status for r in stored.collect()} == {"1": "COMPLETED", "2": "FAILED", "4": "PARTIAL"}

    more = answers.unionByName(spark.createDataFrame([("2503.00004", 200, metric % 9)], answers.schema))
    second = flow.analyse(work, a_log, factory(), "structured_llm", max_new=0)
    assert second.fresh.count() == 1 and {r.status for r in second.results.collect()} == {"SUCCESS"}
    flow.collect_likes(work, l_log, more)
    stored = flow.persist_results(spark, work, a_log, l_log, root, version=2, existing_version=1)
    assert {r.paper.arxiv_id[-1]: r.status for r in stored.collect()} == {"1": "COMPLETED", "2": "PARTIAL", "4": "COMPLETED"}
    assert {r.batch for r in stored.collect()} == {1}

    run = disposed.withColumn("run_id", F.lit("run-1"))
    manifest = flow.aggregate_run(
        stored, run, found.failures.withColumn("run_id", F.lit("run-1")), {"conference": "CVPR", "year": 2025, "topics": ["graph"]},
        root, 2, datetime(2026, 1, 1), datetime(2026, 1, 2), page_count=4,
    ).first()
    assert manifest.status == "PARTIAL" and manifest.counts.asDict() == {
        "discovered": 5, "skipped": 2, "selected": 3, "likes_success": 2, "likes_failed": 1, "analysis_success": 3,
        "analysis_failed": 0, "completed": 2, "partial": 1, "failed": 0,
    }
    assert [w.code for w in manifest.warnings] == ["DAY_PAGE_UNAVAILABLE"] and manifest.discovered_page_count == 4
    folder = snapshots.version_path(root, "conference-summary", 2) + "/run_id=run-1"
    text = "".join(open(f"{folder}/{n}").read() for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    assert text.startswith("# CVPR 2025 Research Summary\n\nRun status: PARTIAL\n\nSelected: 3; Completed: 2; Partial: 1; Failed: 0.\n")
    assert text.endswith("|---|---|---:|\n| 2503.00001 | COMPLETED | 5 |\n| 2503.00004 | COMPLETED | 9 |\n| 2503.00002 | PARTIAL | FAILED |\n")
    for table, n in (("papers", 3), ("likes-results", 3), ("qa-results", 3), ("reports", 3), ("warnings", 1)):
        assert snapshots.read_table(spark, root, table, 2).count() == n


def test_without_a_function_only_remaining_tasks_fail(spark, tmp_path):
    log = str(tmp_path / "a")
    logs.append_log(analyses(spark, ok("arxiv:1")), log)
    work = tasks(spark, "1", "2").withColumn("run_id", F.lit("r"))
    branch = flow.analyse(work, log, None, "structured_llm")
    got = {r.paper_key: (r.status, r.error_code) for r in branch.results.collect()}
    assert got == {"arxiv:1": ("SUCCESS", None), "arxiv:2": ("FAILED", "ANALYSIS_SKIPPED_NO_LLM_CREDENTIALS")}


def test_run_ids_are_checked_before_anything_is_written(spark, tmp_path):
    work = tasks(spark, "1").withColumn("run_id", F.lit("../up"))
    with pytest.raises(ValueError, match="INVALID_RUN_ID"):
        flow.persist_results(spark, work, "none", "none", str(tmp_path), version=1)
    assert os.listdir(tmp_path) == []


def test_narrower_selection_ignores_older_log_rows(spark, tmp_path):
    root = str(tmp_path)
    logs.append_log(likes(spark, liked("1"), liked("2")), f"{root}/l")
    work = tasks(spark, "1").withColumn("run_id", F.lit("r"))
    stored = flow.persist_results(spark, work, f"{root}/none", f"{root}/l", root, version=1)
    assert [r.status for r in stored.collect()] == ["PARTIAL"]


def test_reports_and_files(spark, tmp_path):
    from enrichflow.operators.joins import join_results

    left = analyses(spark, ok("arxiv:cs/1", answers={"q1": "one", "q2": ""}), bad("arxiv:2", "WHY"), ok("arxiv:3", raw="all of it"))
    papers = tasks(spark, "cs/1", "2", "3").withColumn("run_id", F.lit("r"))
    joined = join_results(papers, left, likes(spark, liked("cs/1", 1)))
    rows = {r.file_name: r.body for r in reports.final_reports(joined).collect()}
    assert rows["cs__1.md"] == (
        "# Title cs/1\n\n- arXiv: cs/1\n- Status: COMPLETED\n- Likes: 1\n- Warnings: None\n\n## Questions\n\n1. q1\n2. q2\n\n"
        "## Answers\n\n### 1. q1\n\none\n"
    )
    assert "- Likes: FAILED\n- Warnings: MISSING_LIKES_RESULT, WHY\n" in rows["2.md"] and rows["2.md"].endswith("## Answers\n\nUnavailable\n")
    assert rows["3.md"].endswith("## Answers\n\nall of it\n")
    interim = {r.file_name: r.body for r in reports.interim_reports(papers, left).collect()}
    assert "- Status: ANALYSIS_COMPLETED\n- Likes: Pending\n- Warnings: Likes collection pending\n" in interim["cs__1.md"]
    assert "- Status: ANALYSIS_FAILED\n- Likes: Pending\n- Warnings: WHY\n" in interim["2.md"]
    folder = str(tmp_path / "out")
    snapshots.export_report_files(reports.final_reports(joined), folder)
    snapshots.export_report_files(reports.final_reports(joined), folder)
    assert {r.file_name: r.body for r in snapshots.read_report_files(spark, folder).collect()} == rows
    assert len([n for n in os.listdir(f"{folder}/run_id=r") if n.startswith("file_name=")]) == 3
    snapshots.export_jsonl(joined, str(tmp_path / "j"), "ord")
    back = logs.read_results(spark, str(tmp_path / "j"), JOINED_RESULT)
    assert {r.paper.arxiv_id for r in back.collect()} == {"cs/1", "2", "3"}


def test_empty_run_is_failed(spark):
    none = tasks(spark).withColumn("run_id", F.lit("r"))
    from enrichflow.operators.joins import join_results

    assert counts.run_counts(join_results(none, analyses(spark), likes(spark))).first().run_status == "FAILED"


def test_a_version_writes_only_runs_that_changed(spark, tmp_path):
    root = str(tmp_path)
    both = tasks(spark, "1", "2").withColumn("run_id", F.lit("r")).unionByName(tasks(spark, "1", "3").withColumn("run_id", F.lit("s")))
    logs.append_log(analyses(spark, ok("arxiv:1"), bad("arxiv:2"), ok("arxiv:3")), f"{root}/a")
    logs.append_log(likes(spark, liked("1", 1), liked("2", 2), liked("3", 3)), f"{root}/l")
    flow.persist_results(spark, both, f"{root}/a", f"{root}/l", root, version=1)

    def files(version, table="paper-results"):
        path = snapshots.version_path(root, table, version)
        return sorted(d for d in os.listdir(path) if d.startswith("run_id=")) if os.path.exists(path) else []

    def rows(frame):
        return sorted(frame.select("run_id", "paper.paper_key", "status", "likes.likes", "batch").collect())

    first = rows(snapshots.read_table(spark, root, "paper-results", 1))
    assert files(1) == ["run_id=r", "run_id=s"] and len(first) == 4
    again = flow.persist_results(spark, both, f"{root}/a", f"{root}/l", root, version=2, existing_version=1)
    assert files(2) == files(2, "reports") == [] and rows(again) == first
    assert rows(snapshots.read_table(spark, root, "paper-results", 2)) == first
    logs.append_log(analyses(spark, ok("arxiv:2")), f"{root}/a")
    third = flow.persist_results(spark, both, f"{root}/a", f"{root}/l", root, version=3, existing_version=2)
    assert files(3) == files(3, "papers") == ["run_id=r"] and len(rows(third)) == 4
    assert {r[2] for r in rows(third) if r[0] == "r"} == {"COMPLETED"}
    assert snapshots.read_table(spark, root, "reports", 3).count() == 4
    assert {r["run_id"]: r["held_by"] for r in snapshots._recorded(spark, root, 3).collect()} == {"r": 3, "s": 1}


def test_a_first_version_computes_its_results_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    from enrichflow.operators.joins import join_results

    papers = tasks(spark, "1", "2", "3").withColumn("run_id", F.lit("r"))
    rows = join_results(papers, analyses(spark, ok("arxiv:1")), likes(spark, liked("1", 1))).withColumn("batch", F.lit(1).cast("bigint"))
    rows = rows.join(rows.select("ord").mapInPandas(counted, "ord " + dict(rows.dtypes)["ord"]), "ord")
    snapshots.write_snapshot(rows, str(tmp_path), 1)
    assert seen.value == 3
    stored = os.listdir(f"{tmp_path}/paper-results/version=1/run_id=r")
    assert all(name.endswith((".zstd.parquet", ".zstd.parquet.crc")) for name in stored)


def test_an_unchanged_version_writes_no_rows(spark, tmp_path):
    root, work = str(tmp_path), tasks(spark, "1").withColumn("run_id", F.lit("r"))
    for version in (1, 2):
        flow.persist_results(spark, work, "none", "none", root, version=version, existing_version=version - 1 or None)
    assert not os.path.exists(f"{root}/paper-results/version=2")
    assert [r.status for r in snapshots.read_table(spark, root, "paper-results", 2).collect()] == ["FAILED"]


def test_report_files_of_a_mounted_folder(spark, tmp_path):
    """One plain file a folder, without checksum files. Odd names, equal names, reports written again, folders that stay."""
    folder, shape = str(tmp_path / "r"), "run_id string, file_name string, body string"
    many = spark.range(3000).selectExpr("'many' AS run_id", "id || '.md' AS file_name", "repeat('word ', 200) || id || '\\n' AS body")
    odd = [("7", "a=b%c:d.md", "é\n"), ("7", "two.md", "one\n"), ("7", "two.md", "one\n"), ("7", "two.md", "other"), ("x", "none.md", None)]
    snapshots.export_report_files(many, folder)
    assert snapshots.read_report_files(spark, folder).exceptAll(many).count() == 0
    assert os.listdir(f"{folder}/run_id=many/file_name=2999.md") == ["part-00000.txt"]
    snapshots.export_report_files(spark.createDataFrame(odd, shape), folder)
    back = snapshots.read_report_files(spark, folder)
    want = [("7", "a=b%c:d.md", "é\n"), ("7", "two.md", "one\n"), ("7", "two.md", "one\n"), ("7", "two.md", "other\n"), ("x", "none.md", "\n")]
    assert sorted(map(tuple, back.filter("run_id <> 'many'").collect())) == sorted(want) and back.count() == 3005
    snapshots.export_report_files(spark.createDataFrame([("7", "two.md", "new\n")], shape), folder)
    assert [r.body for r in snapshots.read_report_files(spark, folder).filter("file_name = 'two.md'").collect()] == ["new\n"]
    single = str(tmp_path / "s")
    snapshots.export_report_files(spark.createDataFrame([("1.md", "x\n")], "file_name string, body string"), single)
    assert [tuple(r) for r in snapshots.read_report_files(spark, single).collect()] == [("1.md", "x\n")]
    sink = spark.read.text(single, wholetext=True)  # the layout of Spark's own sink
    assert [tuple(r) for r in sink.collect()] == [("x\n", "1.md")]
