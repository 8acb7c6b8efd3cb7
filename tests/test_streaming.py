import random

from pyspark.sql import types as T

from enrichflow.operators import contracts, reports, taskstate
from enrichflow.operators.joins import join_results
from enrichflow.operators.keyed import protected_latest
from enrichflow.schemas import ANALYSIS, LIKES_RESULT, LONG, TEXT, row
from enrichflow.sources import logs
from enrichflow.streaming import latest
from enrichflow.streaming.upserts import start_each_batch
from tests.test_joins import analysis, liked, likes, tasks, unliked


def test_stream_latest_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", *"abcdefg"]), i, rng.choice(["PARTIAL", "PARTIAL", "COMPLETED"]), i * 2) for i in range(300)]
    schema = row(key=TEXT, ord=LONG, status=TEXT, v=LONG)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for part in range(3):
        spark.createDataFrame(shuffled[part * 100 : (part + 1) * 100], schema).write.mode("append").parquet(source)
        stream = latest.stream_latest(latest.file_stream(spark, source, schema, 2), ["key"], ["ord"])
        latest.start_sink(stream, out, state).awaitTermination()
    batch = protected_latest(spark.createDataFrame(rows, schema), ["key"], ["ord"])
    got = latest.current_rows(spark, out, ["key"])
    assert {tuple(r) for r in got.select(*batch.columns).collect()} == {tuple(r) for r in batch.collect()}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch written twice (a restart between sink and commit) leaves the same rows."""
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{out}/batch_id=0")
    assert latest.current_rows(spark, out, ["key"]).count() == 2


def test_interim_then_final_report(spark, tmp_path):
    result = row(status=TEXT, analysis=ANALYSIS, error_code=TEXT)
    schema = T.StructType([T.StructField("paper_key", TEXT), T.StructField("seq", LONG), T.StructField("analysis_result", result),
                           T.StructField("likes_result", LIKES_RESULT)])
    papers = tasks(spark, "1", "2", "3")
    good = {i: ("SUCCESS", analysis(f"arxiv:{i}"), None) for i in "12"} | {"3": ("FAILED", None, "WHY")}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed = latest.ReportFeed(out, schema, papers, buckets=3)
        latest.start_reports(latest.file_stream(spark, source, schema, 1), feed, state).awaitTermination()
        return {r.paper_key: r.body for r in feed.reports.current(spark).collect()}

    first = run([(f"arxiv:{i}", n, g, None) for n, (i, g) in enumerate(good.items())])
    found = spark.createDataFrame([(f"arxiv:{i}", *g) for i, g in good.items()], T.StructType([T.StructField("paper_key", TEXT), *result.fields]))
    wanted = {r.paper_key: r.body for r in reports.interim_reports(papers, found).collect()}
    assert first == wanted
    second = run([("arxiv:1", 10, None, liked("1", 4)), ("arxiv:3", 11, None, unliked("3"))])
    joined = join_results(papers, found, likes(spark, liked("1", 4), unliked("3")))
    final = {r.paper_key: r.body for r in reports.final_reports(joined).collect()}
    assert second == {"arxiv:1": final["arxiv:1"], "arxiv:2": wanted["arxiv:2"], "arxiv:3": final["arxiv:3"]}


def test_keyed_table_equals_batch_and_survives_replays(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", *"abcdefg", None]), i, rng.choice(["PARTIAL", "PARTIAL", "COMPLETED"]), i * 2) for i in range(300)]
    schema = row(key=TEXT, ord=LONG, status=TEXT, v=LONG)
    rng.shuffle(rows)
    table = latest.latest_table(str(tmp_path / "t"), schema, ["key"], ["ord"], buckets=4)
    assert table.current(spark).count() == 0
    for n in range(3):
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], schema)
        table.apply(part, n)
        once = sorted(map(str, table.current(spark).collect()))
        table.apply(part, n)  # a restart between the work and the commit of a batch
        assert sorted(map(str, table.current(spark).collect())) == once
        batch = protected_latest(spark.createDataFrame(rows[:(n + 1) * 100], schema), ["key"], ["ord"])
        assert once == sorted(str(r) for r in batch.select(*schema.names).collect())
    table.apply(spark.createDataFrame([("solo", 1000, "PARTIAL", 1)], schema), 3)
    held = table._record(spark)
    assert sorted(held.values())[-2:] == [2, 3] and table.current(spark).filter("key = 'solo'").count() == 1  # one bucket was rewritten
    assert {r.key for r in table.touched(spark.createDataFrame([("solo",), ("a",), ("none",)], "key string")).collect()} == {"solo", "a"}


def test_hot_task_is_read_chunk_by_chunk(spark, tmp_path):
    """A third of the events on one task, in small Arrow batches: the same steps as the fold of the whole log."""
    rng = random.Random(6)
    kinds = [taskstate.ENQUEUE, taskstate.CLAIM, taskstate.RESULT_OK, taskstate.RESULT_BAD]
    rows = [("r", "hot" if i % 3 == 0 else f"k{rng.randrange(9)}", i, rng.choice(kinds), rng.choice(["1", "2"]), i if i % 2 else None, "t", None)
            for i in range(600)]
    schema = row(run_id=TEXT, paper_key=TEXT, seq=LONG, kind=TEXT, arxiv_id=TEXT, likes=LONG, raw_text=TEXT, error_code=TEXT)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:350], rows[350:]):
        spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(source)
    names = {"spark.sql.streaming.stateStore.providerClass": latest.ROCKS, "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        steps = latest.stream_task_steps(latest.file_stream(spark, source, schema, 1))
        latest.start_sink(steps, out, state).awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {(r.paper_key, r.seq): (r.state, r.reason, r.likes) for r in spark.read.parquet(out).collect()}
    want = {}
    now = {}
    for _, key, seq, kind, own, likes, _, _ in rows:
        held, task = now.get(key, (None, None))
        after, reason = held, None
        if kind == taskstate.ENQUEUE:
            if held is not None:
                continue
            after, task = "PENDING", own
        elif held is None:
            reason = taskstate.UNKNOWN_TASK
        elif kind == taskstate.CLAIM:
            after, reason = ("CLAIMED", None) if held == "PENDING" else (held, taskstate.NOT_PENDING)
        elif own != task:
            reason = taskstate.OTHER_IDENTITY
        elif held == "CLAIMED":
            after = "SUCCESS" if kind == taskstate.RESULT_OK else "FAILED"
        else:
            reason = taskstate.ALREADY_SUCCEEDED if held == "SUCCESS" else taskstate.NOT_CLAIMED
        now[key] = (after, task)
        finished = reason is None and after in ("SUCCESS", "FAILED")
        want[key, seq] = (after, reason, likes if finished else None)
    assert got == want


def test_stream_of_a_log_equals_the_log(spark, tmp_path):
    log, good, bad, state = (str(tmp_path / n) for n in ("log", "good", "bad", "state"))
    take = logs.take_log(LIKES_RESULT, good, bad, contracts.likes_violations())
    for n in range(3):
        logs.append_log(likes(spark, liked("1", n), unliked(str(n + 2))), log)
        if n == 1:
            spark.createDataFrame([("{bad",), ("",), ('{"paper_key": "arxiv:9", "status": "SUCCESS", "other": 1}',),
                                   ('{"paper_key": "arxiv:9", "status": "SUCCESS"}',)], "value string").coalesce(1).write.mode("append").text(log)
        start_each_batch(logs.stream_log(spark, log, 1), take, state).awaitTermination()
        whole = logs.read_log(spark, log, LIKES_RESULT, contracts.likes_violations())
        rows = spark.read.parquet(good).drop("batch_id")
        assert sorted(map(str, rows.drop("_line").collect())) == sorted(map(str, whole.drop("_line").collect()))
        assert sorted(map(str, logs.latest_logged(rows).collect())) == sorted(map(str, logs.latest_logged(whole).collect()))
    assert spark.read.parquet(bad).count() == 3


def test_batches_of_a_replay_do_not_grow_with_its_files(spark, tmp_path):
    from enrichflow.queries.reporting import PARTS, replayed

    for parts in (2, 12):
        rows = spark.range(0, 400, 1, parts)
        stream = replayed(spark, rows.repartition(parts), "id", f"{tmp_path}/in{parts}")
        seen = []
        query = stream.writeStream.foreachBatch(lambda batch, n: seen.append(batch.count())).option("checkpointLocation", f"{tmp_path}/c{parts}")
        query.trigger(availableNow=True).start().awaitTermination()
        assert len(seen) <= PARTS and sum(seen) == 400


def test_a_task_with_nothing_to_show_makes_no_frame():
    import pandas as pd

    class Held:
        exists = staticmethod(lambda: True)
        get = staticmethod(lambda: ("SUCCESS", "1"))

    machine = latest.TaskMachine()
    machine.held = Held()

    def steps(*kinds):
        n = len(kinds)
        frame = pd.DataFrame({"seq": range(n), "kind": kinds, "arxiv_id": ["1"] * n, "likes": [1.0] * n, "raw_text": ["t"] * n, "error_code": [None] * n})
        return list(machine.handleInputRows(("r", "k"), iter([frame]), None))

    assert steps(taskstate.ENQUEUE) == []
    assert [r for f in steps(taskstate.ENQUEUE, taskstate.CLAIM, taskstate.RESULT_OK) for r in f["reason"]] == [
        taskstate.NOT_PENDING, taskstate.ALREADY_SUCCEEDED]
