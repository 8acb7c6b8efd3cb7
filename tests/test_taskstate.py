import random

import pytest
from enrichflow.operators import taskstate
from enrichflow.schemas import TASK_EVENT
from enrichflow.streaming import latest


def event(run, seq, kind, key, own_id="1", likes=None):
    return (run, seq, kind, key, f"Title {key}", f"https://arxiv.org/abs/{key}", own_id, likes, None, None)


def machine(events):
    """The task store applied one event at a time."""
    tasks, refused = {}, set()
    for run, seq, kind, key, *_rest in sorted(events, key=lambda e: e[1]):
        own_id = _rest[2]
        task = tasks.get((run, key))
        if kind == "enqueue":
            if task is None:
                tasks[run, key] = {"state": "PENDING", "id": own_id, "attempts": 0, "seq": seq}
            continue
        if kind not in ("claim", "success", "failure"):
            continue
        if task is None:
            reason = "UNKNOWN_TASK"
        elif kind == "claim":
            reason = None if task["state"] == "PENDING" else "NOT_PENDING"
        elif own_id != task["id"]:
            reason = "OTHER_IDENTITY"
        elif task["state"] == "SUCCESS":
            reason = "ALREADY_SUCCEEDED"
        else:
            reason = None if task["state"] == "CLAIMED" else "NOT_CLAIMED"
        if reason:
            refused.add((run, key, seq, kind, reason))
        elif kind == "claim":
            task.update(state="CLAIMED", attempts=1)
        else:
            task["state"] = "SUCCESS" if kind == "success" else "FAILED"
    return {k: (t["state"], t["attempts"], t["seq"]) for k, t in tasks.items()}, refused


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    kinds = ["enqueue", "claim", "success", "failure", "other"]
    keys = ["hot"] * 30 + [f"k{i}" for i in range(40)]
    return [event(rng.choice("ab"), i, rng.choice(kinds), rng.choice(keys), rng.choice(["1", "1", "1", "2"])) for i in range(900)]


@pytest.mark.parametrize("bits", [3, 7, 20])
def test_fold_and_audit_against_the_machine(spark, events, monkeypatch, bits):
    monkeypatch.setattr(taskstate, "_BLOCK_BITS", bits)
    states, refused = machine(events)
    rows = list(events)
    random.Random(1).shuffle(rows)
    log = spark.createDataFrame(rows, TASK_EVENT).repartition(5)
    folded = taskstate.fold_states(log)
    assert {(r.run_id, r.paper_key): (r.state, r.attempts, r.seq) for r in folded.collect()} == states
    audit = taskstate.audit_rows(log, folded)
    assert {(r.run_id, r.paper_key, r.seq, r.kind, r.reason) for r in audit.collect()} == refused
    terminal = taskstate.terminal_results(folded, "run_id").collect()
    assert {(r.run_id, r.paper_key) for r in terminal} == {k for k, v in states.items() if v[0] in ("SUCCESS", "FAILED")}
    stuck = {r.run_id: r.stuck for r in taskstate.stuck_claims(folded).collect()}
    assert sum(stuck.values()) == sum(v[0] == "CLAIMED" for v in states.values())


def test_stream_equals_batch_over_restarts(spark, events, tmp_path):
    states, refused = machine(events)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        rows = spark.createDataFrame(events[part * 300 : (part + 1) * 300], TASK_EVENT)
        rows.coalesce(1).write.mode("append").parquet(source)
        steps = latest.stream_task_steps(latest.file_stream(spark, source, TASK_EVENT, 1))
        latest.start_sink(steps, out, state).awaitTermination()
    steps = spark.read.parquet(out)
    got = {(r.run_id, r.paper_key): (r.state, r.attempts) for r in latest.states_from_steps(steps).collect()}
    assert got == {k: v[:2] for k, v in states.items()}
    assert {tuple(r) for r in latest.refused_from_steps(steps).collect()} == refused


def test_insert(spark):
    columns = "run_id string, paper_key string, title string, arxiv_url string, arxiv_id string, seq long"
    stored = spark.createDataFrame([("r", "a", "A", "u", "1", 0)], columns)
    offered = [
        ("r", "a", "A", "u", "1", 5), ("r", "a", "A", "u", "1", 6), ("r", "a", "other", "u", "1", 7),
        ("r", "b", "B", "u", "2", 8), ("r", "b", "B", "u", "2", 9), ("s", "a", "A", "u", "1", 10),
        ("r", "c", "first", "u", "3", 11), ("r", "c", "second", "u", "3", 12),
    ]
    inserts = taskstate.insert_tasks(stored, spark.createDataFrame(offered, columns).repartition(4))
    assert taskstate.insert_counts(inserts).first().asDict() == {"inserted": 3, "existing": 3, "conflicts": 2}
    conflicts = {(r.paper_key, r.title) for r in inserts.filter("conflicts > 0").collect()}
    assert conflicts == {("a", "other"), ("c", "second")}
    pending = taskstate.pending_rows(inserts)
    assert {(r.run_id, r.paper_key, r.title, r.state) for r in pending.collect()} == {("s", "a", "A", "PENDING")}
    sound = taskstate.insert_tasks(stored, spark.createDataFrame([o for o in offered if o[2] not in ("other", "second")], columns))
    assert {(r.run_id, r.paper_key, r.title, r.state) for r in taskstate.pending_rows(sound).collect()} == {
        ("r", "b", "B", "PENDING"), ("s", "a", "A", "PENDING"), ("r", "c", "first", "PENDING")
    }
    empty = taskstate.insert_tasks(stored, spark.createDataFrame([], columns))
    assert taskstate.insert_counts(empty).first().asDict() == {"inserted": 0, "existing": 0, "conflicts": 0}


def test_next_is_first_in_first_out(spark):
    log = [event("r", 1, "enqueue", "a"), event("r", 2, "enqueue", "b"), event("s", 3, "enqueue", "c"), event("r", 4, "claim", "a")]
    tasks = taskstate.fold_states(spark.createDataFrame(log, TASK_EVENT))
    got = {r.run_id: (r.paper_key, r.attempts, r.state) for r in taskstate.next_pending(tasks).collect()}
    assert got == {"r": ("b", 1, "CLAIMED"), "s": ("c", 1, "CLAIMED")}
    counts = {(r.run_id, r.state): r.n for r in taskstate.run_states(tasks).collect()}
    assert counts["r", "CLAIMED"] == 1 and counts["r", "PENDING"] == 1 and counts["s", "SUCCESS"] == 0


def test_success_is_not_overwritten(spark):
    log = [event("r", 1, "enqueue", "a"), event("r", 2, "claim", "a"), event("r", 3, "success", "a", likes=7), event("r", 4, "failure", "a")]
    df = spark.createDataFrame(log, TASK_EVENT)
    folded = taskstate.fold_states(df)
    assert (folded.first().state, folded.first().likes) == ("SUCCESS", 7)
    assert taskstate.audit_rows(df, folded).first().reason == "ALREADY_SUCCEEDED"


def test_no_step_gathers_a_whole_key(spark, events):
    from tests.conftest import plan_of

    plan = plan_of(taskstate.fold_states(spark.createDataFrame(events, TASK_EVENT)))
    assert "Window" not in plan and "collect_" not in plan and "NestedLoop" not in plan
