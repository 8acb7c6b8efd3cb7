import random

import pytest

from enrichflow.operators import joins, keyed


@pytest.fixture(scope="module")
def log():
    rng = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rng.randrange(40)}" for _ in range(600)]
    rng.shuffle(keys)
    states = ["COMPLETED", "PARTIAL", "FAILED"]
    return [(k, i, rng.choice(states) if k != "hot" else states[1 + i % 2], i * 10) for i, k in enumerate(keys)]


def frame(spark, log):
    rows = list(log)
    random.Random(9).shuffle(rows)
    return spark.createDataFrame(rows, "key string, ord long, status string, v long").repartition(7)


def as_dict(df, *cols):
    return {r["key"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_first_and_last(spark, log):
    df = frame(spark, log)
    first, last, n = {}, {}, {}
    for k, o, s, v in log:
        first.setdefault(k, (o, s, v))
        last[k] = (o, s, v)
        n[k] = n.get(k, 0) + 1
    got = keyed.first_per_key(df, ["key"], ["ord"], copies="n")
    assert as_dict(got, "ord", "status", "v") == first and as_dict(got, "n") == {k: (c,) for k, c in n.items()}
    assert as_dict(keyed.last_per_key(df, ["key"], ["ord"]), "ord", "status", "v") == last


def test_protected_latest_is_a_row_by_row_upsert(spark, log):
    stored = {}
    for k, o, s, v in log:
        if stored.get(k, (0, ""))[1] != "COMPLETED":
            stored[k] = (o, s, v)
    got = keyed.protected_latest(frame(spark, log), ["key"], ["ord"])
    assert as_dict(got, "ord", "status", "v") == stored


def test_upsert_against_brute_force(spark, log):
    """Batches in turn: keys completed before a batch are refused, otherwise the batch's last row wins."""
    stored, order, accepted = {}, {}, {}
    existing = spark.createDataFrame([], "key string, batch long, ord long, status string, v long")
    for batch, start in enumerate(range(0, len(log), 250)):
        part = log[start : start + 250]
        done = {k for k, row in stored.items() if row[0] == "COMPLETED"}
        accepted = {}
        for k, o, s, v in part:
            if k not in done:
                order.setdefault(k, (batch, o))
                stored[k] = (s, v)
                accepted[k] = accepted.get(k, 0) + 1
        merged = keyed.upsert(existing, frame(spark, part), ["key"])
        rows = [tuple(r) for r in merged.collect()]
        assert {r[0]: r[5] for r in rows if r[5]} == accepted
        existing = spark.createDataFrame(
            [(k, batch if b is None else b, o, s, v) for k, b, o, s, v, _ in rows], existing.schema
        )
    assert {r["key"]: (r["status"], r["v"]) for r in existing.collect()} == stored
    assert {r["key"]: (r["batch"], r["ord"]) for r in existing.collect()} == order


def test_completed_value_stays(spark):
    existing = spark.createDataFrame([("a", 0, 0, "COMPLETED", 83)], "key string, batch long, ord long, status string, v long")
    new = spark.createDataFrame([("a", 0, "COMPLETED", 84), ("b", 1, "PARTIAL", 1)], "key string, ord long, status string, v long")
    got = {r["key"]: (r["v"], r["accepted"]) for r in keyed.upsert(existing, new, ["key"]).collect()}
    assert got == {"a": (83, 0), "b": (1, 1)}


def test_merge_by_priority(spark):
    inputs = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "key string, ord int")
    low = spark.createDataFrame([("a", "low"), ("b", "low"), ("z", "low")], "key string, s string")
    high = spark.createDataFrame([("b", "high"), ("c", "high")], "key string, s string")
    got = joins.merge_by_priority([low, high], inputs, "key").orderBy("ord").collect()
    assert [(r["key"], r.s) for r in got] == [("c", "high"), ("a", "low"), ("b", "high")]


def test_reductions_aggregate_before_the_shuffle(spark, log):
    from tests.conftest import plan_of

    df = frame(spark, log)
    for reduced in (
        keyed.first_per_key(df, ["key"], ["ord"]),
        keyed.last_per_key(df, ["key"], ["ord"]),
        keyed.protected_latest(df, ["key"], ["ord"]),
    ):
        plan = plan_of(reduced)
        assert "partial_m" in plan and "Window" not in plan
    assert "WindowGroupLimit" in plan_of(keyed.first_n_cutoff(df, ["key"], "ord", 5))
