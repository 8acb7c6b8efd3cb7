"""Snapshot collapse next to plain Python."""
import random

import pytest

from enrichflow.llm import chat as op
from enrichflow.llm.catalog import QUERIES
from tests.conftest import plan_of

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """conv_id to (turns, copies, rendered text); turn numbers must be distinct within a conversation."""
    turns = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role, text))
    said = {c: tuple(x[1:] for x in sorted(t, key=lambda x: -(1 << 63) if x[0] is None else x[0])) for c, t in turns.items()}
    inner = {t[:k] for t in said.values() for k in range(1, len(t))}
    out = {}
    for conv in sorted(said):
        own = said[conv]
        if own not in inner and own not in {said[c] for c in out}:
            text = "".join(f"<|{'unknown' if r is None else r}|>\n{(t or '').replace('<|', '<' + chr(92) + '|')}<|end|>\n" for r, t in own)
            out[conv] = (len(own), sum(v == own for v in said.values()), text)
    return out


def answer(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.conv_id, r.chunk)):
        assert out.get(r.conv_id, (r.n_turns,))[0] == r.n_turns
        out[r.conv_id] = (r.n_turns, r.n_copies, out.get(r.conv_id, (0, 0, ""))[2] + r.text)
    return out


def test_query_equals_brute_force(spark):
    frame = QUERIES["op10_chat"].run(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert answer(frame) == want
    assert "Python" not in plan_of(frame) and "InArrow" not in plan_of(frame)


@pytest.mark.parametrize("seed", range(2))
def test_snapshots(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "CHUNK", 2)
    draw = random.Random(seed)
    rows = []
    for conv in range(60):
        topic = draw.randrange(4)
        for k in range(draw.randrange(1, 9)):
            fork = draw.random() < 0.03
            rows.append((conv, 2 * k + 5 * (conv % 3), "user" if k % 2 == 0 else "assistant", f"say {topic} {k} {'!' * fork}"))
    frame = op.rendered(spark.createDataFrame(rows, SCHEMA))
    assert answer(frame) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, None), (3, None, "user", "hi"), (3, 7, None, None),
            (None, 0, "user", "hi"), (4, 0, "user", "<|end|> fake"), (5, 0, None, "user"), (6, 0, "user", None), (7, 0, "user", "x" * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n int")
    got = answer(op.rendered(docs))
    assert got == brute(rows) and got[2][:2] == (2, 2) and 1 not in got and 3 not in got
    assert op.rendered(docs.limit(0)).count() == 0
    long = spark.range(2000).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    parts = op.rendered(long.unionByName(long.filter("turn < 1999").withColumn("conv_id", op.F.lit(0)))).collect()
    assert {r.conv_id for r in parts} == {1} and len(parts) == 8
    tied = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x")], SCHEMA)
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in op.rendered(tied).collect()] == [(1, 2, 2)]
