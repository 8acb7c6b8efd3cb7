"""Line alignment next to plain Python."""
import random
import re
from collections import defaultdict

import duckdb
import pytest

from enrichflow.llm import line_dedup as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, anchor=5, rare=100, block=20):
    """Removed line numbers by doc_id; every document has its own id."""
    lines = {i: [x.strip(" \t\n\x0b\f\r") for x in t.split("\n")] for i, t in rows if t is not None}
    holders = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            if words(x) >= anchor:
                holders[x].add(i)
    out = {}
    for i, own in lines.items():
        best = {}
        for x in set(own):
            if len(holders.get(x, ())) > 1 and min(holders[x]) < i:
                best[min(holders[x])] = min(best.get(min(holders[x]), 1 << 60), len(holders[x]))
        gone = set()
        for owner, n in best.items():
            if n <= rare or n == min(best.values()):
                gone.update(op.common_blocks(lines[owner], own, [words(x) for x in own], block))
        if gone:
            out[i] = sorted(gone)
    return out


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r.removed for r in QUERIES["op7_line_dedup"].run(spark, SF).collect()}
    want = brute(rows)
    assert {i: x for i, x in got.items() if x} == want and len(got) == len(rows) and want


@pytest.mark.parametrize("seed", range(30))
def test_patience(seed):
    draw = random.Random(seed)
    a = [draw.randrange(12) for _ in range(draw.randrange(25))]
    b = [draw.randrange(12) for _ in range(draw.randrange(25))] if seed % 3 else a[3:] + a[:3]
    got = op.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert op.patience(a, a) == [(i, i) for i in range(len(a))]
    keep = op.increasing(b)
    best = [1] * len(b)
    for i in range(len(b)):
        best[i] = 1 + max((best[j] for j in range(i) if b[j] < b[i]), default=0)
    assert len(keep) == max(best, default=0) and all(b[i] < b[j] for i, j in zip(keep, keep[1:]))


def test_moved_line_is_anchored_by_unique_lines():
    assert op.patience([1, 2, 3, 4, 5], [1, 4, 2, 3, 5]) == [(0, 0), (1, 2), (2, 3), (4, 4)]
    assert op.common_blocks([1, 9, 2], [1, 8, 2], [30, 1, 5], 20) == [0]


def test_odd_rows(spark):
    passage = "\n".join(f"line {k} of a passage that is told again and again {k}" for k in range(4))
    rows = [(1, f"start one\n{passage}\nend one"), (2, f"other\n\n {passage}\t\nlast"), (3, passage), (3, passage), (4, None), (5, ""),
            (None, passage), (6, "short\nline"), (7, "short\nline"), (8, "x y z u v w\n" * 30_000 + passage), (3, passage + "\nmore")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, n_lines string")
    got = {(r.doc_id, r.text, len(r.removed)) for r in op.deduplicated(docs).collect()}
    assert {(1, rows[0][1], 0), (2, "other\n\nlast", 4), (3, "", 4), (3, "more", 4), (4, None, 0), (5, "", 0), (None, passage, 0), (6, "short\nline", 0),
            (7, "short\nline", 0)} <= got
    assert next(n for i, _, n in got if i == 8) == 4 and op.deduplicated(docs).count() == 11
    assert op.deduplicated(docs.limit(0)).count() == 0


def test_large_group_keeps_its_first(spark):
    passage = "\n".join(f"line {k} of a passage that is told again and again {k}" for k in range(6))
    rows = [(i, f"{passage}\nown words of document number {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: len(r.removed) for r in op.deduplicated(docs, rare=3).collect()}
    assert got == {i: 6 if i else 0 for i in range(150)}
