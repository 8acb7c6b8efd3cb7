"""The Jaccard join next to a brute-force version."""
import random
import re
from collections import defaultdict

import duckdb
import pytest

from enrichflow.llm import jaccard_join as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}
        sets[i] = grams or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i in sets:
        for g in sets[i]:
            holders[g].append(i)
    for i in sets:
        common = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                common[j] += j < i
        for j, n in common.items():
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def answer(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = brute(rows, 3, 90)
    assert answer(QUERIES["op6_jaccard_join"].run(spark, SF)) == want
    assert len({c for _, c in want.values()}) < len(want)


def near_copies(seed):
    draw = random.Random(seed)
    rows = []
    for base in range(8):
        words = [f"{draw.randrange(40 if base < 3 else 5000)}" for _ in range(draw.choice([2, 9, 14, 30, 90, 300]))]
        for _ in range(12):
            own = list(words)
            for _ in range(draw.randrange(1 + len(own) // 25)):
                own[draw.randrange(len(own))] = str(draw.randrange(99999))
            if draw.random() < 0.2:
                own = own[:-1]
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("how, size, percent", [
    (None, 3, 90), (None, 2, 70), ((0, 1), 3, 90), ((1, 2), 3, 90), ((1, 3), 3, 90), ((1, 0), 3, 90), ((1, 0), 2, 70)])
def test_allocations(spark, how, size, percent):
    def fixed(low, top, nodes, p):
        most = op.difference(top, top, p)
        return (most // (how[0] + 1) + 1, *how) if most else None

    rows = near_copies(7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = answer(op.linked(docs, size, percent, fixed if how else op.allocate))
    assert got == brute(rows, size, percent)


def test_allocation_follows_cost():
    assert op.allocate(9, 20, 100, 90)[1] == 0
    assert op.allocate(15, 20, 10**9, 90)[1:] == (1, 0)
    assert op.allocate(1, 8, 100, 90) is None


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b c"), (4, "a B c"), (4, "a b c"), (None, "a b c"), (6, "a"), (5, "A"), (7, "x " * 100_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, node string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in op.linked(docs, 3, 90).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7)]
    assert op.linked(docs.limit(0)).count() == 0
