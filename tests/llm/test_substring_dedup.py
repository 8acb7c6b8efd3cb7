"""Substring deduplication next to a brute-force version."""
import hashlib
import re

import duckdb
import pytest

from enrichflow.llm import substring_dedup as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, window):
    """doc_id, words, removed words, kept text for (doc_id, text)."""
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i, words in texts.items():
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, words in texts.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"].run(spark, SF).collect()}
    assert got == brute(rows, 50)
    assert sum(n for _, n, _ in got.values()) > 0


@pytest.mark.parametrize("window, block", [(3, 2), (5, 2), (9, 5)])
def test_small_windows(spark, window, block):
    import random

    draw = random.Random(window)
    rows = [(i, "\t ".join(draw.choice("abcé") for _ in range(draw.choice([0, 1, 7, 30])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.spans)
           for r in op.changed_texts(docs, window, block).collect()}
    want = brute(rows, window)
    assert {i: v[:3] for i, v in got.items()} == {i: v for i, v in want.items() if v[1]}
    assert all(n == sum(s.end - s.start for s in spans) for _, n, _, spans in got.values())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, long, "x"), (5, long, "x"), (5, long, "x"), (None, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").selectExpr("*", "n_words AS keys")
    got = op.changed_texts(docs).collect()
    assert {(r.doc_id, r.n_removed, r.kept_text) for r in got} == {(5, 400_000, "")}
    assert op.digests(docs).count() == 7
    assert op.changed_texts(docs.limit(0)).count() == 0
