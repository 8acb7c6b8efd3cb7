"""Repetition rules next to brute force."""
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from enrichflow.llm import repetition as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(WORD, text or "")
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        lines += line in seen and bool(re.search(WORD, line))
        seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(again), n < 50 or 100 * len(again) > 50 * n)


def brute_lengths(words):
    """Longest repeat from each position, by comparing all pairs."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = QUERIES["op2_repetition"].run(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {
        i: base(t) for i, t in rows}
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    draw = random.Random(seed)
    texts = [[draw.choice("ab" if seed % 2 else "abcdefgh") for _ in range(draw.choice([0, 1, 2, 9, 40]))] for _ in range(7)]
    symbols = np.array([hash((i, w)) for i, t in enumerate(texts) for w in t], np.int64).astype(np.uint64)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    assert op.longest_repeats(symbols, ends).tolist() == [n for t in texts for n in brute_lengths(t)]


def test_limits(spark):
    plain = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(60))
    line = " ".join(f"k{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, plain), (4, f"{plain} {passage} x {passage}"), (5, f"{plain}\n{line}\n{line}"),
            (6, "a " * 300_000), (7, plain), (None, plain)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: r for r in op.judged(docs).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, None: True}
    assert (got[4].longest_repeat, got[4].covered_words, got[4].n_repeats) == (60, 120, 2)
    assert (got[5].longest_repeat, got[5].n_dup_lines, got[6].longest_repeat) == (12, 1, 299_999)
    assert op.judged(docs.limit(0)).count() == 0


def test_measured_on_slices():
    column = pa.array(["a b", None, "é é\n\né é", "c d e"]).slice(1, 2)
    assert [v.tolist() for v in op.measured(op.Words(column), 2).values()] == [
        [0, 4], [0, 4], [0, 0], [0, 1], [0, 4], [0, 4], [0, 3], [0, 2]]
