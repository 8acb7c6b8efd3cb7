"""Line deduplication finds every block that an earlier document has."""
import random
from collections import defaultdict

import duckdb
import pytest

from enrichflow.llm import line_dedup as op
from enrichflow.llm.catalog import QUERIES
from tests.llm.test_line_dedup import SF, words


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.removed for r in op.deduplicated(docs).collect()}


def passage(name, lines=6):
    return "\n".join(f"line {k} of the passage {name} that is told again and again {k}" for k in range(lines))


def test_common_passage_goes_beside_a_rare_one(spark):
    rows = [(i, f"{passage('P')}\nown words of document number {i}") for i in range(1, 151)]
    rows += [(199, f"{passage('Q')}\nown words of document number 199"), (200, f"{passage('P')}\nbetween\n{passage('Q')}\nend")]
    got = removed(spark, rows)
    assert got[200] == [*range(6), *range(7, 13)] and got[199] == got[1] == [] and got[150] == [*range(6)]


def blocks(rows, least=20):
    """Line numbers, by doc_id, of all runs of lines with that many words that an earlier document holds; every pair of lines is looked at."""
    lines = {i: [x.strip(" \t\n\x0b\f\r") for x in t.split("\n")] for i, t in rows if t is not None}
    places = defaultdict(list)
    out = {}
    for i in sorted(lines):
        own, gone = lines[i], set()
        for k, x in enumerate(own):
            for earlier, at in places[x]:
                other = lines[earlier]
                if k and at and own[k - 1] == other[at - 1]:
                    continue  # not the first line of the block
                n = 1
                while k + n < len(own) and at + n < len(other) and own[k + n] == other[at + n]:
                    n += 1
                if sum(words(y) for y in own[k:k + n]) >= least:
                    gone.update(range(k, k + n))
        for k, x in enumerate(own):
            places[x].append((i, k))
        if gone:
            out[i] = sorted(gone)
    return out


def test_lines_with_different_owners_form_a_block(spark):
    a, b = "eight words that make up the first line", "twelve other words that make up the second line of this block"
    rows = [(1, f"{a}\nalone in one"), (2, f"alone in two\n{b}"), (3, f"in three\n{a}\n{b}\nends"), (4, f"in four\n{a}\n{b}\nstops")]
    assert words(a) + words(b) == 20
    assert removed(spark, rows) == {1: [], 2: [], 3: [], 4: [1, 2]}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_finds_every_block(spark, size):
    folder = SF.replace("sf0.01", size)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = {r.doc_id: r.removed for r in QUERIES["op7_line_dedup"].run(spark, folder).collect() if r.removed}
    assert got == blocks(rows) and got


@pytest.mark.parametrize("text", [" ".join(f"{k} verse" for k in range(200)).replace(" verse ", " verse\n"), "\n".join(f"行{k}" for k in range(60))])
def test_blocks_of_short_lines(spark, text):
    n = text.count("\n") + 1
    got = removed(spark, [(1, f"one\n{text}\nalone"), (2, f"two\nthree\n{text}\nother"), (3, text)])
    assert got == {1: [], 2: [*range(2, n + 2)], 3: [*range(n)]}


def test_repeated_and_moved_blocks(spark):
    p, q = passage("P", 3), passage("Q", 3)
    rows = [(1, f"u\n{p}\nv"), (2, f"x\n{p}\ny\n{p}\nz"), (11, f"{q}\nmiddle of eleven\n{passage('R', 3)}"), (12, f"{passage('R', 3)}\nin twelve\n{q}"),
            (21, f"{passage('S', 3)}\nm\n{passage('S', 3)}"), (22, f"n\n{passage('S', 3)}\no")]
    assert removed(spark, rows) == {1: [], 2: [1, 2, 3, 5, 6, 7], 11: [], 12: [0, 1, 2, 4, 5, 6], 21: [], 22: [1, 2, 3]} == {
        1: [], 11: [], 21: [], **blocks(rows)}


@pytest.mark.parametrize("seed", range(40))
def test_common_blocks_are_all_found(seed):
    draw = random.Random(seed)
    a, b = ([draw.randrange(5) for _ in range(draw.randrange(60))] for _ in range(2))
    count = [0, 1, 7, 11, 19]
    text = lambda x: "\n".join(" ".join([f"w{v}"] * count[v]) for v in x)
    assert op.common_blocks(a, b, [count[v] for v in b], 20) == blocks([(1, text(a)), (2, text(b))]).get(2, [])
