import math
import random
import re

import numpy as np
import pytest

from enrichflow.llm import treap

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, score string, rank string, item_id string"
ITEMS = "item_id bigint, text string, doc_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "other", "columns", "here") for i, t in rows], SCHEMA)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], ITEMS)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, terms(t)) for i, t in docs if i is not None]
    n, total = sum(1 for _, ts in docs if ts), sum(len(ts) for _, ts in docs)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, own in asked.items():
        scored = []
        for doc, ts in docs:
            m = 10 + 90 * len(ts) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * ts.count(t) // (1000 * ts.count(t) + 8 * m))
                        for t in own if t in ts)
            if score > 0:
                scored.append((-score, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])}
    return out


def found(spark, docs, items, k=10, **kw):
    frame = docs_of(spark, docs).repartition(3)
    n, total = treap.statistics(frame)
    rows = treap.search(treap.index(frame, n, total, **kw), items_of(spark, items), n, k)
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("seed,size", [(1, 200), (2, 3000), (3, 1 << 20)])
def test_equals_brute_force(spark, seed, size):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "中文", "A", "a", "ÀB"]
    docs = [(i * 3, " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(65)], k=draw.randrange(0, 30)))) for i in range(250)]
    docs += [(10_000 + i, docs[5][1]) for i in range(40)]  # a group of copies: equal scores
    docs += [(None, "w1 w2"), (1, None), (2, ""), (4, "?! --"), (5, "w1 " * 5000), (9, docs[3][1].upper())]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 12)))) for i in range(25)]
    items += [(100, docs[5][1]), (101, "nowhere to be found?"), (102, None), (103, ""), (None, "w1"), (104, "w3"), (104, "w4")]
    draw.shuffle(docs)
    assert found(spark, docs, items, range_bytes=size) == brute(docs, items)


def test_several_passes_and_other_k(spark):
    docs = [(i, f"a b{i % 7} c{i % 11}") for i in range(300)]
    items = [(i, f"b{i % 7} c{i % 5}") for i in range(30)]
    frame = docs_of(spark, docs)
    n, total = treap.statistics(frame)
    index = treap.index(frame, n, total, 500)
    assert {tuple(r) for r in treap.search(index, items_of(spark, items), n, 3, at_once=7).collect()} == brute(docs, items, 3)


def test_repeated_rows_are_documents_of_their_own(spark):
    got = found(spark, [(1, "x y"), (1, "x y"), (2, "z")], [(0, "x")])
    assert {r[1:3] for r in got} == {(1, 1), (2, 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(0, "x")]) == set() and found(spark, [(1, "x y")], []) == set() and found(spark, [(1, None)], [(0, "x")]) == set()


def test_a_stored_treap_opens_again_and_prunes():
    draw = np.random.default_rng(0)
    cells = np.unique(draw.integers(0, 300 * 900, 4000))
    row, column = cells // 900, cells % 900
    impact = draw.integers(1, 1_000_000, len(cells))
    impact[column == 700] = 999_999_999 // 1000
    tree = treap.build(row, column, impact, 900)
    again = treap.opened(treap.packed(tree))
    assert all((a == b).all() for a, b in zip(tree.largest, again.largest)) and all((a == b).all() for a, b in zip(tree.bits, again.bits))
    best = treap.Best(5)
    rows, weights, docs = np.arange(0, 300, 30), np.arange(1, 11), np.arange(900)
    opened = treap.descend(again, rows, weights, docs, best, width=1)
    scores = np.zeros(900, np.int64)
    for r, w in zip(rows, weights):
        np.add.at(scores, column[row == r], w * impact[row == r])
    order = np.lexsort((docs, -scores))[:5]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == scores[order].tolist()
    assert opened < 900


def test_index_rows_are_read_a_few_at_a_time(spark, monkeypatch):
    """Neither a row group nor a batch for Python holds many ranges, whatever the partition holds."""
    import pyarrow.parquet as pq

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, stored, limits, batch = spark.conf.get(key), [], [], getattr(treap, "BATCH_BYTES", 1 << 16)
    build, store = treap.index, treap.written

    def written(frame, *args, **kw):
        limits.append(int(spark.conf.get(key).rstrip("b")))
        stored.append(store(frame, *args, **kw))
        return stored[-1]

    monkeypatch.setattr(treap, "written", written)
    monkeypatch.setattr(treap, "index", lambda docs, n, total: build(docs, n, total, 1 << 20))
    draw = random.Random(5)
    docs = [(i, " ".join(str(draw.randrange(100_000)) for _ in range(8_000))) for i in range(300)]
    items = [(i, docs[i][1][:200]) for i in range(3)]
    found = treap.ranked_search(docs_of(spark, docs).coalesce(1), items_of(spark, items), 1)
    assert {(r["item_id"], r["doc_id"]) for r in found.collect()} == {(i, i) for i in range(3)}
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in stored[0].inputFiles()]
    sizes = [(g.row_group(i).num_rows, g.row_group(i).total_byte_size) for g in groups for i in range(g.num_row_groups)]
    assert sum(rows for rows, _ in sizes) > 5 and all(rows == 1 or size < 3 * batch for rows, size in sizes)
    assert set(limits) == {batch} and spark.conf.get(key) == before


def test_batches_bound_what_python_gets_at_once(spark):
    from enrichflow.sources.scratch import batches

    def sizes(parts):
        import pyarrow as pa

        for part in parts:
            yield pa.record_batch({"n": [part.num_rows]})

    rows = spark.range(64).coalesce(1).selectExpr("repeat('x', 100000) AS x")
    with batches(spark, 1 << 20):
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()) <= 12
    assert [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()] == [64]
