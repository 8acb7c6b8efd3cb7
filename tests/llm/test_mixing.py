import random

import pytest

from enrichflow.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "other", "columns") for i, t, s in rows], SCHEMA)


def words(n):
    return " ".join(["w"] * n)


def shares(size, weights=(1, 2, 3), limit=3):
    """Targets by resharing the excess, source by source."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, full = sum(size.values()), {}, set()
    while len(full) < len(names):
        level = (total - sum(limit * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        out = {s: limit * size[s] if s in full else level * weight[s] for s in names}
        over = {s for s in names if out[s] > limit * size[s] and s not in full}
        if not over:
            break
        full |= over
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_targets_are_met_and_reruns_agree(spark, block):
    draw = random.Random(1)
    rows = [(i, words(draw.choice([1, 5, 9, 40])), draw.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    rows += [(1000, words(3), "tiny"), (None, words(4), "b"), (None, words(4), "b"), (5, words(7), "a"), (5, words(7), "a"), (2000, None, "a"),
             (2001, "", "b"), (2002, " \t ", "hot"), (2003, None, "nothing")]
    docs = docs_of(spark, rows)
    got = mixing.mixed(docs, block=block).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    want = shares(size)
    assert want["tiny"] == 9.0
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert abs(r["copies"] - want[r["source"]] / max(size[r["source"]], 1)) < 1 or not r["size"]
        taken[r["source"]] += r["taken"]
    for source in size:
        assert abs(taken[source] - want[source]) <= 40
    again = mixing.mixed(docs.repartition(5), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_seed_changes_the_draw(spark):
    docs = docs_of(spark, [(i, words(1 + i % 9), "ab"[i % 2]) for i in range(200)])
    one, two = (sorted(map(tuple, mixing.mixed(docs, seed=s).collect()), key=str) for s in (1, 2))
    assert one != two


def test_pivot_keeps_the_expected_words_and_is_fair():
    size, p, n = [9, 4, 7, 1, 3], [0.3, 0.5, 0.2, 0.9, 0.6], 4000
    sums = [0.0] * 5
    for k in range(n):
        out, open_ = mixing.pivot(size, p, random.Random(k))
        assert sum(a * b for a, b in zip(size, out)) == pytest.approx(sum(a * b for a, b in zip(size, p)))
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != open_)
        sums = [a + b for a, b in zip(sums, out)]
    assert [x / n for x in sums] == pytest.approx(p, abs=0.04)
    assert mixing.pivot([], [], random.Random(0)) == ([], -1) and mixing.pivot([0, 5], [0.5, 0.0], random.Random(0)) == ([0.0, 0.0], -1)


def test_empty_tables_and_no_words(spark):
    assert mixing.mixed(docs_of(spark, [])).collect() == []
    got = mixing.mixed(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0), (0, 0.0)]
