"""Forward-backward against enumeration, and held-out accuracy."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from enrichflow.llm import toxicity as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.1"


def enumerated(scores, moves):
    a = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
    total, toxic = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        p, last = 1.0, 0
        for s, state in zip(scores, states):
            p *= a[last, state] * np.exp(s * state)
            last = state
        total += p
        toxic += p * np.array(states)
    return toxic / total


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3)
    draw = np.random.default_rng(3)
    sizes = [4, 0, 1, 9, 3, 11]
    first = np.append(0, np.cumsum(sizes))
    scores, moves = draw.normal(0, 2, first[-1]), np.array([-1.0, 0.3, 0.8])
    want = np.concatenate([enumerated(scores[a:b], moves) for a, b in zip(first[:-1], first[1:])])
    assert np.allclose(op.marginals(scores, first, moves), want)


def test_gradient_steps_raise_likelihood_of_labels():
    draw = np.random.default_rng(5)
    features = (draw.integers(0, 50, (20, 30, op.TEMPLATES)) + 50 * np.arange(op.TEMPLATES)).astype(np.int32)
    target = (features[:, :, 0] < 5).astype(float)
    weights, moves = op.fit_chain(features, target, np.ones(target.shape, bool))
    scores = weights[features].sum(-1) + weights[op.DIMENSIONS]
    p = op.marginals(scores.T.ravel(), np.arange(31) * 20, moves).reshape(30, 20).T
    assert p[target == 1].mean() > 0.8 and p[target == 0].mean() < 0.1


def test_held_out_accuracy(spark):
    got = QUERIES["op1_toxicity"].run(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    rows = got.select("score", "predicted", F.col("toxic").alias("label"), F.size("spans").alias("n")).collect()
    right = sum(r.predicted == r.label for r in rows) / len(rows)
    found = sum(r.predicted for r in rows if r.label) / sum(r.label for r in rows)
    assert right > 0.97 and found > 0.8
    assert all(r.n for r in rows if r.predicted) and all(0 <= r.score <= 1 for r in rows)


def test_spans_and_odd_rows(spark):
    filler = "é und der wort mit satz".split()
    train = [(i, " ".join(filler[(i + k) % 6] for k in range(20)) + (" vile, vilest" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame(train, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, "z") for i, _ in train] + [(None, 1, "z"), (3, None, "z"), (1, 1, "z")],
                                   "doc_id bigint, toxic int, text string")
    model = op.fit(docs, labels)
    text = "é satz VILE vilest mit"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n"), (None, text), (5, "mit " * 200_000 + "vile")]
    other = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in op.scored(other, model).collect()}
    assert len(op.scored(other, model).collect()) == 7
    assert [text[s.start:s.end] for s in got[1].spans] == ["VILE vilest"] and got[1].score > 0.5 and got[None].score > 0.5
    assert got[2].score == got[3].score == got[4].score < 0.5 and got[2].spans == []
    assert [(s.start, s.end) for s in got[5].spans] == [(800_000, 800_004)]
    assert op.scored(other.limit(0), model).count() == 0


@pytest.mark.parametrize("kept", ["toxic = 1", "toxic = 0", "false"])
def test_without_both_classes(spark, kept):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int").filter(kept)
    assert {r.score for r in op.scored(docs, op.fit(docs, labels)).collect()} == {1.0 if kept == "toxic = 1" else 0.0}
