"""Ranking fit and held-out accuracy."""
import numpy as np
import pytest

from enrichflow.llm import quality as op
from enrichflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.1"


def test_pairs_rank_good_over_bad():
    draw = np.random.default_rng(1)
    good, bad = draw.normal([1, 0, 0], 1, (80, 3)), draw.normal([-1, 0, 0], 1, (50, 3))
    weights = op.fit_pairs(good, bad)
    assert weights[0] > 3 * abs(weights[1:]).max()


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_quality"].run(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    train = [(i, "Words in a calm sentence." if i % 2 else "BUY!! BUY!! BUY!! ###") for i in range(40)]
    docs = spark.createDataFrame(train, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, "z") for i, _ in train] + [(None, 1, "z"), (3, None, "z")], "doc_id bigint, quality int, text string")
    model = op.fit(docs, labels)
    rows = [(1, "Words in a calm sentence."), (1, "Words in a calm sentence."), (2, None), (3, ""), (4, " \n"), (None, "BUY!! BUY!!"), (5, "a " * 300_000)]
    other = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, score double")
    got = op.scored(other, model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and score[1] >= 0.3 > score[None] and score[2] == score[3] == score[4] and all(0 <= r.score <= 1 for r in got)
    assert op.scored(other.limit(0), model).count() == 0


@pytest.mark.parametrize("kept", ["quality = 1", "quality = 0", "false"])
def test_without_both_classes(spark, kept):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").filter(kept)
    assert {r.score for r in op.scored(docs, op.fit(docs, labels)).collect()} == {1.0 if kept == "quality = 1" else 0.0}


def test_every_labelled_document_counts(spark, monkeypatch):
    """Scale, pairs and cut come from all 6,000 labelled rows; blocks of one class meet rows of the other."""
    monkeypatch.setattr(op, "BLOCK", 2)
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(if(id % 3 = 0, 'BUY!! ### ', 'calm words here '), 1 + int(id % 40)) || id AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 <> 0) AS quality")
    stored = op.labelled_features(docs, op.known_labels(labels, "quality")[0])
    model = op.fit(docs, labels)
    assert stored.count() == 6000
    assert np.allclose(model.centre, np.array(stored.groupBy().avg(*(f"f{k}" for k in range(op.FEATURES))).first()))
    got = op.scored(docs, model).collect()
    below = sum(r.score < op.CUT for r in got)
    assert below == 2000 and all((r.score >= op.CUT) == (r.doc_id % 3 != 0) for r in got)
