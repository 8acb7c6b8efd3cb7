"""Toxic spans and document scores from a linear-chain conditional random field.

States are clean (0) and toxic (1). A token's evidence is a sum of hashed features: the lower-cased word without outer
punctuation, its first 4, 5 and 6 bytes and its last 3. Only documents are labelled, so training tokens take their labels from
them: a token is toxic if its document is and one of its word or prefix features is found clearly more often in windows of
toxic documents than in those of clean ones. Forward-backward marginals give the toxic spans and, calibrated on the labelled
sample, the score.

The fit uses at most ``PER_CLASS`` documents of each class and ``WINDOWS`` windows of ``LENGTH`` words of each, in hash order;
scoring reads every word of every text. Long texts are cut into blocks whose products of 2x2 messages are exact, so nothing
is lost between blocks. Null, empty and blank texts get the score of a text without evidence. Without labels of both classes
all scores are the share of label 1. Repeated rows and rows without ``doc_id`` are scored alike; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm.learning import logistic, sampled_labels, sigmoid
from enrichflow.llm.words import Words, mix, pieces

PER_CLASS, WINDOWS, LENGTH = 1000, 6, 128
DIMENSIONS, TEMPLATES, BLOCK = 1 << 18, 5, 64
SCORED = "doc_id bigint, score double, n_toxic double, spans array<struct<start: bigint, end: bigint>>"
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[[*range(48, 58), *range(97, 123)]] = True


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray  # log potentials of clean-to-toxic, toxic-to-clean, toxic-to-toxic
    document: np.ndarray  # calibration
    prior: float


def token_features(words: Words) -> np.ndarray:
    """Feature numbers of each word, one row per word. The words must be lower-cased."""
    letter = _LETTER[words.data]
    place = np.arange(len(letter))
    after = np.minimum.accumulate(np.where(letter, place, len(letter))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, place, -1))
    starts = np.minimum(after[words.starts], words.ends - 1)
    ends = np.maximum(before[words.ends - 1] + 1, starts)
    out = np.empty((len(starts), TEMPLATES), np.int32)
    cuts = [(starts, ends)] + [(starts, np.minimum(ends, starts + k)) for k in (4, 5, 6)] + [(np.maximum(starts, ends - 3), ends)]
    for k, (a, b) in enumerate(cuts):
        out[:, k] = mix(words.ranges(a, b) + np.uint64(k)) & np.uint64(DIMENSIONS - 1)
    return out


def _ratios(moves: np.ndarray, r: np.ndarray) -> np.ndarray:
    a01, a10, a11 = np.exp(moves)
    return (a01 + a11 * r) / (1 + a10 * r)


def _back(moves: np.ndarray, x: np.ndarray) -> np.ndarray:
    a01, a10, a11 = np.exp(moves)
    return (a10 + a11 * x) / (1 + a01 * x)


def _inside(evidence: np.ndarray, valid: np.ndarray, moves: np.ndarray, r: np.ndarray, b: np.ndarray):
    """Forward and backward ratios of toxic to clean for columns of tokens that start from ``r`` and end before ``b``."""
    steps = len(evidence)
    forward, backward = np.empty((steps + 1, len(r))), np.empty((steps, len(r)))
    forward[0] = r
    for t in range(steps):
        forward[t + 1] = np.where(valid[t], evidence[t] * _ratios(moves, forward[t]), forward[t])
    for t in range(steps - 1, -1, -1):
        backward[t] = b
        b = np.where(valid[t], _back(moves, evidence[t] * b), b)
    return forward, backward


def _product(evidence: np.ndarray, valid: np.ndarray, moves: np.ndarray):
    """Product of the message matrices of each column."""
    a01, a10, a11 = np.exp(moves)
    p00, p01, p10, p11 = (np.full(evidence.shape[1], v) for v in (1.0, 0.0, 0.0, 1.0))
    for e, on in zip(evidence, valid):
        new = (p00 + p01 * a10, (p00 * a01 + p01 * a11) * e, p10 + p11 * a10, (p10 * a01 + p11 * a11) * e)
        p00, p01, p10, p11 = (np.where(on, n, p) for n, p in zip(new, (p00, p01, p10, p11)))
        scale = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
        p00, p01, p10, p11 = p00 / scale, p01 / scale, p10 / scale, p11 / scale
    return p00, p01, p10, p11


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of toxic for each token of texts that start at ``first``; every text starts from clean."""
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    start = np.append(0, np.cumsum(blocks))
    text = np.repeat(np.arange(len(counts)), counts)
    own = np.arange(len(scores)) - first[text]
    column, row = start[text] + own // BLOCK, own % BLOCK
    evidence, valid = np.ones((BLOCK, start[-1])), np.zeros((BLOCK, start[-1]), bool)
    evidence[row, column] = np.exp(np.clip(scores, -30, 30))
    valid[row, column] = True
    r, b = np.zeros(start[-1]), np.ones(start[-1])
    several = np.flatnonzero(blocks > 1)
    if len(several):
        product = np.array(_product(evidence, valid, moves))
        several = several[np.argsort(-blocks[several], kind="stable")]
        most = blocks[several]
        for k in range(1, int(most[0])):
            at = start[several[:np.searchsorted(-most, -k, "left")]] + k
            p00, p01, p10, p11 = product[:, at - 1]
            r[at] = (p01 + r[at - 1] * p11) / (p00 + r[at - 1] * p10)
        for k in range(1, int(most[0])):
            mine = several[:np.searchsorted(-most, -k, "left")]
            at = start[mine] + blocks[mine] - 1 - k
            p00, p01, p10, p11 = product[:, at + 1]
            b[at] = (p10 + p11 * b[at + 1]) / (p00 + p01 * b[at + 1])
    forward, backward = _inside(evidence, valid, moves, r, b)
    odds = forward[1:] * backward
    return (odds / (1 + odds))[row, column]


def fit_chain(features: np.ndarray, target: np.ndarray, valid: np.ndarray, steps: int = 60, rate: float = 0.3,
              penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and moves by gradient steps (Adam) on the log-likelihood of columns of labelled tokens.

    ``features`` has feature numbers by token, column and template; the first weight past them is the constant.
    """
    used = np.flatnonzero(np.bincount(features.ravel(), minlength=DIMENSIONS))
    size = len(used)
    place = np.zeros(DIMENSIONS, np.int32)
    place[used] = np.arange(size)
    codes = place[features]
    theta = np.zeros(size + 4)
    theta[size:] = (-4.0, -2.0, -1.0, 1.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    before = np.vstack((np.zeros_like(target[:1]), target[:-1]))
    seen = [(valid & (before == i) & (target == j)).sum() for i, j in ((0, 1), (1, 0), (1, 1))]
    total = valid.sum()
    flat = codes.reshape(-1)
    for step in range(1, steps + 1):
        moves = theta[size + 1:]
        evidence = np.exp(np.clip(theta[codes].sum(-1) + theta[size], -30, 30))
        forward, backward = _inside(evidence, valid, moves, np.zeros(evidence.shape[1]), np.ones(evidence.shape[1]))
        odds = forward[1:] * backward
        error = np.where(valid, odds / (1 + odds) - target, 0)
        gradient = np.empty_like(theta)
        gradient[:size] = np.bincount(flat, np.repeat(error.ravel(), features.shape[-1]), size)
        gradient[size] = error.sum()
        a01, a10, a11 = np.exp(moves)
        x, y = forward[:-1], evidence * backward
        parts = (a01 * y, a10 * x, a11 * x * y)
        whole = 1 + sum(parts)
        gradient[size + 1:] = [np.where(valid, p / whole, 0).sum() - s for p, s in zip(parts, seen)]
        gradient = gradient / max(total, 1) + penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS + 1)
    weights[used] = theta[:size]
    weights[DIMENSIONS] = theta[size]
    return weights, theta[size + 1:]


def toxic_features(features: np.ndarray, valid: np.ndarray, toxic: np.ndarray, support: int = 5, odds: float = 20.0) -> np.ndarray:
    """Word and prefix features whose share of toxic windows is ``odds`` times that of clean ones, in ``support`` of them."""
    ill, well = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    window = np.broadcast_to(np.arange(len(toxic)), valid.shape)[valid]
    for template in range(4):  # features of different templates differ
        pairs = np.unique(features[:, :, template][valid].astype(np.int64) * len(toxic) + window)
        feature, bad = pairs // len(toxic), toxic[pairs % len(toxic)]
        ill += np.bincount(feature[bad], minlength=DIMENSIONS)
        well += np.bincount(feature[~bad], minlength=DIMENSIONS)
    rate = (ill / max(toxic.sum(), 1)) / ((well + 0.5) / max((~toxic).sum(), 1))
    return (ill >= support) & (rate >= odds)


def _windows(docs: DataFrame, sample: DataFrame) -> pa.Table:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches, lower=True):
            features, out = token_features(words), []
            for i, (doc, label) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist())):
                begins = np.arange(words.first[i], words.first[i + 1], LENGTH)
                order = np.argsort(mix(begins.astype(np.uint64) - np.uint64(words.first[i]) + np.uint64(doc & 0xFFFFFFFF)))
                for begin in begins[order[:WINDOWS]]:
                    out.append((label, features[begin:min(begin + LENGTH, words.first[i + 1])].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], schema=pa.schema([("label", pa.int32()), ("ids", pa.binary())]))

    mine = docs.join(F.broadcast(sample), "doc_id")
    return mine.select("doc_id", "label", "text").mapInArrow(rows, "label int, ids binary").toArrow()


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: log of the expected number of toxic tokens, log odds of having any, largest marginal, log rate."""
    text, texts = np.repeat(np.arange(len(first) - 1), np.diff(first)), len(first) - 1
    expected, none = np.bincount(text, p, texts), np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-9)), texts)
    most = np.zeros(texts)
    np.maximum.at(most, text, p)
    any_ = np.clip(-np.expm1(none), 1e-6, 1 - 1e-9)
    return np.column_stack((np.log1p(expected), np.log(any_ / (1 - any_)) / 10, most,
                            np.log1p(1000 * expected / np.maximum(np.diff(first), 1))))


def _token_marginals(words: Words, model: Model) -> np.ndarray:
    scores = model.weights[token_features(words)].sum(1) + model.weights[DIMENSIONS]
    return marginals(scores, words.first, model.moves)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents; ``labels`` has ``doc_id`` and the label, 0 or 1."""
    docs = docs.select("doc_id", "text")
    sample, sizes = sampled_labels(labels, label, per_class)
    prior = sizes[1] / max(sum(sizes.values()), 1)
    empty = Model(np.zeros(DIMENSIONS + 1), np.zeros(3), np.zeros(5), prior)
    if not all(sizes.values()):
        return empty
    table = _windows(docs, sample)
    cells = [np.frombuffer(b.as_buffer(), np.int32).reshape(-1, TEMPLATES) for b in table["ids"]]
    toxic = table["label"].to_numpy() == 1
    if not cells or toxic.all() or not toxic.any():
        return empty
    features, valid = np.zeros((LENGTH, len(cells), TEMPLATES), np.int32), np.zeros((LENGTH, len(cells)), bool)
    for i, cell in enumerate(cells):
        features[:len(cell), i], valid[:len(cell), i] = cell, True
    marked = toxic_features(features, valid, toxic)
    target = (marked[features[:, :, :4]].any(-1) & valid & toxic).astype(np.float64)
    weights, moves = fit_chain(features, target, valid)
    model = Model(weights, moves, np.zeros(5), prior)

    def rows(batches):
        for part, words in pieces(batches, lower=True):
            found = _summary(_token_marginals(words, model), words.first)
            yield pa.record_batch([part.column("label"), *(pa.array(c) for c in found.T)], names=["label", "a", "b", "c", "d"])

    seen = docs.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(
        rows, "label int, a double, b double, c double, d double").toArrow()
    target = seen["label"].to_numpy().astype(float)
    x = np.column_stack([seen[c].to_numpy() for c in "abcd"])
    many = {c: max((target == c).sum(), 1) for c in (0, 1)}
    weight = np.where(target == 1, sizes[1] / many[1], sizes[0] / many[0])
    model.document = logistic(x, target, weight * len(weight) / weight.sum())
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, ``score``, the expected number of toxic words and the toxic spans as code point offsets.

    A span joins neighbouring words whose marginal is at least ``threshold``.
    """
    flat = not model.document.any()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches, lower=True):
            p = _token_marginals(words, model) if not flat else np.zeros(len(words.starts))
            summary = np.column_stack((_summary(p, words.first), np.ones(part.num_rows)))
            score = sigmoid(summary @ model.document) if not flat else np.full(part.num_rows, model.prior)
            spans: list[list] = [[] for _ in range(part.num_rows)]
            bad = np.flatnonzero(p >= threshold)
            if len(bad):
                points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
                text = words.text_of[bad]
                joined = np.append(False, (bad[1:] == bad[:-1] + 1) & (text[1:] == text[:-1]))
                begins = np.flatnonzero(~joined)
                for a, b in zip(begins, np.append(begins[1:], len(bad))):
                    base = points[words.offsets[text[a]]]
                    spans[text[a]].append({"start": int(points[words.starts[bad[a]]] - base),
                                           "end": int(points[words.ends[bad[b - 1]]] - base)})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([part.column("doc_id"), pa.array(score), pa.array(np.expm1(summary[:, 0])), pa.array(spans, kind)],
                                  names=["doc_id", "score", "n_toxic", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCORED)


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with all their columns and without a shuffle."""
    flat = not model.document.any()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches, lower=True):
            if flat:
                score = np.full(part.num_rows, model.prior)
            else:
                summary = np.column_stack((_summary(_token_marginals(words, model), words.first), np.ones(part.num_rows)))
                score = sigmoid(summary @ model.document)
            yield part.filter(pa.array(score < limit))

    return docs.mapInArrow(rows, docs.schema)
