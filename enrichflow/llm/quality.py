"""Document quality by Bradley-Terry ranking.

Each document has strength ``w . x`` for features ``x`` of its text. A labelled good document is preferred over a labelled bad
one with probability ``sigmoid(w . (x_good - x_bad))``; ``w`` minimises the logistic loss of preference pairs of all labelled documents.
Scores are cut at the quantile that the share of bad documents sets, and shifted so that the cut has the score ``CUT``.

The fit, its scale and its cut use every labelled document, each with ``PAIRS`` opponents: rows are dealt by a hash of their id into
blocks of ``BLOCK``, and those of a block meet each other. A block without one of the classes meets the ``SHARED`` first rows of that class.
Newton's method takes one job over the stored features a step. Features and scores read every word of every text. Null, empty and blank texts get the score of a text without words. Without labels of both
classes all scores are the share of label 1. Repeated rows and rows without ``doc_id`` are scored alike; other columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm.learning import known_labels, newton, sigmoid
from enrichflow.llm.words import Words, mix, pieces
from enrichflow.operators.ranking import ranked
from enrichflow.sources.scratch import written

PAIRS, BLOCK, SHARED, CUT = 8, 4096, 64, 0.3
SCORED = "doc_id bigint, score double, strength double"


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _bytes(bytes(range(65, 91)))
_LOWER = _bytes(bytes(range(97, 123)))
_WIDE = np.zeros(256, bool)
_WIDE[0x80:] = True
_CLASSES = [_UPPER, _bytes(b"0123456789"), _bytes(b"#*$%&|<>"), _bytes(b"!?"), _bytes(b".,;:"), _bytes(b"@/\\=_~^+{}[]()\"'`-"),
            _bytes(b"\n"), _WIDE]
FEATURES = len(_CLASSES) + 14


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1)
    np.cumsum(values, out=out[1:])
    return out[first[1:]] - out[first[:-1]]


def text_features(words: Words) -> np.ndarray:
    """Shares and logarithms that describe each text of a piece."""
    n = words.counts
    hashes, text, first = words.hashes(), words.text_of, words.first
    size = np.maximum(np.diff(words.offsets), 1)
    many = np.maximum(n, 1)
    columns = [np.sqrt(_sums(c[words.data], words.offsets) / size) for c in _CLASSES]
    lengths = words.ends - words.starts
    mean = _sums(lengths, first) / many
    own = mix(text.astype(np.uint64) + np.uint64(1))
    _, back, times = np.unique(hashes ^ own, return_inverse=True, return_counts=True)
    grams, at = words.grams(hashes, 3)
    _, gram_back, gram_times = np.unique(grams ^ own[at], return_inverse=True, return_counts=True)
    twice = np.zeros(len(hashes))
    twice[at] = gram_times[gram_back] > 1
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) if len(hashes) else np.zeros(0)
    most = np.zeros(len(n))
    np.maximum.at(most, text, times[back])
    head, tail = words.data[words.starts], words.data[words.ends - 1]
    plain = _LOWER | _UPPER | _WIDE
    return np.column_stack(columns + [
        np.log1p(n), np.log1p(n) ** 2 / 10, (n < 10).astype(float), np.log1p(mean), np.log1p(_sums(lengths.astype(float) ** 2, first) / many),
        _sums(1 / times[back], first) / many, most / many, _sums(same, first) / many, _sums(twice, first) / many,
        _sums(lengths <= 3, first) / many, _sums(lengths > 25, first) / many, _sums(_UPPER[head], first) / many,
        _sums(~plain[tail], first) / many, _sums((lengths == 1) & ~plain[head], first) / many])


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    prior: float

    def scaled(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.spread, -8, 8)

    def strength(self, features: np.ndarray) -> np.ndarray:
        return self.scaled(features) @ self.weights


def pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss of good against bad rows, each row of the larger class with ``PAIRS`` opponents."""
    i = np.tile(np.arange(max(len(good), len(bad))), PAIRS)
    step = np.repeat(np.arange(PAIRS), max(len(good), len(bad)))
    apart = good[i % len(good)] - bad[(i * 7919 + step * 104729) % len(bad)]
    p = sigmoid(apart @ weights)
    return apart.T @ (p - 1) / PAIRS, (apart * (p * (1 - p))[:, None]).T @ apart / PAIRS


def fit_pairs(good: np.ndarray, bad: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights that make good rows stronger than bad ones."""
    return newton(lambda weights: pair_sums(good, bad, weights), good.shape[1], penalty)


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch.column(f"f{k}").to_numpy() for k in range(FEATURES)])


def labelled_features(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Stored (doc_id, features, label) of every labelled document, in the order of a hash of the id.

    Texts stay where they are: the features of all documents meet the labels. The join is the same at any size.
    """
    names = [f"f{k}" for k in range(FEATURES)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches):
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c) for c in text_features(words).T)], names=["doc_id", *names])

    described = docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, " + ", ".join(f"{n} double" for n in names))
    return written(described.join(known.hint("merge"), "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", *names))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from all labelled documents; ``labels`` has ``doc_id`` and the label, 0 or 1."""
    known, sizes = known_labels(labels, label)
    prior = sizes[1] / max(sum(sizes.values()), 1)
    none = Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, prior)
    if not all(sizes.values()):
        return none
    stored, columns = labelled_features(docs, known), [f"f{k}" for k in range(FEATURES)]
    totals = stored.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), *(F.avg(c) for c in columns),
                        *(F.stddev_pop(c) for c in columns)).first()
    bad, good = totals[:2]
    if not bad or not good:
        return none
    moments = np.array(totals[2:], float)
    model = Model(moments[:FEATURES], np.maximum(moments[FEATURES:], 1e-3), np.zeros(FEATURES), 0.0, prior)
    shared = [model.scaled(_matrix(stored.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(SHARED).toArrow()))
              for c in (0, 1)]

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, FEATURES + 1))
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x, target = model.scaled(_matrix(part)), part.column("label").to_numpy()
                    classes = [x[target == c] if (target == c).any() else shared[c] for c in (0, 1)]
                    gradient, hessian = pair_sums(classes[1], classes[0], weights)
                    total += np.column_stack((gradient, hessian))
            yield pa.record_batch({"at": pa.array(np.arange(total.size), pa.int32()), "value": pa.array(total.ravel())})

        parts = stored.select("label", *columns).mapInArrow(rows, "at int, value double")
        added = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")
        total = added["value"].to_numpy().reshape(FEATURES, FEATURES + 1)
        return total[:, 0], total[:, 1:]

    model.weights = newton(sums, FEATURES)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"strength": pa.array(model.strength(_matrix(batch)))})

    order = ranked(stored.select(columns).mapInArrow(strengths, "strength double"), [F.col("strength")])
    model.cut = order.filter(F.col("rank").between(bad - 1, bad)).agg(F.avg("strength")).first()[0]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (at least ``CUT`` from the cut upwards) and ``strength``."""
    flat, shift = not model.weights.any(), np.log(CUT / (1 - CUT))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches):
            strength = model.strength(text_features(words))
            score = np.full(part.num_rows, model.prior) if flat else sigmoid(strength - model.cut + shift)
            yield pa.record_batch([part.column("doc_id"), pa.array(score), pa.array(strength)], names=["doc_id", "score", "strength"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCORED)
