"""Remove passages that an earlier document has, found through fixed-block anchors.

Each document is an ordered list of words. Its reference blocks are the runs of ``BLOCK`` words that start at multiples of
``BLOCK``; any window of ``WINDOW`` (at least ``2 * BLOCK - 1``) words holds a whole one. Every rolling window of ``BLOCK`` words
probes them. A block met by another document is a hit, and around hits in both documents the repeat is extended: all windows
of ``WINDOW`` words that hold the hit are compared by a 64-bit hash of their word hashes, and those that a smaller ``doc_id``
has too are covered. Overlapping covered windows are one maximal exact repeat.

Null or empty texts and texts shorter than a window have nothing removed. Rows without ``doc_id`` are neither reference nor
changed. Rows with the same ``doc_id`` are one document for the comparison, and each is cut. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from enrichflow.llm import exchange
from enrichflow.llm.words import Words, pieces
from enrichflow.sources.scratch import written

WINDOW, BLOCK = 50, 25
WORDS = "doc_id bigint, n_words bigint, words_sha256 string"
CHANGED = WORDS + ", n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_text string"


def digests(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, number of words and the SHA-256 of the words joined by one space."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches):
            texts = [words.text(i).split() for i in range(part.num_rows)]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_words": pa.array([len(t) for t in texts], pa.int64()),
                "words_sha256": [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]})

    return docs.select("doc_id", "text").mapInArrow(rows, WORDS)


def _held(keys: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every packed number of a binary column."""
    rows, values = [], []
    for i, cell in enumerate(keys):
        own = np.frombuffer(cell.as_buffer(), kind)
        rows.append(np.full(len(own), i))
        values.append(own)
    return (np.concatenate(rows), np.concatenate(values)) if rows else (np.zeros(0, np.int64), np.zeros(0, kind))


def _member(rows: np.ndarray, values: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether (row, value) is in ``of``; both parts must be equal, so equal values are compared by their rows."""
    known, codes = np.unique(of[1], return_inverse=True)
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    own = rows.astype(np.int64) * len(known) + at
    return (known[at] == values) & np.isin(own, of[0].astype(np.int64) * len(known) + codes)


def _covered(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in the runs of ``length`` words at ``starts``."""
    step = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def changed_texts(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows that lose words: ``doc_id``, words and their digest before, words removed, spans removed and text kept.

    A span is a half-open range of word numbers; the kept text has one space between words.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block")
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    buckets = exchange.bucket_count(docs)

    def probes(batches):
        for part, words in pieces(batches):
            ids = part.column("doc_id").to_numpy()
            grams, at = words.grams(words.hashes(), block)
            text = words.text_of[at]
            yield grams, ids[text], (at - words.first[text]) % block == 0

    def windows(batches):
        for part, words in pieces(batches):
            ids, hashes = part.column("doc_id").to_numpy(), words.hashes()
            grams, at = words.grams(hashes, block)
            hit = _member(words.text_of[at], exchange.tags(grams), _held(part.column("keys"), np.uint32))
            seen = np.zeros(len(hashes) + 1, np.int64)
            seen[at[hit] + 1] = 1
            seen = np.cumsum(seen)
            grams, at = words.grams(hashes, window)
            near = seen[at + window - block + 1] > seen[at]
            yield grams[near], ids[words.text_of[at[near]]], np.zeros(int(near.sum()), bool)

    def cut(batches):
        for part, words in pieces(batches):
            grams, at = words.grams(words.hashes(), window)
            gone = _covered(words, at[_member(words.text_of[at], grams, _held(part.column("keys"), np.uint64))], window)
            out = []
            for i in range(part.num_rows):
                first, own = words.first[i], gone[words.first[i]:words.first[i + 1]]
                if own.any():
                    texts = words.text(i).split()
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    kept = b" ".join(t for t, drop in zip(texts, own) if not drop)
                    out.append((part.column("doc_id")[i].as_py(), len(texts), hashlib.sha256(b" ".join(texts)).hexdigest(),
                                int(own.sum()), [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)], kept))
            names = [f.split()[0] for f in CHANGED.split(", ")[:4]] + ["spans", "kept_text"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 6
            if out:
                columns[5] = [t.decode() for t in columns[5]]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def send(make, rule):
        return lambda batches: exchange.send(make(batches), buckets, rule)

    hits = exchange.meet(docs.mapInArrow(send(probes, "shared"), exchange.SENT), "shared", buckets)
    near = written(docs.join(hits, "doc_id"))
    repeats = exchange.meet(near.mapInArrow(send(windows, "later"), exchange.SENT), "later", buckets)
    return near.drop("keys").join(repeats, "doc_id").mapInArrow(cut, CHANGED)
