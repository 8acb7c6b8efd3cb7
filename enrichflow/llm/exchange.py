"""Find hashes that several documents share, with about five bytes of shuffle per hash.

A task hands over (hash, document) entries in loads of a few million. Inside a load equal hashes are settled at once and one
entry per hash is sent on, so a hash that a third of all documents hold costs one entry per load. Entries travel in
packed rows to the bucket of their hash; the number of buckets grows with the input, so a bucket stays at a few million
entries and the shortened keys stay selective. What is found goes back, packed again, to the bucket of its document.

Two rules exist. ``shared`` finds the hashes that two or more documents have and errs on the side of reporting one too many
(a key has 31 bits within its bucket). ``later`` compares whole 64-bit hashes and reports a document's hash if a
smaller document id has it too.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm.words import release

SENT = "bucket int, settled boolean, docs binary, counts binary, keys binary"
FOUND = "doc_id bigint, keys binary"
LOAD = 600_000
BUCKET_WORDS = 1_000_000
_CUT = np.uint64(33)
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()),
                          ("keys", pa.binary())])


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets for the n-grams of these texts; a word is taken as six bytes."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(4, -(-int(size) // (6 * BUCKET_WORDS)))


def tags(hashes: np.ndarray) -> np.ndarray:
    """What ``shared`` reports of a hash: its upper 31 bits. They only have to tell the hashes of one document apart."""
    return (hashes >> _CUT).astype(np.uint32)


def _width(rule: str) -> int:
    return 8 if rule == "later" else 4


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _home(docs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers what was found for a document."""
    return (docs.astype(np.uint64) % np.uint64(buckets)).astype(np.int32)


def _packed(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, width: int, settled: bool) -> Iterator[dict]:
    order = np.lexsort((docs, bucket))
    bucket, docs, keys = bucket[order], docs[order], keys[order]
    cuts = np.append(_runs(bucket), len(bucket))
    for begin, end in zip(cuts[:-1], cuts[1:]):
        own = docs[begin:end]
        at = _runs(own)
        raw = np.ascontiguousarray(keys[begin:end].view(np.uint8).reshape(-1, 8)[:, :width])
        yield {"bucket": int(bucket[begin]), "settled": settled, "docs": own[at].tobytes(),
               "counts": np.diff(np.append(at, len(own))).astype(np.uint32).tobytes(), "keys": raw.tobytes()}


def _load(hashes: np.ndarray, docs: np.ndarray, flags: np.ndarray, buckets: int, rule: str) -> Iterator[dict]:
    order = np.argsort(hashes, kind="stable")
    hashes, docs, flags = hashes[order], docs[order], flags[order]
    at = _runs(hashes)
    sizes = np.diff(np.append(at, len(hashes)))
    least, most = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
    flag, group = np.logical_or.reduceat(flags, at), hashes[at]
    bucket = (group % np.uint64(buckets)).astype(np.int32)
    if rule == "later":
        known = docs > np.repeat(least, sizes)
        keys = group
    else:
        known = np.repeat(least != most, sizes)
        keys = (group >> _CUT << np.uint64(1)) | (flag if rule == "shared" else least != most).astype(np.uint64)
    if known.any():
        told = hashes[known] if rule == "later" else hashes[known] >> _CUT
        yield from _packed(_home(docs[known], buckets), docs[known], told, _width(rule), True)
    yield from _packed(bucket, least, keys, _width(rule), False)


def send(entries: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, rule: str) -> Iterator[pa.RecordBatch]:
    """Packed rows for (hashes, document ids, flags); rule ``shared``, ``counted`` or ``later``."""
    held, size = [], 0

    def out():
        parts = [np.concatenate(x) for x in zip(*held)]
        rows, weight = [], 0
        held.clear()
        for row in _load(*parts, buckets, rule) if len(parts[0]) else ():
            rows.append(row)
            weight += len(row["keys"])
            if weight > 1 << 22 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT_SCHEMA)
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SENT_SCHEMA)
        del parts
        release()

    for entry in entries:
        held.append(entry)
        size += len(entry[0])
        if size >= LOAD:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _open(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    docs, keys = [], []
    for ids, counts, raw in zip(table["docs"], table["counts"], table["keys"]):
        docs.append(np.repeat(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint32)))
        wide = np.zeros((len(docs[-1]), 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, width)
        keys.append(wide.view(np.uint64).ravel())
    return (np.concatenate(docs), np.concatenate(keys)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _met(docs: np.ndarray, keys: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    docs, keys = docs[order], keys[order]
    plain = keys if rule == "later" else keys >> np.uint64(1)
    at = _runs(plain)
    sizes = np.diff(np.append(at, len(plain)))
    if rule == "later":
        hit = docs > np.repeat(np.minimum.reduceat(docs, at), sizes)
        return docs[hit], keys[hit]
    flags = (keys & np.uint64(1)).astype(bool)
    several = sizes > 1
    if rule == "shared":
        hit = np.repeat(several & np.logical_or.reduceat(flags, at), sizes)
    else:
        hit = np.repeat(several, sizes) & ~flags
    return docs[hit], plain[hit]


def meet(sent: DataFrame, rule: str, buckets: int) -> DataFrame:
    """(doc_id, keys): all hashes of a document that met the rule, one row per document.

    ``keys`` packs whole 64-bit hashes for ``later`` and 32-bit ``tags`` otherwise.
    """
    width = _width(rule)

    def bucket(table):
        settled = table["settled"].to_numpy(zero_copy_only=False).astype(bool)
        docs, keys = _open(table.filter(pa.array(~settled)), width)
        rows = []
        if len(docs):
            docs, keys = _met(docs, keys, rule)
            rows = list(_packed(_home(docs, buckets), docs, keys, width, True))
        del docs, keys
        release()
        return pa.concat_tables([table.filter(pa.array(settled)).cast(_SENT_SCHEMA), pa.Table.from_pylist(rows, _SENT_SCHEMA)])

    def documents(table):
        docs, keys = _open(table, width)
        order = np.argsort(docs, kind="stable")
        docs, keys = docs[order], keys[order].astype(f"<u{width}")
        at = _runs(docs)
        ends = np.append(at[1:], len(docs))
        return pa.table({"doc_id": docs[at], "keys": [keys[a:b].tobytes() for a, b in zip(at, ends)]},
                        schema=pa.schema([("doc_id", pa.int64()), ("keys", pa.binary())]))

    return sent.groupBy("bucket").applyInArrow(bucket, SENT).groupBy("bucket").applyInArrow(documents, FOUND)
