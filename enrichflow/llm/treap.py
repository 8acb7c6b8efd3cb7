"""Ranked lexical search on K2-treaps over the term-document grid.

Documents are indexed in ranges of neighbouring rows, one treap a range. Its grid has a row for each term and a column for each
document, in order of ``doc_id``; a cell holds the term's impact on the document, ``1000000000 * tf div (1000 * tf + 8 * m)``, where ``m`` grows
with the document's length. A quadtree over the grid keeps only quadrants that hold something: a node is four bits for its
quadrants, and the largest impact below it, stored as what it lacks to its parent's.

A search follows one path of the tree per term of an item (the term's row), all paths together, over ever smaller ranges of
documents. The sum of weighted maxima bounds every score in a document range, so ranges are opened best first,
``WIDTH`` at a time, and dropped once they cannot beat the last of the best ``k``, carried from range to range in a task. Equal
scores go to the smaller ``doc_id``. Scores are 64-bit integers and exact.

Term weights come from document counts that are read off the stored index (bits of a row), so the index holds nothing that a
new query set changes. Terms are compared by 64-bit hashes. Items are sent to the tasks ``ITEMS`` at a time, in as many passes over the
index as that takes. Texts are read whole; null and empty ones have no terms. Rows without ``doc_id`` or ``item_id`` are left out; rows that
repeat a ``doc_id`` are documents of their own and may each be ranked; rows that repeat an ``item_id`` are one item with all their terms. An item without known terms
has no rows. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from enrichflow.llm.words import Words, slices
from enrichflow.sources.scratch import batches, written

RANGE_BYTES, WIDTH, ITEMS, SLICES = 3 << 20, 128, 10_000, 256
BATCH_BYTES = 4 << 20  # a range's row, or this much, is read and goes to a Python worker at a time
INDEX = "docs binary, terms binary, df binary, height int, bits binary, nodes binary, lacks binary, top bigint"
FOUND = "item_id bigint, doc_id bigint, score bigint"
APART = np.zeros(256, bool)
APART[:128] = True
APART[np.r_[48:58, 65:91, 97:123]] = False
_COUNT = np.array([bin(i).count("1") for i in range(16)], np.uint8)
_BEFORE = np.array([[bin(i & ((1 << c) - 1)).count("1") for c in range(4)] for i in range(16)], np.uint8)


def terms(column: pa.Array | pa.ChunkedArray) -> Words:
    """Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return Words(column, lower=True, apart=APART)


def _spread(values: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at even places of 64-bit ones."""
    x = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """Levels from the root down. ``bits[l]`` are the quadrants of the nodes of level ``l``; ``largest[l]`` their largest impacts.

    The quadrants of a level, in order, are the nodes of the next; the last level's nodes are cells.
    """

    height: int
    bits: list[np.ndarray]
    largest: list[np.ndarray]

    def __post_init__(self):
        self.child = [np.cumsum(_COUNT[b], dtype=np.int64) - _COUNT[b] for b in self.bits]


def build(row: np.ndarray, column: np.ndarray, impact: np.ndarray, size: int) -> Treap:
    """A treap of distinct cells in a grid of ``size`` rows and columns."""
    height = max(1, int(size - 1).bit_length())
    code = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(code)
    code, largest = code[order], [impact[order]]
    bits = []
    for _ in range(height):
        parent = code >> np.uint64(2)
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        quadrant = (1 << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        bits.append(np.bitwise_or.reduceat(quadrant, starts) if len(starts) else np.zeros(0, np.uint8))
        largest.append(np.maximum.reduceat(largest[-1], starts) if len(starts) else largest[-1][:0])
        code = parent[starts]
    return Treap(height, bits[::-1], largest[::-1])


def packed(tree: Treap) -> dict:
    """Columns of a stored treap."""
    lacks = [np.repeat(up, _COUNT[b]) - down for up, b, down in zip(tree.largest[:-1], tree.bits, tree.largest[1:])]
    return {"height": tree.height, "bits": np.concatenate(tree.bits).tobytes(), "nodes": np.array([len(b) for b in tree.bits], np.int64).tobytes(),
            "lacks": np.concatenate(lacks).astype(np.int32).tobytes(), "top": int(tree.largest[0][0])}


def opened(row: dict) -> Treap:
    """The treap of a stored row."""
    sizes = np.frombuffer(row["nodes"], np.int64)
    bits = np.split(np.frombuffer(row["bits"], np.uint8), np.cumsum(sizes)[:-1])
    lacks = np.frombuffer(row["lacks"], np.int32)
    largest, at = [np.array([row["top"]], np.int64)], 0
    for b in bits:
        many = int(_COUNT[b].sum())
        largest.append(np.repeat(largest[-1], _COUNT[b]) - lacks[at:at + many])
        at += many
    return Treap(row["height"], bits, largest)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N and L: the documents that have a term, and all their terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for part in slices(batches):
            counts = terms(part.column("text")).counts
            n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.record_batch({"n": [n], "total": [total]})

    sums = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(rows, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return sums[0] or 0, sums[1] or 0


def _range_row(ids: np.ndarray, column: pa.Array, n: int, total: int) -> dict | None:
    order = np.argsort(ids, kind="stable")
    words = terms(column.take(pa.array(order)))
    if not len(words.starts):
        return None
    used = np.flatnonzero(words.counts)
    hashes, inverse = np.unique(words.hashes(), return_inverse=True)
    place = np.repeat(np.arange(len(used)), words.counts[used])
    cell, tf = np.unique(inverse.astype(np.int64) * len(used) + place, return_counts=True)
    term, doc = cell // len(used), cell % len(used)
    df = np.bincount(term, minlength=len(hashes))
    rank = np.argsort(-df, kind="stable")  # frequent terms lie together
    row_of = np.empty(len(rank), np.int64)
    row_of[rank] = np.arange(len(rank))
    length = np.array([100 - 90 + (90 * int(c) * n) // total for c in words.counts[used]], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * length[doc])
    tree = build(row_of[term], doc, impact, max(len(hashes), len(used), 2))
    return {"docs": ids[order][used].tobytes(), "terms": hashes[rank].tobytes(), "df": df[rank].astype(np.int32).tobytes(), **packed(tree)}


_INDEX_SCHEMA = pa.schema([("docs", pa.binary()), ("terms", pa.binary()), ("df", pa.binary()), ("height", pa.int32()), ("bits", pa.binary()),
                           ("nodes", pa.binary()), ("lacks", pa.binary()), ("top", pa.int64())])


def index(docs: DataFrame, n: int, total: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per range of documents: its treap, document ids, term hashes and document counts. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            ids = np.concatenate([p.column("doc_id").to_numpy() for p in held])
            texts = pa.concat_arrays([p.column("text").cast(pa.large_string()) for p in held])
            row = _range_row(ids, texts, n, total)
            if row:
                yield pa.RecordBatch.from_pylist([row], schema=_INDEX_SCHEMA)

        for part in slices(batches):
            held.append(part)
            size += part.nbytes
            if size >= range_bytes:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(rows, INDEX)


class Best:
    """The best ``k`` (score, document) pairs so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        keep = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[keep], doc[keep]

    def may_enter(self, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether documents from ``first`` on, with scores up to ``bound``, can still be among the best."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first < self.doc[-1]))


def descend(tree: Treap, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, best: Best, width: int = WIDTH) -> int:
    """Rank the documents of one range for the terms in ``rows``; returns how many document ranges were opened."""
    waiting: list[list[tuple]] = [[] for _ in range(tree.height + 1)]
    waiting[0].append((np.array([int((weights * tree.largest[0][0]).sum())]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)))
    count = 0
    while True:
        tops = [max((int(part[0].max()) for part in level if len(part[0])), default=0) for level in waiting]
        top = max(tops)
        if top <= 0:
            return count
        level = max(i for i, x in enumerate(tops) if x == top)
        bound, start, nodes = (np.concatenate(x) for x in zip(*waiting[level]))
        keep = best.may_enter(bound, docs[start])
        bound, start, nodes = bound[keep], start[keep], nodes[keep]
        if len(bound) > width:
            order = np.argsort(-bound, kind="stable")
            now, later = order[:width], order[width:]
            waiting[level] = [(bound[later], start[later], nodes[later])]
            start, nodes = start[now], nodes[now]
        else:
            waiting[level] = []
        if not len(start):
            continue
        count += len(start)
        shift = tree.height - 1 - level
        half = ((rows >> shift) & 1) * 2
        here, largest = np.maximum(nodes, 0), tree.largest[level + 1]
        quadrants, child = np.where(nodes < 0, 0, tree.bits[level][here]).astype(np.uint8), tree.child[level][here]
        for side in (0, 1):
            has = (quadrants >> (half + side)) & 1 > 0
            below = np.where(has, child + _BEFORE[quadrants, half + side], -1)
            value = (np.where(has, largest[below], 0) * weights).sum(axis=1)
            first = start + (side << shift)
            some = np.flatnonzero(value > 0)
            some = some[best.may_enter(value[some], docs[first[some]])]
            if not len(some):
                continue
            if level + 1 == tree.height:
                best.add(value[some], docs[first[some]])
            else:
                waiting[level + 1].append((value[some], first[some], below[some]))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct hashed terms of each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = terms(part.column("text"))
            yield pa.record_batch({"item_id": part.column("item_id").take(pa.array(words.text_of)), "term": words.hashes().view(np.int64)})

    return items.filter("item_id IS NOT NULL").select("item_id", "text").mapInArrow(rows, "item_id bigint, term bigint").distinct()


def document_counts(index_rows: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each wanted term is; one small row per term and task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for own, df in zip(batch.column("terms"), batch.column("df")):
                own, df = np.frombuffer(own.as_buffer(), np.int64), np.frombuffer(df.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                met = wanted[at] == own
                np.add.at(sums, at[met], df[met])
        some = np.flatnonzero(sums)
        yield pa.record_batch({"term": wanted[some], "df": sums[some]})

    if not len(wanted):
        return {}
    counted = index_rows.select("terms", "df").mapInArrow(rows, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # at most one row per term of ITEMS items


def _search(index_rows: DataFrame, queries: list[tuple[int, np.ndarray]], n: int, k: int) -> DataFrame:
    """The best ``k`` of each task for queries given as (item_id, sorted term hashes)."""
    wanted = np.unique(np.concatenate([q[1] for q in queries])) if queries else np.zeros(0, np.int64)
    counts = document_counts(index_rows, wanted)
    df = np.array([counts.get(int(t), 0) for t in wanted], np.int64)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    asked = [(item, np.searchsorted(wanted, own)) for item, own in queries]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in asked}
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tree, docs, own = opened(row), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["terms"], np.int64)
                order = np.argsort(own)
                at = np.minimum(np.searchsorted(own[order], wanted), len(own) - 1)
                grid_row = np.where(own[order][at] == wanted, order[at], -1)
                for item, terms_of in asked:
                    here = terms_of[(grid_row[terms_of] >= 0) & (weight[terms_of] > 0)]
                    if len(here):
                        descend(tree, grid_row[here], weight[here], docs, best[item])
        for item, b in best.items():
            if len(b.score):
                yield pa.record_batch({"item_id": np.full(len(b.score), item, np.int64), "doc_id": b.doc, "score": b.score})

    return index_rows.mapInArrow(rows, FOUND).withColumn("task", F.spark_partition_id())


def search(index_rows: DataFrame, items: DataFrame, n: int, k: int = 10, at_once: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of each item, best first; the best of each task are stored."""
    with batches(items.sparkSession, BATCH_BYTES):
        found = written(_found(index_rows, items, n, k, at_once))
    ranking = [F.col("score").desc(), F.col("doc_id").asc()]
    few = Window.partitionBy("item_id", "slice").orderBy(*ranking)
    found = found.withColumn("slice", F.col("task") % SLICES)
    found = found.withColumn("rank", F.row_number().over(few)).filter(F.col("rank") <= k)  # fewer rows per item before the last window
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*ranking))
    return found.withColumn("rank", last).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _found(index_rows: DataFrame, items: DataFrame, n: int, k: int, at_once: int) -> DataFrame:
    """The best ``k`` documents of each item and task, in as many passes as the items take."""
    asked = written(item_terms(items).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    parts = max(1, -(-asked.count() // at_once))
    found = None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about at_once items
        some = _search(index_rows, [(r["item_id"], np.array(r["terms"], np.int64)) for r in rows], n, k)
        found = some if found is None else found.unionByName(some)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents, store the index, and search all items."""
    with batches(docs.sparkSession, BATCH_BYTES):
        n, total = statistics(docs)
        rows = written(index(docs, n, total), group=BATCH_BYTES)
    return search(rows, items, n, k)
