"""Delete blocks of lines that an earlier document has, by pairwise alignment.

Lines are compared by a 64-bit hash after trimming blanks. From each line the shortest run of lines with ``BLOCK_WORDS`` words,
forward and backward, is a key, which belongs to the earliest document that holds it, its owner. Every line of a common block
of that size lies in such a run inside the block, however short the lines are and whoever else holds them one by one. A
document is aligned with the owners of all its keys by patience diff: lines that are unique on both sides form the longest common
order, and equal neighbours extend it. Aligned runs with at least ``BLOCK_WORDS`` words are deleted from the later document, and so
are such runs that the alignment leaves because they are repeated or stand in another order.

Every key has one owner, so a run held by very many documents gives one pair for each of them, never all pairs. Later
means a larger ``doc_id``, then a larger text hash for rows that share an id; equal rows are one document. Null and empty texts
and rows without ``doc_id`` stay as they are. All other columns are kept.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from enrichflow.llm.words import run_hashes
from enrichflow.sources.scratch import written

BLOCK_WORDS = 20
_BLANKS = r"[ \t-\r]+"


def increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        k = bisect_left(tops, value)
        before[i] = at[k - 1] if k else -1
        tops[k:k + 1], at[k:k + 1] = [value], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched positions of two lists, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        place = {a[k]: k for k in range(i, m) if left[a[k]] == 1 and right.get(a[k]) == 1}
        there = [k for k in range(j, n) if b[k] in place]
        chosen = [there[k] for k in increasing([place[b[k]] for k in there])]
        edges = [(i, j)] if chosen else []
        for k in chosen:
            out.append((place[b[k]], k))
            todo.append((edges[-1][0], place[b[k]], edges[-1][1], k))
            edges.append((place[b[k]] + 1, k + 1))
        if chosen:
            todo.append((edges[-1][0], m, edges[-1][1], n))
    return sorted(out)


def shortest_runs(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the runs with at least ``least`` words that are the shortest from their first or up to their last line.

    ``words`` counts those of the lines of several texts; text ``i`` has lines ``first[i]`` to ``first[i + 1]``.
    """
    sums, at = np.append(0, np.cumsum(words)), np.arange(len(words))
    sizes = np.diff(first)
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    until = np.searchsorted(sums, sums[:-1] + least, "left")
    since = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead, back = until <= end, since >= begin
    return np.append(at[ahead], since[back]), np.append(until[ahead], at[back] + 1)


def left_blocks(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], least: int) -> set[int]:
    """Positions in ``later`` of all runs with at least ``least`` words that ``earlier`` has, in any order and number."""
    codes: dict[int, int] = {}
    values = np.array([codes.setdefault(x, len(codes)) for x in later], np.uint64)
    counts = np.zeros(len(codes) + 1, np.int64)
    counts[values] = words
    other = np.array([codes.get(x, len(codes)) for x in earlier], np.uint64)
    counts[-1] = 0
    found = []
    for side in (values, other):
        starts, ends = shortest_runs(counts[side], np.array([0, len(side)]), least)
        found.append((run_hashes(side, starts, ends), starts, ends))
    (keys, starts, ends), (there, _, _) = found
    hit = np.isin(keys, there)
    cover = np.zeros(len(later) + 1, np.int64)
    np.add.at(cover, starts[hit], 1)
    np.add.at(cover, ends[hit], -1)
    return set(np.flatnonzero(np.cumsum(cover)[:-1]).tolist())


def common_blocks(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], least: int) -> list[int]:
    """Positions in ``later`` of aligned runs with at least ``least`` words; ``words`` counts those of each later line.

    Patience diff leaves out what is repeated or in another order; blocks left in the later document are matched by their runs.
    """
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    if len(out) < len(later):
        return sorted(left_blocks(earlier, later, words, least).union(out))
    return out


def _key(text: str = "text") -> Column:
    return F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("hash"))


def _lines(docs: DataFrame) -> DataFrame:
    """(key, hashes, words): hash and number of words of each line, one row per document."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(_key().alias("key"), lines.alias("lines"))
    return rows.select(
        "key", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, _BLANKS, -1)))).alias("words")).dropDuplicates(["key"])


def _keys(lines: DataFrame, block_words: int) -> DataFrame:
    """(id, hash, line): hashes of the shortest runs of each document's lines, each once a document."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words = batch.column("hashes"), batch.column("words")
            first = hashes.offsets.to_numpy().astype(np.int64)
            first, values = first - first[0], hashes.flatten().to_numpy().view(np.uint64)
            starts, ends = shortest_runs(words.flatten().to_numpy().astype(np.int64), first, block_words)
            found = run_hashes(values, starts, ends)
            doc = np.searchsorted(first, starts, "right") - 1
            order = np.lexsort((found, doc))
            found, doc = found[order], doc[order]
            once = np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
            own = pa.array(doc[once])
            yield pa.record_batch([batch.column("id").take(own), batch.column("hash").take(own), pa.array(found[once].view(np.int64))],
                                  names=["id", "hash", "line"])

    return lines.select("key.id", "key.hash", "hashes", "words").mapInArrow(keys, "id bigint, hash bigint, line bigint")


def pairs(lines: DataFrame, rare: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, owner): later documents and the owners of their keys.

    ``rare`` is for callers who want fewer pairs and may lose blocks: owners of keys with more holders go, but for the rarest.
    """
    held = _keys(lines, block_words).select(F.struct("id", "hash").alias("key"), "line")
    shared = held.groupBy("line").agg(F.min("key").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    met = held.join(shared, "line").filter("owner < key").select("key", "owner", "n")
    best = met.groupBy("key", "owner").agg(F.min("n").alias("n"))
    if rare is None:
        return best.select("key", "owner")
    least = best.groupBy("key").agg(F.min("n").alias("least"))
    return best.join(least, "key").filter((F.col("n") <= rare) | (F.col("n") == F.col("least"))).select("key", "owner")


def repeated_lines(docs: DataFrame, rare: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, removed): line numbers to delete, counted from 0; ``key`` is document id and text hash."""
    lines = written(_lines(docs))
    near = pairs(lines, rare, block_words)
    met = near.join(lines.select("key", "hashes", "words"), "key").join(
        lines.select(F.col("key").alias("owner"), F.col("hashes").alias("earlier")), "owner")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, at = [], [], []
            for k in range(batch.num_rows):
                found = common_blocks(*(batch.column(c)[k].as_py() for c in ("earlier", "hashes", "words")), block_words)
                ids += [batch.column("id")[k].as_py()] * len(found)
                hashes += [batch.column("hash")[k].as_py()] * len(found)
                at += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32())], names=["id", "hash", "at"])

    found = met.select("key.id", "key.hash", "earlier", "hashes", "words").mapInArrow(align, "id bigint, hash bigint, at int")
    return found.groupBy(F.struct("id", "hash").alias("key")).agg(F.sort_array(F.collect_set("at")).alias("removed"))


def deduplicated(docs: DataFrame, **limits: int) -> DataFrame:
    """All rows with the kept lines as ``text``, and the columns ``n_lines`` and ``removed`` (line numbers, empty if none)."""
    removed = repeated_lines(docs, **limits)
    known = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), _key())
    rows = docs.withColumn("_key", known).join(removed.withColumnsRenamed({"key": "_key", "removed": "_removed"}), "_key", "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_removed", i)), "\n")
    own = {"text": F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)}
    columns = [own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "removed")]
    return rows.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
                       F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"))
