"""Jaccard similarity join on word shingles by universe partition, with exact verification.

A document is the set of its distinct word n-grams (A-Z lower-cased); a text with fewer words is one gram, a text without
words has an empty set and is linked with nothing. Two documents link when ``100 * intersection >= percent * union``.

1. Equal sets are one node. A gram that only one document holds cannot be in an intersection, so a document whose shared
   grams are fewer than ``percent`` of its set is linked with nothing; ``exchange`` counts shared grams over all documents.
2. Sizes are cut into bands so that linked sets lie in the same or neighbouring bands; each node is indexed for its own band
   and the next. In a band, linked sets differ in at most ``H`` grams. The universe of gram hashes is cut into parts; by the
   pigeonhole at least one part differs in at most ``k`` grams when there are more than ``H / (k + 1)`` parts.
3. A part is indexed whole (``k = 0``), as the subsets of its segments that leave one out, or with its one-deletion
   neighbourhood (``k = 1`` both). Which one is used is decided per band from the number of nodes in it: index rows against
   expected chance meetings.
4. Candidates meet in an index row. Each row links its members to its least member first; only members that the verified
   links have not connected meet each other after that, behind a size and a parity-sketch test that no linked pair fails.
   Every link that counts is verified on the whole sets.

Rows without ``doc_id`` get no component. Rows that share a ``doc_id`` count as one document for the first filter. Extra
columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm import exchange
from enrichflow.llm.components import components
from enrichflow.llm.words import _WORDS, Words, _range_hashes, mix, pieces, release
from enrichflow.sources.scratch import written

SETS = "doc_id bigint, node bigint, n bigint"
SKETCH = 16  # words of 64 bits
SKETCHES = [f"s{i}" for i in range(SKETCH)]
NODES = "node bigint, n bigint, grams binary, " + ", ".join(f"{s} bigint" for s in SKETCHES)
INDEX = "sig bigint, node bigint"
ROW_COST, MEETING_COST = 1.0, 4.0


def gram_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes, sorted within each text, and where each text's start; one more start closes the last."""
    hashes = words.hashes()
    grams, at = words.grams(hashes, size)
    text, short = words.text_of[at], np.flatnonzero((words.counts > 0) & (words.counts < size))
    grams = np.append(grams, words.sequence(hashes)[short])
    text = np.append(text, short)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(words.first)))


def _nodes(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sizes = np.diff(first).astype(np.uint64)
    return mix(_range_hashes(grams, first[:-1], first[1:], _WORDS) + sizes).view(np.int64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in pieces(batches, lower=True):
            grams, first = gram_sets(words, size)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "node": _nodes(grams, first),
                                   "n": np.diff(first).astype(np.int64)})

    return docs.mapInArrow(rows, SETS)


def _shared(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shared): how many grams of a document another one has, or a few more."""
    buckets = exchange.bucket_count(docs)

    def entries(batches):
        for part, words in pieces(batches, lower=True):
            grams, first = gram_sets(words, size)
            ids = np.repeat(part.column("doc_id").to_numpy(), np.diff(first))
            yield grams, ids, np.zeros(len(grams), bool)

    sent = docs.mapInArrow(lambda batches: exchange.send(entries(batches), buckets, "counted"), exchange.SENT)
    return exchange.meet(sent, "counted", buckets).select("doc_id", (F.octet_length("keys") / 4).cast("bigint").alias("shared"))


def _stored_sets(docs: DataFrame, size: int) -> DataFrame:
    """One row per distinct set: its sorted grams and a parity sketch of ``64 * SKETCH`` bits."""

    def rows(batches):
        seen: set[int] = set()
        for _, words in pieces(batches, lower=True):
            grams, first = gram_sets(words, size)
            out = []
            for i, node in enumerate(_nodes(grams, first).tolist()):
                if node in seen:
                    continue
                seen.add(node)
                own = grams[first[i]:first[i + 1]]
                odd = np.bincount((own >> np.uint64(54)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                out.append((node, len(own), own.tobytes(), *sketch))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["node", "n", "grams", *SKETCHES])

    return docs.mapInArrow(rows, NODES).dropDuplicates(["node"])


def difference(a: int, b: int, percent: int) -> int:
    """The most grams in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def band_tops(largest: int, percent: int) -> list[int]:
    """Largest size of each band."""
    tops, top = [], 0
    while top < largest:
        top = (top + 1) * 100 // percent
        tops.append(top)
    return tops


def allocate(low: int, top: int, nodes: int, percent: int) -> tuple[int, int, int] | None:
    """(parts, k, segments) for the sets of one band and the one below it; 0 segments is the one-deletion neighbourhood.

    None if such sets link only when they are equal. Two unrelated parts that hold about ``x`` grams agree with a chance of
    about ``exp(-2 * x)``, both being empty for the most part.
    """
    most = difference(top, top, percent)
    if not most:
        return None
    best = None
    for k, segments in ((0, 1), (1, 2), (1, 3), (1, 4), (1, 0)):
        parts = most // (k + 1) + 1
        held = low / parts
        rows = parts * (segments or 1 + held)
        kept = held * (1 if not k else 1 - 1 / segments) if segments else held - 1
        chance = min(1.0, math.exp(-2 * max(kept, 0)) * (segments or 1 + 2 * held))
        cost = ROW_COST * nodes * rows + MEETING_COST * nodes * nodes / 2 * parts * chance
        if best is None or cost < best[0]:
            best = (cost, (parts, k, segments))
    return best[1]


def _plan(nodes: DataFrame, percent: int, choose=allocate) -> tuple[list[int], dict[int, tuple[int, int, int]]]:
    """Band tops and the allocation of each band. The number of bands is the logarithm of the largest set."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    tops = band_tops(largest, percent)
    if not tops:
        return tops, {}
    edges = F.array(*(F.lit(t) for t in tops))
    counts = {r["band"]: r["count"] for r in nodes.select(
        F.size(F.filter(edges, lambda t: t < F.col("n"))).alias("band")).groupBy("band").count().collect()}
    lows = [1] + [t + 1 for t in tops]
    plan = {}
    for band, top in enumerate(tops):
        many = counts.get(band, 0) + counts.get(band - 1, 0)
        chosen = choose(lows[max(band - 1, 0)], top, many, percent) if many > 1 else None
        if chosen:
            plan[band] = chosen
    return tops, plan


def _index_rows(grams: np.ndarray, owner: np.ndarray, count: int, band: int, how: tuple[int, int, int]):
    """Index rows of ``count`` sets given as grams with their owner: signatures and owners."""
    parts, k, segments = how
    seed = np.uint64(mix(np.array([band * 8 + k * 4 + segments + 1], np.uint64))[0])
    part = ((grams & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
    value, cell = mix(grams ^ seed), owner * parts + part
    whole = np.zeros(count * parts, np.uint64)
    np.add.at(whole, cell, value)
    place = mix(np.arange(parts, dtype=np.uint64) + seed)
    of = np.repeat(np.arange(count), parts)
    if k == 0 or segments == 0:
        yield mix(whole + np.tile(place, count)), of
    if k and not segments:
        yield mix(whole[cell] - value + place[part]), owner
    elif k:
        segment = ((grams >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
        sums = np.zeros(count * parts * segments, np.uint64)
        np.add.at(sums, cell * segments + segment, value)
        out = mix(np.arange(segments, dtype=np.uint64) + seed * np.uint64(3))
        rest = whole[:, None] - sums.reshape(-1, segments)
        yield mix(rest + np.tile(place, count)[:, None] + out).ravel(), np.repeat(of, segments)


def _index(nodes: DataFrame, tops: list[int], plan: dict[int, tuple[int, int, int]]) -> DataFrame:
    def rows(batches):
        for batch in batches:
            sizes, ids = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            bands = np.searchsorted(np.array(tops), sizes)
            for band, how in plan.items():
                mine = np.flatnonzero((bands == band) | (bands == band - 1))
                for at in np.split(mine, np.flatnonzero(np.diff(np.cumsum(sizes[mine]) // 500_000)) + 1):
                    if not len(at):
                        continue
                    grams = [np.frombuffer(batch.column("grams")[int(i)].as_buffer(), np.uint64) for i in at]
                    owner = np.repeat(np.arange(len(at)), [len(g) for g in grams])
                    for sig, own in _index_rows(np.concatenate(grams), owner, len(at), band, how):
                        yield pa.record_batch({"sig": sig.view(np.int64), "node": ids[at][own]})
            release()

    return nodes.select("node", "n", "grams").mapInArrow(rows, INDEX)


def _possible(a: str, b: str, percent: int):
    """Size and sketch tests that every linked pair passes: sets that differ in ``d`` grams have sketches at most ``d`` bits apart.

    A quarter of the sketch is tested first. The whole one is wide enough that few pairs pass that miss the threshold by more
    than a few grams, so members of a large group that are not linked do not meet in pairs.
    """
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    most = F.floor((small + large) * (100 - percent) / (100 + percent))

    def apart(words):
        return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words), F.lit(0))

    return (100 * small >= percent * large) & (apart(SKETCHES[:SKETCH // 4]) <= most) & (apart(SKETCHES) <= most)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    slim = nodes.select("node", "n", *SKETCHES)
    left, right = slim.alias("x"), slim.alias("y")
    likely = (pairs.join(left, F.col("a") == F.col("x.node")).join(right, F.col("b") == F.col("y.node"))
              .filter(_possible("x", "y", percent)).select("a", "b"))
    whole = nodes.select("node", "grams")
    met = (likely.join(whole.withColumnsRenamed({"node": "a", "grams": "left"}), "a")
           .join(whole.withColumnsRenamed({"node": "b", "grams": "right"}), "b"))

    def test(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                one, two = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((one, two)))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    return met.select("a", "b", "left", "right").mapInArrow(test, "a bigint, b bigint")


def classes(nodes: DataFrame, percent: int, choose=allocate) -> DataFrame:
    """(node, root) of linked nodes; a node that is the root of its class or linked with nothing has no row."""
    tops, plan = _plan(nodes, percent, choose)
    index = written(_index(nodes, tops, plan))
    rows = index.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    met = written(index.join(rows.select("sig", "least"), "sig"))
    stars = met.filter("node <> least").groupBy("node", "least").agg(F.count("*").alias("n"))
    stars = written(stars.select(F.col("least").alias("a"), F.col("node").alias("b"), "n"))
    links = written(verified(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), nodes, percent))
    found = written(components(links))

    def rooted(frame: DataFrame, column: str) -> DataFrame:
        roots = found.withColumnsRenamed({"node": column, "root": f"{column}_root"})
        return frame.join(roots, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))

    apart = rooted(rooted(stars.select("a", "b"), "a"), "b").filter("a_root <> b_root").select("a", "b")
    links = written(links.unionByName(verified(apart, nodes, percent)))
    found = written(components(links))

    open_rows = rooted(met.select("sig", "node"), "node")
    several = open_rows.groupBy("sig").agg(F.min("node_root").alias("x"), F.max("node_root").alias("y")).filter("x < y")
    slim = nodes.select("node", "n", *SKETCHES)
    ends = written(open_rows.join(several.select("sig"), "sig").join(slim, "node"))
    one, two = ends.alias("one"), ends.alias("two")
    rest = (one.join(two, (F.col("one.sig") == F.col("two.sig")) & (F.col("one.node") < F.col("two.node"))
                     & (F.col("one.node_root") != F.col("two.node_root")) & _possible("one", "two", percent))
            .select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct())
    return components(links.unionByName(verified(rest, nodes, percent)))


def linked(docs: DataFrame, size: int = 5, percent: int = 80, choose=allocate) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable by links."""
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id IS NOT NULL")
    sets = written(_sets(docs, size))
    mine = sets.join(_shared(known, size), "doc_id").filter(F.col("n") > 0).filter(F.col("shared") * 100 >= F.col("n") * percent)
    mine = written(mine.select("doc_id").distinct())
    nodes = written(_stored_sets(known.join(mine, "doc_id", "left_semi"), size))
    roots = classes(nodes, percent, choose)
    placed = sets.join(roots, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("class"))
    least = placed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
