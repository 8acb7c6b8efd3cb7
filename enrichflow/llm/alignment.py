"""Align the tokens of two tokenizers on the bytes they cover.

Both tokenizers encode ``" " + text``: A is a byte-level pair encoding, B a SentencePiece model that adds the leading blank itself.
Where a token of A and a token of B end at the same byte, a group of tokens closes and the two tokens are linked.

A stretch of bytes is a ``Fragment``: the tokens before its first common end (open prefix), its closed groups, and the tokens
after its last common end (open suffix). ``joined`` puts two neighbouring fragments together, closing the group that lies over the
seam; it is associative and the empty fragment is neutral, so a document may be cut anywhere and put together in any
bracketing. A text of more than ``CHUNK`` bytes is cut into byte ranges, each is encoded in a task of its own, and its fragments are
joined ``FAN`` at a time until one is left. A token belongs to the range in which it ends.

What is encoded is a unit: from a blank between two characters that are no white space up to the next. Neither tokenizer joins bytes
across such a blank (checked for B in its vocabulary; otherwise a text is one unit), so a unit's tokens do not depend on the
rest of the text, and each distinct unit is encoded once per task. A unit that lies over the border of a range is encoded in both; a unit
longer than a range is cut by one border only.

Counts of linked id pairs are taken over all documents. A pair with at least a ``HOT``-th of all links is one of at most ``HOT`` pairs, and those
are sent to every task; the rest join their counts by a shuffle in which no pair has more than that share of the links.

Null and empty texts, and texts that the tokenizers do not give back byte for byte, have no tokens: zeros, and '' for the groups.
Every row gives a row, also without ``doc_id`` or repeated. Other columns are ignored. Tokens never cover zero bytes. Tokenizer files
are read on the driver and travel with the tasks.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from enrichflow.llm.pieces_codec import BYTE, MARK, parse_model, splits_by_word
from enrichflow.llm.words import slices
from enrichflow.sources.scratch import written

CHUNK, FAN, HOT, KNOWN, TOGETHER, BATCH_BYTES = 1 << 16, 32, 100_000, 60_000, 500, 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
ALIGNED = "row_id bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, counts binary"
FRAGMENTS = ("row_id bigint, doc_id bigint, chunk bigint, good boolean, n_a bigint, n_b bigint, n_groups bigint, cut boolean, head_a binary, head_b binary, "
             "closed string, tail_a binary, tail_b binary, pairs binary, counts binary")
_EMPTY = np.zeros(0, np.int32)


def byte_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merged(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    pairs = list(pairs)
    keys = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    counts = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    keys, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, counts)
    return keys, sums


def group_text(a: Iterable[int], b: Iterable[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


@dataclass
class Fragment:
    """A stretch of bytes between two cuts; without a common end inside (``cut``) all its tokens are in the prefix."""

    head_a: np.ndarray = field(default_factory=lambda: _EMPTY)
    head_b: np.ndarray = field(default_factory=lambda: _EMPTY)
    cut: bool = False
    closed: list[str] = field(default_factory=list)
    tail_a: np.ndarray = field(default_factory=lambda: _EMPTY)
    tail_b: np.ndarray = field(default_factory=lambda: _EMPTY)
    n_groups: int = 0


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """The fragment of tokens given with the bytes at which they end, and the id pairs (``a << 32 | b``) that it links."""
    _, at, bt = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    if not len(at):
        return Fragment(a, b), np.zeros(0, np.int64)
    links = (a[at].astype(np.int64) << 32) | b[bt]
    xs, ys = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
    closed = [",".join(xs[i + 1:k + 1]) + "|" + ",".join(ys[j + 1:m + 1]) for i, k, j, m in zip(at[:-1].tolist(), at[1:].tolist(), bt[:-1].tolist(), bt[1:].tolist())]
    return Fragment(a[:at[0] + 1], b[:bt[0] + 1], True, closed, a[at[-1] + 1:], b[bt[-1] + 1:], len(closed)), links


def joined(parts: Iterable[Fragment]) -> Fragment:
    """Neighbouring fragments as one."""
    out = Fragment()
    for part in parts:
        a, b = (np.concatenate(x) for x in ((out.tail_a if out.cut else out.head_a, part.head_a), (out.tail_b if out.cut else out.head_b, part.head_b)))
        if not out.cut:
            out = Fragment(a, b, part.cut, list(part.closed), part.tail_a, part.tail_b, part.n_groups)
        elif not part.cut:
            out = Fragment(out.head_a, out.head_b, True, out.closed, a, b, out.n_groups)
        else:
            out.closed.append(group_text(a, b))
            out.closed.extend(part.closed)
            out = Fragment(out.head_a, out.head_b, True, out.closed, part.tail_a, part.tail_b, out.n_groups + 1 + part.n_groups)
    return out


def finished(whole: Fragment) -> tuple[int, str]:
    """Groups of a whole document and their digest; its end is a common end, so nothing is left open behind it."""
    if not whole.cut:
        return 0, ""
    text = ";".join([group_text(whole.head_a, whole.head_b), *whole.closed])
    return whole.n_groups + 1, hashlib.sha256(text.encode()).hexdigest()


def _ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of the ranges ``first`` to ``first + length``, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Tokens:
    """Tokens of many units, with the byte at which each ends, counted from the first unit on."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    ends: np.ndarray


class Pair:
    """Both tokenizers, with a table of encoded units: their tokens lie one after the other in flat arrays.

    Each new unit is encoded once; the table is emptied when it has ``KNOWN`` units.
    """

    def __init__(self, a_json: str, b_raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        table = byte_table()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()
        model = parse_model(b_raw)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_raw)
        self.b_bytes = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in model.pieces]
        self.a_size, self.b_size = (np.array([len(t) for t in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        plain = not (model.charsmap or model.squeeze or any(t[2] == 4 for t in model.pieces))
        self.by_unit = plain and model.dummy_prefix and splits_by_word(model)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good, self.size = np.zeros(0, bool), np.zeros(0, np.int64)
        self.sides = [{"ids": _EMPTY, "ends": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "count": np.zeros(0, np.int64)} for _ in range(2)]

    def units(self, text: str) -> list[str]:
        """The units of a text that begins with a blank; each begins with one."""
        if not self.by_unit:
            return [text]
        cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        return [text[i:k] for i, k in zip(cuts, cuts[1:])]

    def _encoded(self, text: str) -> tuple[bool, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether both give the text back, and ids with the bytes at which they end."""
        whole, good, out = text.encode(), True, []
        for ids, known, size in ((self.a.encode(text, add_special_tokens=False).ids, self.a_bytes, self.a_size), (self.b.encode(text[1:]), self.b_bytes, self.b_size)):
            good = good and b"".join([known[i] for i in ids]) == whole
            ids = np.array(ids, np.int32)
            out.append((ids, np.cumsum(size[ids])))
        return good, out

    def _learn(self, units: list[str]) -> None:
        """Encode new units. Several are encoded as one text and told apart at their borders, as no token lies across one."""
        done: list[tuple[str, bool, int]] = []
        flat: list[list[np.ndarray]] = [[], [], [], [], [], []]  # ids, ends and counts of A, then of B

        def keep(own: list[str], sizes: np.ndarray, good: bool, sides) -> None:
            borders = np.append(0, np.cumsum(sizes))
            for k, (ids, ends) in enumerate(sides):
                at = np.searchsorted(ends, borders, "right") if good else np.zeros(len(borders), np.int64)
                count = np.diff(at)
                flat[3 * k].append(ids[:at[-1]])
                flat[3 * k + 1].append(ends[:at[-1]] - np.repeat(borders[:-1], count))
                flat[3 * k + 2].append(count)
            done.extend((u, good, int(n)) for u, n in zip(own, sizes))

        def encode(own: list[str]) -> None:
            sizes = np.array([len(u.encode()) for u in own], np.int64)
            good, sides = self._encoded("".join(own))
            if good or len(own) == 1:
                keep(own, sizes, good, sides)
            else:
                for u in own:  # some unit is not given back: each for itself
                    encode([u])

        # a unit that begins or ends in white space would change what stands next to it
        apart = [u for u in units if not self.by_unit or len(u) < 2 or u[-1].isspace() or u[1].isspace()]
        joint = sorted(set(units).difference(apart))
        for at in range(0, len(joint), TOGETHER):
            encode(joint[at:at + TOGETHER])
        for u in apart:
            encode([u])
        base = len(self.known)
        self.known.update((u, base + i) for i, (u, _, _) in enumerate(done))
        self.good = np.append(self.good, np.array([g for _, g, _ in done], bool))
        self.size = np.append(self.size, np.array([n for _, _, n in done], np.int64))
        for k, side in enumerate(self.sides):
            count = np.concatenate([side["count"], *flat[3 * k + 2]])
            self.sides[k] = {"ids": np.concatenate([side["ids"], *flat[3 * k]]), "ends": np.concatenate([side["ends"], *flat[3 * k + 1]]),
                             "first": np.cumsum(count) - count, "count": count}

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The places of the units of each text in the table, which then holds them all."""
        if len(self.known) > KNOWN:
            self._clear()
        new = set().union(*texts).difference(self.known)
        if new:
            self._learn(sorted(new))
        return [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in texts]

    def tokens(self, numbers: np.ndarray) -> Tokens:
        """The tokens of units that follow each other."""
        ends = np.cumsum(self.size[numbers])
        out = []
        for side in self.sides:
            at = _ragged(side["first"][numbers], side["count"][numbers])
            out += [side["ids"][at], side["ends"][at] + np.repeat(ends - self.size[numbers], side["count"][numbers])]
        return Tokens(*out, ends)


_MARKS = pa.array([",", "|", ";"])


def group_texts(t: Tokens, at: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text, each behind a ``;`` but the first, in one buffer with a last ``;``, and where the text of each group ends.

    ``at`` and ``bt`` are the tokens at which groups end; nothing is open behind the last one.
    """
    n_a, n_b = np.diff(at, prepend=-1), np.diff(bt, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(at)), n_a), np.repeat(np.arange(len(bt)), n_b)
    to_a = np.arange(len(group_a)) + (np.cumsum(n_b) - n_b)[group_a]
    to_b = np.arange(len(group_b)) + np.cumsum(n_a)[group_b]
    ids, mark = np.empty(len(to_a) + len(to_b), np.int32), np.zeros(len(to_a) + len(to_b), np.int8)
    ids[to_a], ids[to_b] = t.a[:len(to_a)], t.b[:len(to_b)]
    mark[to_a[at]], mark[to_b[bt]] = 1, 2
    text = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.large_string()), _MARKS.cast(pa.large_string()).take(pa.array(mark)), pa.scalar("", pa.large_string()))
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[to_b[bt] + 1]


def _short(batches: Iterator[pa.RecordBatch], make: Callable[[], Pair]) -> Iterator[pa.RecordBatch]:
    pair = None
    for part in slices(batches, most=BATCH_BYTES):
        pair = pair or make()
        numbers = pair.numbers([pair.units(" " + t) if t else [] for t in part.column("text").to_pylist()])
        usable = [len(own) > 0 and bool(pair.good[own].all()) for own in numbers]
        kept = [own for own, use in zip(numbers, usable) if use]
        rows = [(0, 0, 0, 0, "", b"", b"")] * part.num_rows
        if kept:
            t = pair.tokens(np.concatenate(kept))
            common, at, bt = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True, return_indices=True)
            text, stops = group_texts(t, at, bt)
            links = (t.a[at].astype(np.int64) << 32) | t.b[bt]
            last = np.searchsorted(common, t.ends[np.cumsum([len(own) for own in kept]) - 1], "right")
            before = tokens_a = tokens_b = byte = 0
            for i, until in zip(np.flatnonzero(usable).tolist(), last.tolist()):
                keys, counts = np.unique(links[before:until], return_counts=True)
                digest = hashlib.sha256(text[byte:stops[until - 1] - 1]).hexdigest()
                n_a, n_b = int(at[until - 1]) + 1 - tokens_a, int(bt[until - 1]) + 1 - tokens_b
                rows[i] = (n_a, n_b, until - before, until - before, digest, keys.tobytes(), counts.astype(np.int32).tobytes())
                before, tokens_a, tokens_b, byte = until, tokens_a + n_a, tokens_b + n_b, int(stops[until - 1])
        n_a, n_b, groups, links, digest, keys, counts = zip(*rows)
        yield pa.record_batch({"row_id": part.column("row_id"), "doc_id": part.column("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links,
                               "groups_sha256": digest, "pairs": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _ranges(batches: Iterator[pa.RecordBatch], make: Callable[[], Pair], chunk: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of long texts: range ``low`` to ``high`` of the units from byte ``base`` on."""
    pair = None
    for part in slices(batches, most=BATCH_BYTES):
        pair = pair or make()
        for row in part.select(["row_id", "doc_id", "text"]).to_pylist():
            units = pair.units(" " + row["text"])
            sizes = np.array([len(u.encode()) for u in units], np.int64)
            starts = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            borders = np.arange(chunk, total, chunk)
            of = np.searchsorted(starts, borders, "right") - 1
            borders = borders[np.append(True, of[1:] != of[:-1])] if len(of) else borders  # one border in a unit
            borders = [0, *borders.tolist(), total]
            for k, (low, high) in enumerate(zip(borders, borders[1:])):
                i, j = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high, "left"))
                yield pa.record_batch({"row_id": [row["row_id"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "chunk": [k], "low": [low], "high": [high],
                                       "base": [int(starts[i])], "text": ["".join(units[i:j])]})


def _packed(row_id: int, doc_id: int | None, chunk: int, good: bool, n_a: int, n_b: int, own: Fragment, keys: np.ndarray, counts: np.ndarray) -> dict:
    return {"row_id": row_id, "doc_id": doc_id, "chunk": chunk, "good": good, "n_a": n_a, "n_b": n_b, "n_groups": own.n_groups, "cut": own.cut,
            "head_a": own.head_a.astype(np.int32).tobytes(), "head_b": own.head_b.astype(np.int32).tobytes(), "closed": ";".join(own.closed),
            "tail_a": own.tail_a.astype(np.int32).tobytes(), "tail_b": own.tail_b.astype(np.int32).tobytes(),
            "pairs": keys.tobytes(), "counts": counts.astype(np.int32).tobytes()}


_FRAGMENTS = pa.schema([(c.split()[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]])
                        for c in FRAGMENTS.split(", ")])


def _fragments(batches: Iterator[pa.RecordBatch], make: Callable[[], Pair]) -> Iterator[pa.RecordBatch]:
    pair = None
    for part in slices(batches, most=BATCH_BYTES):
        pair = pair or make()
        for row in part.to_pylist():
            numbers = pair.numbers([pair.units(row["text"])])[0]
            low, high = row["low"], row["high"]
            if not pair.good[numbers].all():
                out = _packed(row["row_id"], row["doc_id"], row["chunk"], False, 0, 0, Fragment(), np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                t, sides = pair.tokens(numbers), []
                for ids, ends in ((t.a, t.a_ends), (t.b, t.b_ends)):
                    ends = ends + row["base"]
                    inside = (ends > low) & (ends <= high)
                    sides += [ids[inside], ends[inside]]
                made, links = fragment(*sides)
                out = _packed(row["row_id"], row["doc_id"], row["chunk"], True, len(sides[0]), len(sides[2]), made, *merged([(links, np.ones(len(links), np.int64))]))
            yield pa.RecordBatch.from_pylist([out], schema=_FRAGMENTS)


def _combine(table: pa.Table, fan: int) -> pa.Table:
    """Join the fragments of one document that lie in one node of the tree."""
    rows = table.sort_by("chunk").to_pylist()
    parts = (Fragment(*(np.frombuffer(r[c], np.int32) for c in ("head_a", "head_b")), r["cut"], [r["closed"]] if r["n_groups"] else [],
                      *(np.frombuffer(r[c], np.int32) for c in ("tail_a", "tail_b")), r["n_groups"]) for r in rows)
    keys, counts = merged((np.frombuffer(r["pairs"], np.int64), np.frombuffer(r["counts"], np.int32).astype(np.int64)) for r in rows)
    out = _packed(rows[0]["row_id"], rows[0]["doc_id"], rows[0]["chunk"] // fan, all(r["good"] for r in rows), sum(r["n_a"] for r in rows),
                  sum(r["n_b"] for r in rows), joined(parts), keys, counts)
    return pa.Table.from_pylist([out], schema=_FRAGMENTS)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents from their last fragment."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            whole = Fragment(*(np.frombuffer(r[c], np.int32) for c in ("head_a", "head_b")), r["cut"], [r["closed"]] if r["n_groups"] else [], n_groups=r["n_groups"])
            groups, digest = finished(whole) if r["good"] else (0, "")
            counts = np.frombuffer(r["counts"], np.int32)
            rows.append((r["row_id"], r["doc_id"], r["n_a"], r["n_b"], groups, int(counts.sum()), digest, r["pairs"], r["counts"]) if r["good"]
                        else (r["row_id"], r["doc_id"], 0, 0, 0, 0, "", b"", b""))
        if rows:
            cols = list(zip(*rows))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()])],
                                  names=[c.split()[0] for c in ALIGNED.split(", ")])


def aligned(docs: DataFrame, a_json: str, b_raw: bytes, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per row: token, group and link counts, the digest of its groups, and its linked id pairs with their counts, packed."""
    def make() -> Pair:
        return Pair(a_json, b_raw)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = rows.filter(~long).mapInArrow(lambda batches: _short(batches, make), ALIGNED)
    ranges = rows.filter(long).mapInArrow(lambda batches: _ranges(batches, make, chunk),
                                          "row_id bigint, doc_id bigint, chunk bigint, low bigint, high bigint, base bigint, text string")
    parts = written(ranges.repartition("row_id", "chunk").mapInArrow(lambda batches: _fragments(batches, make), FRAGMENTS))
    last = parts.agg(F.max("chunk")).first()[0] or 0
    while True:
        parts = parts.withColumn("node", F.floor(F.col("chunk") / fan)).groupBy("row_id", "node").applyInArrow(
            lambda table: _combine(table.drop_columns(["node"]), fan), FRAGMENTS)
        last //= fan
        if not last:
            break
        parts = written(parts)
    return short.unionByName(parts.mapInArrow(_closed, ALIGNED))


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether no pair with the same id of B has more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys, counts in zip(batch.column("pairs"), batch.column("counts")):
                held.append((np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield pa.record_batch({"pair": held[0][0], "n": held[0][1]})
                        held, size = [], 0
        if held:
            keys, counts = merged(held)
            yield pa.record_batch({"pair": keys, "n": counts})

    counted = stored.select("pairs", "counts").mapInArrow(rows, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, a_json: str, b_raw: bytes, chunk: int = CHUNK, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    stored = written(aligned(docs, a_json, b_raw, chunk, fan))
    counted = written(pair_counts(stored))
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter(F.col("n") >= total / hot).orderBy("pair").toPandas()  # at most ``hot`` rows, as n adds up to total
    pair, n, best = frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, best))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column("pairs"), batch.column("counts")):
                keys, counts = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1) if len(pair) else np.zeros(len(keys), np.int64)
                met = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                held, times = at[met], counts[met]
                out.append((int(times[best[held]].sum()), int((times * n[held]).sum()), keys[~met].tolist(), counts[~met].tolist()))
            if out:
                n_best, sums, rest, often = zip(*out)
                plain = [batch.column(c) for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.record_batch([*plain, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.int64())),
                                       pa.array(often, pa.list_(pa.int64()))],
                                      names=["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "hot_best", "hot_sum", "rest", "often"])

    first = written(stored.mapInArrow(rows, "row_id bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                            "hot_best bigint, hot_sum bigint, rest array<bigint>, often array<bigint>"))
    few = first.select("row_id", F.explode(F.arrays_zip("rest", "often")).alias("x")).select("row_id", F.col("x.rest").alias("pair"), F.col("x.often").alias("often"))
    sums = few.join(counted, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
                                                            F.sum(F.col("often") * F.col("n")).alias("more_sum"))
    return first.join(sums, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("hot_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
