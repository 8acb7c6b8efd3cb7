"""Encode and decode texts with a SentencePiece model on the backend of the ``tokenizers`` library.

The model protobuf is read here and rebuilt: the normaliser (its precompiled map, extra blanks, the dummy prefix), the blank
marker, unigram scores or byte-pair merges in score order, and byte fallback. Batches are encoded by the library's threads.
Everything is also encoded by the ``sentencepiece`` library, and ``parity`` says whether the ids are equal; ``round_trip`` says
whether decoding gives the normalised text back (a text that holds the blank marker itself comes back with blanks).

Where no piece holds a blank marker after another character (checked in the vocabulary) and the normaliser changes nothing
else, no token crosses from a word into the next blank, so a text's ids are those of its words and each distinct word is
encoded and checked once per task. Otherwise whole texts are. Where two unigram segmentations have the same score, the
libraries may choose differently, and ``parity`` is false; so it is for a text that spells the name of a byte piece of a
unigram model. Null texts count as empty: no ids. Rows stay as they come; other
columns are ignored. The model file is read on the driver and travels with the tasks, so executors need no copy.
"""
from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from enrichflow.llm.words import release, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
ENCODED = "doc_id bigint, n_tokens int, ids array<int>, n_bytes int, parity boolean, round_trip boolean"
BATCH_BYTES, KNOWN, KNOWN_CHARS, TOGETHER = 1 << 18, 500_000, 8_000_000, 500


@dataclass
class SpModel:
    """What the protobuf holds that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = number()
        if at + size > len(raw):
            raise ValueError("the model file is cut off")
        yield tag >> 3, raw[at:at + size]
        at += size


def parse_model(raw: bytes) -> SpModel:
    """Read a model protobuf; fields that encoding does not need are skipped."""
    model = SpModel()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            model.suffix = bool(spec.get(24, 0))
            model.unknown = spec.get(44, model.unknown.encode()).decode()
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
        raise ValueError("only unigram and byte-pair models with a blank marker before words are supported")
    return model


def splits_by_word(model: SpModel) -> bool:
    """Whether no piece crosses from a word into the next blank."""
    return all(re.fullmatch(f"{MARK}*[^{MARK}]*", text) for text, _, kind in model.pieces if kind in (NORMAL, USER))


def merges(model: SpModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score of the joined piece first."""
    known = {text for text, _, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = sorted((t for t in model.pieces if t[2] == NORMAL and len(t[0]) > 1), key=lambda t: -t[1])
    return [(text[:k], text[k:]) for text, _, _ in ranked for k in range(1, len(text)) if text[:k] in known and text[k:] in known]


def build(model: SpModel):
    """A tokenizer of the ``tokenizers`` library for the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, t in enumerate(model.pieces) if t[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # other pieces have the lowest score, from which the one of unknown characters follows; names of control pieces must not match
        never = min((score for _, score, kind in model.pieces if kind == NORMAL), default=0.0)
        table = [(text, score) if kind in (NORMAL, USER) else (model.unknown, never) if kind == UNKNOWN else (text if kind == BYTE else f"\uffff{i}", never)
                 for i, (text, score, kind) in enumerate(model.pieces)]
        core = models.Unigram(table, unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({t[0]: i for i, t in enumerate(model.pieces)}, merges(model), fuse_unk=True, byte_fallback=model.byte_fallback,
                          unk_token=None if unknown is None else model.pieces[unknown][0])
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if splits_by_word(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    backs = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(backs + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    marked = [AddedToken(t[0], normalized=False, special=False) for t in model.pieces if t[2] == USER]
    if marked:
        out.add_tokens(marked)
    return out


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=1)
def _backends(raw: bytes, threads: int):
    """Both libraries with the model, made once a worker: each new tokenizer leaves about 10 MB behind in its process."""
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
    import sentencepiece

    model = parse_model(raw)
    return model, build(model), sentencepiece.SentencePieceProcessor(model_proto=raw)


class Coder:
    """Both backends of a model; texts are cut into words where that is exact, and each new word is encoded once.

    Per text it gives the ids as packed 32-bit numbers, whether both backends agree on all parts and whether all parts
    decode to what they were. The table of known words is emptied when it has ``KNOWN`` entries or ``KNOWN_CHARS`` characters.
    """

    def __init__(self, raw: bytes, threads: int):
        self.threads = threads
        self.model, self.ours, self.theirs = _backends(raw, threads)
        plain = not (self.model.charsmap or self.model.squeeze or any(t[2] == USER for t in self.model.pieces))
        self.by_word = plain and self.model.dummy_prefix and splits_by_word(self.model)
        self.names = [t[0] for t in self.model.pieces]
        self.begins = np.array([n.startswith(MARK) for n in self.names], bool)
        self.blank_end = np.array([n.endswith(MARK) for n in self.names], bool)
        self.by_word = self.by_word and MARK in self.names
        self.end = _packed([self.names.index(MARK)]) if self.by_word else b""
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {MARK: self.end}
        self.chars = 0
        self.unequal: set[str] = set()
        self.altered: set[str] = set()

    def whole(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        ids = [e.ids for e in self.ours.encode_batch_fast(texts, add_special_tokens=False)]
        check = self.theirs.encode(texts, num_threads=self.threads)
        back = self.ours.decode_batch(ids, skip_special_tokens=False)
        for one, two, text in zip(ids, check, back):
            yield _packed(one), one == two, text == self.theirs.decode(two)

    def learn(self, groups: list[list[str]]) -> None:
        """Encode groups of new words, each group as one text; words start with the marker, so they stay apart."""
        bare = ["".join(g)[1:].replace(MARK, " ") for g in groups]
        encodings = self.ours.encode_batch_fast(bare, add_special_tokens=False)
        for group, text, one, check in zip(groups, bare, encodings, self.theirs.encode(bare, num_threads=self.threads)):
            own = one.ids
            alike = own == check
            ids = np.array(own, np.int32)
            begins = self.begins[ids]
            begins[1:] &= ~self.blank_end[ids[:-1]]
            first = np.append(np.flatnonzero(begins), len(ids))
            cuts, places = first.tolist(), np.append(0, np.cumsum(self.lengths[ids]))[first].tolist()
            packed, spelled = ids.tobytes(), "".join([self.names[i] for i in own])
            self.chars += len(text)
            for k, word in enumerate(group):
                at, end = cuts[k], cuts[k + 1]
                self.known[word] = packed[4 * at:4 * end]
                if not alike and own[at:end] != self.theirs.encode(word[1:].replace(MARK, " ")):
                    self.unequal.add(word)
                if spelled[places[k]:places[k + 1]] != word and self.ours.decode(own[at:end], skip_special_tokens=False) != word[1:].replace(MARK, " "):
                    self.altered.add(word)

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        if not self.by_word:
            yield from self.whole(texts)
            return
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        words = [re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*words).difference(self.known)
        blank = [w for w in new if not w.strip(MARK)]
        self.learn([[w] for w in blank])
        fresh = sorted(new.difference(blank))
        self.learn([fresh[k:k + TOGETHER] for k in range(0, len(fresh), TOGETHER)])
        for text, own in zip(texts, words):
            ids = b"".join(map(self.known.__getitem__, own))
            yield ids, self.unequal.isdisjoint(own), self.altered.isdisjoint(own) and MARK not in text


def encoded(docs: DataFrame, raw: bytes, threads: int = 2) -> DataFrame:
    """Per row: ``doc_id``, the token ids, how many are fallback bytes, and the two checks. ``raw`` is the model file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(raw, threads)
        fallback = np.zeros(len(coder.model.pieces) + 1, np.int64)
        fallback[[i for i, t in enumerate(coder.model.pieces) if t[2] == BYTE]] = 1
        for part in slices(batches, most=BATCH_BYTES):
            ids, parity, back = zip(*coder([t or "" for t in part.column("text").to_pylist()]))
            counts = np.array([len(x) // 4 for x in ids], np.int32)
            offsets, values = np.append(0, np.cumsum(counts)).astype(np.int32), np.frombuffer(b"".join(ids), np.int32)
            flat = pa.ListArray.from_arrays(offsets, values)
            sums = np.append(0, np.cumsum(fallback[values]))[offsets]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int32()), "ids": flat,
                "n_bytes": pa.array(np.diff(sums), pa.int32()), "parity": pa.array(parity), "round_trip": pa.array(back)})
        del coder  # the worker lives on, and the known words would stay in its memory
        release()

    return docs.select("doc_id", "text").mapInArrow(rows, ENCODED)


def decoded(tokens: DataFrame, raw: bytes) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = build(parse_model(raw))
        for batch in batches:
            texts = ours.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id bigint, text string")
