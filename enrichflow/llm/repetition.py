"""Repetition rules from a suffix array over the words of each text.

The suffixes of a text are sorted by prefix doubling on word hashes, for all texts of a piece at once; words of different texts
are different symbols, so no repeat crosses texts. The length of the common prefix of neighbouring suffixes gives, for every
word, the longest repeat that starts there. Those of at least ``min_words`` words are the occurrences of maximal repeated
substrings; the union of their spans gives the covered fraction.

Null, empty and blank texts have no words, fail the base rule of 50 words and are covered by nothing. Memory is about 60 bytes
a word of a piece, and four bytes more per doubling of the longest repeat. Rows stay as they come: ties, copies and rows
without ``doc_id`` are judged one by one. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from enrichflow.llm.words import _SPACE, Words, mix, pieces

MIN_WORDS, MAX_COVERED, MAX_REPEAT = 10, 0.45, 50
RESULT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, covered_words bigint, covered_fraction double, longest_repeat bigint, "
          "n_repeats bigint")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_HEAD &= ~_SPACE


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... symbols of each suffix; the last list has no ties that matter.

    ``ends`` is where the text of each symbol ends. Symbols of different texts must differ.
    """
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(size, np.int32)
    group = np.append(True, symbols[order][1:] != symbols[order][:-1])
    ranks[order] = np.maximum.accumulate(np.where(group, np.arange(size), 0))
    levels, step = [ranks], 1
    while True:
        single = np.bincount(ranks, minlength=size)[ranks] == 1
        tied = np.flatnonzero(~single)
        if not len(tied):
            return levels
        after = np.where(tied + step < ends[tied], ranks[np.minimum(tied + step, size - 1)], -1)
        order = np.lexsort((after, ranks[tied]))
        tied, after, old = tied[order], after[order], ranks[tied][order]
        at = np.arange(len(tied))
        fresh = np.append(True, old[1:] != old[:-1])
        offset = at - np.maximum.accumulate(np.where(fresh, at, 0))
        split = fresh | np.append(True, after[1:] != after[:-1])
        ranks = ranks.copy()
        ranks[tied] = old + np.maximum.accumulate(np.where(split, at, 0)) - (at - offset)
        levels.append(ranks)
        step *= 2


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position the length of the longest run of symbols from there that also starts elsewhere in its text."""
    size = len(symbols)
    best = np.zeros(size, np.int64)
    if size < 2:
        return best
    levels = suffix_ranks(symbols, ends)
    order = np.argsort(levels[-1], kind="stable")
    same = levels[0][order[1:]] == levels[0][order[:-1]]
    one, two = order[:-1][same], order[1:][same]
    common = np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + common, two + common
        inside = (a < ends[one]) & (b < ends[two])
        ranks = levels[level]
        equal = inside & (ranks[np.minimum(a, size - 1)] == ranks[np.minimum(b, size - 1)])
        common += equal * np.int64(1 << level)
    np.maximum.at(best, one, common)
    np.maximum.at(best, two, common)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in one of the spans."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _copied_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    copies = 0
    for line in text.split(b"\n"):
        copies += line in seen and bool(line.strip())
        seen.add(line)
    return copies


def measured(words: Words, min_words: int) -> dict[str, np.ndarray]:
    """Counts of the texts of a piece."""
    hashes, text, size = words.hashes(), words.text_of, len(words.starts)
    own = mix(text.astype(np.uint64) + np.uint64(1))
    grams, at = words.grams(hashes, 3)
    _, back, times = np.unique(grams ^ own[at], return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    twice = covered(again, np.full(len(again), 3), size)
    lengths = longest_repeats(hashes ^ own, np.repeat(words.first[1:], words.counts))
    spans = np.flatnonzero(lengths >= min_words)
    cover = covered(spans, lengths[spans], size)
    longest = np.zeros(len(words.first) - 1, np.int64)
    np.maximum.at(longest, text[spans], lengths[spans])
    begins = np.append(True, lengths[1:] != lengths[:-1] - 1) if size else np.zeros(0, bool)
    return {
        "n_words": words.counts, "word_chars": _per_text(_HEAD[words.data], words.offsets),
        "n_symbols": _per_text(_SYMBOL[words.data], words.offsets),
        "n_dup_lines": np.array([_copied_lines(words.text(i)) for i in range(len(words.counts))], np.int64),
        "n_repeat_words": _per_text(twice, words.first), "covered_words": _per_text(cover, words.first),
        "longest_repeat": longest, "n_repeats": _per_text(begins & (lengths >= min_words), words.first)}


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per row the base counts, the repeats, and ``kept``: false if the base rule fails, if repeats of ``min_words`` words or
    more cover more than ``max_covered`` of the words, or if the longest has more than ``max_repeat`` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for part, words in pieces(batches):
            out = measured(words, min_words)
            n = out["n_words"]
            out["covered_fraction"] = out["covered_words"] / np.maximum(n, 1)
            out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
            out["kept"] = ~out["base_failed"] & (out["covered_fraction"] <= max_covered) & (out["longest_repeat"] <= max_repeat)
            out["doc_id"] = part.column("doc_id")
            yield pa.record_batch([pa.array(out[name]) for name in names], names=names)

    return docs.select("doc_id", "text").mapInArrow(rows, RESULT)
