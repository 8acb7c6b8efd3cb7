"""Words and word n-grams of many texts at once, as numpy arrays.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``, so texts are read as UTF-8 without decoding. Texts come in
Arrow batches; a batch is cut into pieces of a few megabytes, and a longer text is a piece of its own. A null text has no
words.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_HASH_BYTES = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE = 0x5B9D3C1F7A64E2D7
_WORD_BASE = 0x3C79AC492BA7B653


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when more are needed."""

    def __init__(self, base: int):
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = 1 << max(10, (count - 1).bit_length())
            self.up, self.down = _powers(self._base, size), _powers(self._inverse, size)
        return self.up[:count], self.down[:count]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of 64-bit values, from a start up to its end."""
    return mix(_range_hashes(mix(values), starts, ends, _WORDS) + (ends - starts).astype(np.uint64))


class Words:
    """Words of the texts of one Arrow column.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text ``i`` are ``first[i]`` to ``first[i + 1]``.
    ``apart`` marks the bytes between words.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False, apart: np.ndarray = _SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        count = len(column)
        self.offsets = np.zeros(1, np.int64) if not count else np.frombuffer(offsets, np.int64)[column.offset:column.offset + count + 1]
        begin, end = self.offsets[0], self.offsets[-1]
        self.data = np.frombuffer(data, np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
        self.offsets = self.offsets - begin
        if lower:
            self.data = _LOWER[self.data]
        space = apart[self.data]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        after = np.ones(len(space), bool)
        after[:-1] = space[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(space))]
        before[inner] = True
        after[inner - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of a byte range of each word, the same for equal bytes of any batch."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            until = max(at + 1, int(np.searchsorted(self.ends, begin + _HASH_BYTES, "right")))
            piece = self.data[begin:self.ends[until - 1]].astype(np.uint64) + np.uint64(1)
            out[at:until] = _range_hashes(piece, starts[at:until] - begin, ends[at:until] - begin, _BYTES)
            at = until
        return mix(out + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.ranges(self.starts, self.ends)

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``size`` words that lies in one text."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(hashes))
        at = np.flatnonzero(room >= size)
        return mix(_range_hashes(hashes, at, at + size, _WORDS) + np.uint64(size)), at

    def sequence(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of all words of each text; texts without words have the same."""
        counts = self.counts.astype(np.uint64)
        return mix(_range_hashes(hashes, self.first[:-1], self.first[1:], _WORDS) + counts)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one text each; freed memory is given back after each batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(at, until - at)
            at = until
        release()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False,
           most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """``slices`` of the batches with the words of their texts."""
    for part in slices(batches, column, most):
        yield part, Words(part.column(column), lower)
