"""Vectorised fingerprints over the bytes and words of many texts at once.

Every function works on one flat byte array holding the texts of a block end
to end, so its cost is a few numpy passes per byte, whatever the number of
texts. A substring's fingerprint is read off a prefix polynomial modulo 2**64
(random byte codes, odd base), then scrambled; equal strings get equal
fingerprints wherever they stand. Modulo 2**64 the Thue-Morse word and its
complement come close with any odd base: of 2**k letters, they cost a lane
about k * k / 2 + k bits, in both lanes alike. So the polynomial is for short
runs: strings of a fixed width, words of up to `LONG_WORD` bytes (5 steps, 19
bits), windows of words. Longer words are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401, pa.compute

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_CODES = [np.random.default_rng(1000 + lane).integers(1, 2**63, 256, dtype=np.uint64) for lane in range(2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP, _KEPT = 1 << 18, 5 << 18

#: Bytes of a word beyond which it is not left to the polynomial.
LONG_WORD = 32
#: The separators of a word, `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    t = y >> U64(27)
    y ^= t
    y *= U64(0x94D049BB133111EB)
    t = y >> U64(31)
    y ^= t
    return y


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the lane's base, and of its inverse; kept while they are few."""
    held = _POWERS.get(lane)
    if held is None or len(held[0]) < n:
        base, size = _BASES[lane], -(-n // _STEP) * _STEP
        held = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (base, pow(base, -1, 2**64)))
        if size <= _KEPT:
            _POWERS[lane] = held
    return held[0][:n], held[1][:n]


class Prefix:
    """Fingerprints of any run of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, lane: int = 0):
        self.lane = lane
        up, self.down = _powers(len(codes) + 1, lane)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.multiply(codes, up[: len(codes)], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    @classmethod
    def of_bytes(cls, data: np.ndarray, lane: int = 0) -> Prefix:
        return cls(_CODES[lane][data], lane)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the run [start, end); the length takes part."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def sliding(self, width: int) -> np.ndarray:
        """Of each run of `width`, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + U64(width))


def sliced(batch: pa.RecordBatch, column: str | int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `size` bytes of text, or one text: memory is bounded whatever the batch."""
    lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)) if batch.num_rows else np.zeros(0)
    part = (np.cumsum(lengths + 16) // size).astype(int)
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield batch.slice(int(at[0]), len(at))


class Texts:
    """The texts of an Arrow string column, null as empty, as one byte array with offsets."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.data = _LOWER[data] if lower else data
        self.n = n

    def words(self) -> Words:
        return Words(self)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


class Words:
    """Words of all texts in order: byte range, and the range of words of each text."""

    def __init__(self, texts: Texts):
        inside = ~SPACE[texts.data]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = np.unique(texts.off)
            begin, stop = edge[edge < n], edge[edge > 0] - 1
            first[begin] = inside[begin]
            last[stop] = inside[stop]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Words of text i: [off[i], off[i + 1]).
        self.off = np.searchsorted(self.start, texts.off)
        self.texts = texts

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A fingerprint a word. Long words by BLAKE2b: long strings of one kind defeat any odd base modulo 2**64."""
        out = Prefix.of_bytes(self.texts.data, lane).of(self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG_WORD):
            word = self.texts.data[self.start[k] : self.end[k]]
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=16).digest()[8 * lane : 8 * lane + 8], "little")
        return out

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), np.diff(self.off))

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.off[1:], np.diff(self.off)) - np.arange(len(self.start))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    if not len(start):
        return np.zeros(n, bool)
    delta = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(delta[:-1]) > 0
