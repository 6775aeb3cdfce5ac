"""Vectorised hashing of words, byte strings and runs of them over whole Arrow text columns.

Texts are read as UTF-8 bytes straight from the Arrow buffer and handled in slabs
of about half a megabyte (one text at least), so memory does not grow with a batch. A
word's hash is a sum over its bytes, each mixed with its place in the word; that of
a short run is a polynomial over 64-bit values, modulo 2**64. Both are taken from
prefix sums and finished by a bit mixer; equal strings hash alike in any slab.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[:128] = [not chr(c).isalnum() for c in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place where it can be."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", _P), ("down", _P_INV)):
                line = np.full(size, base, dtype=np.uint64)
                line[0] = 1
                setattr(cls, name, np.multiply.accumulate(line))
        return cls.up, cls.down


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours of a uint64 array, a slab's worth at a time."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, dtype=np.uint64)
    for lo in range(0, n, SLAB):
        hi = min(n, lo + SLAB)
        part = values[lo : hi + width - 1]
        up, down = _Powers.to(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[lo:hi] = mix((sums[width:] - sums[: hi - lo]) * down[: hi - lo])
    return out


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` for many short spans, lengths included."""
    up, down = _Powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each run of ``width`` neighbours by the upper 32 bits; of equals the rightmost."""
    low = np.uint64(0xFFFFFFFF)
    least = (values & ~low) | (low - np.arange(len(values), dtype=np.uint64))
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[step:], least[: len(least) - step])
        span += step
    return (low - (least & low)).astype(np.int64)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _BYTES[data]


@dataclass
class Slab:
    """Neighbouring texts: their bytes and where each begins; ``first`` is the first one's row."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, lower: bool, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and for each text where its words begin (one more entry than texts).

        Words are cut at ASCII blanks or, if ``plain``, at whatever in ASCII is neither letter nor digit.
        """
        starts, ends = self.word_spans(plain)
        data = _LOWER[self.data] if lower else self.data
        return hash_spans(data, starts, ends), np.searchsorted(starts, self.offsets)

    def word_spans(self, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end in ``data``."""
        n = len(self.data)
        if not n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        inside = ~(_MARKS if plain else _BLANK)[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = True, ~inside[:-1]
        starts = np.flatnonzero(inside & (before | cut[:n]))
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = True, ~inside[1:]
        ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        return starts, ends


def place_sums(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of a hash of each byte and its distance from the last of ``starts``.

    The difference of two of them is a hash of the string between, the same wherever
    it stands; each byte is mixed with its place, so that no structure of a string
    makes parts of the sum cancel out.
    """
    since = np.zeros(len(data), dtype=np.int64)
    since[starts] = starts
    np.maximum.accumulate(since, out=since)
    place = (np.arange(len(data)) - since).astype(np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(_BYTES[data] + place * _P), out=sums[1:])
    return sums


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
    """Hashes of ordered byte spans, a slab's worth of bytes at a time.

    With ``lengths``, a list: of the spans, and for each length of the beginnings of
    those that are longer.
    """
    hashes = np.empty(len(starts), dtype=np.uint64)
    short: list[list[np.ndarray]] = [[] for _ in lengths]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLAB)))
        base, stop = starts[lo], ends[hi - 1]
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        if hi == lo + 1 and stop - base > SLAB:
            hashes[lo] = _long_hash(data[base:stop])
            for k, out in zip(lengths, short, strict=True):
                out.append(hash_spans(data[base : base + k], np.array([0]), np.array([k])) + np.uint64(k))
        else:
            sums = place_sums(data[base:stop], a)
            hashes[lo:hi] = mix(sums[b] - sums[a] + (b - a).astype(np.uint64))
            for k, out in zip(lengths, short, strict=True):
                at = a[b - a > k]
                out.append(mix(sums[at + k] - sums[at] + np.uint64(k)) + np.uint64(k))
        lo = hi
    return [hashes, *(np.concatenate([np.empty(0, dtype=np.uint64), *out]) for out in short)] if lengths else hashes


def _long_hash(word: np.ndarray) -> np.uint64:
    """The same hash of one word that is longer than a slab."""
    total = np.zeros(1, dtype=np.uint64)
    for lo in range(0, len(word), SLAB):
        part = word[lo : lo + SLAB]
        total += mix(_BYTES[part] + np.arange(lo, lo + len(part)).astype(np.uint64) * _P).sum(dtype=np.uint64)
    return mix(total + np.uint64(len(word)))[0]


def hand_back() -> None:
    """Return freed memory of this process to the system: workers are used again and again, for one operator after another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """A function over batches that hands memory back when its partition is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            hand_back()

    return run


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[Slab]:
    """The texts of an Arrow string array, null as empty, in slabs."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1))
        yield Slab(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owners(begins: np.ndarray, n: int) -> np.ndarray:
    """For items dealt to texts by ``begins`` (one more entry than texts): each item's text."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins)) if n else np.empty(0, dtype=np.int64)
