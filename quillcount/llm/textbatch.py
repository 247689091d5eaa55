"""Vectorised words of a batch of texts: numpy over Arrow's string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Every word gets a
64-bit hash, a sum of random byte values times powers of an odd multiplier,
mixed at the end; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {}
#: Bytes of text that are worked on at once, unless a single text is longer.
CHUNK_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The first n or more powers of an odd number, modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(6, n.bit_length()), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base]


def range_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the ``length`` words from each ``start`` on; equal ranges have equal hashes anywhere.

    Differences of prefix sums of word hashes times powers, shifted to place 0 by the inverse power.
    """
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(len(words))[: len(words)], dtype=np.uint64)))
    return mix64((total[start + length] - total[start]) * powers(len(words) + 1, _INVERSE)[start] + length.astype(np.uint64))


@dataclass
class Words:
    """Words of some consecutive texts; ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray  # bytes of the texts, as they are
    start: np.ndarray  # byte where a word starts
    end: np.ndarray  # byte after it
    hash: np.ndarray  # uint64
    first: np.ndarray  # words before each text; one entry more than texts
    byte: np.ndarray  # bytes before each text; one entry more than texts


def _words(data: np.ndarray, byte: np.ndarray, lower: bool) -> Words:
    inside = ~_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = len(data) > 0 and inside[0]
    edge[-1] = False
    edge[1:-1] = inside[1:] & ~inside[:-1]
    cuts = byte[1:-1]
    cuts = cuts[cuts < len(data)]
    edge[cuts] = inside[cuts]  # a text's end ends its last word
    start = np.flatnonzero(edge)
    stop = np.empty(len(data) + 1, dtype=bool)
    stop[0] = False
    stop[-1] = len(data) > 0 and inside[-1]
    stop[1:-1] = inside[:-1] & ~inside[1:]
    cuts = cuts[cuts > 0]
    stop[cuts] = inside[cuts - 1]
    end = np.flatnonzero(stop)
    length = end - start
    if len(start):
        own = data[inside]
        if lower:
            own = _LOWER[own]
        before = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(len(own)) - np.repeat(before, length)
        value = _BYTE[own] * powers(int(length.max()))[place]
        hashes = mix64(np.add.reduceat(value, before) + length.astype(np.uint64))
    else:
        hashes = np.empty(0, dtype=np.uint64)
    return Words(data, start, end, hashes, np.searchsorted(start, byte), byte)


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False):
    """(first row, rows, Words) for parts of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        lo, hi = int(offsets[row]), int(offsets[stop])
        yield row, stop - row, _words(data[lo:hi], offsets[row : stop + 1] - lo, lower)
        row = stop


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words that start at each place but the last k - 1.

    Grams of powers of two come from pairs of shorter ones, so the passes grow with log k.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, at, part, size = None, 0, words, 1
    while True:
        if k & size:
            own = part[at : at + n]
            out = mix64(own + np.uint64(size)) if out is None else mix64(out * np.uint64(0xD6E8FEB86659FD93) + own + np.uint64(size))
            at += size
        if size * 2 > k:
            return out
        part = mix64(part[:-size] * np.uint64(0x9FB21C651E98DF25) + part[size:])
        size *= 2
