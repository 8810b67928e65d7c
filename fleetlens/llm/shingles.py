"""Word shingles of whole texts as 64-bit numbers, for batches of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fleetlens.llm.arrays import text_bytes

WIDTH = 5
ONE = np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODES = mixed(np.arange(256, dtype=np.uint64) + ONE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


STRETCH = 1 << 16       # bytes
POWERS, INVERSES = powers(BASE, STRETCH), powers(INVERSE, STRETCH)


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts with A-Z as a-z, where each word `[^\\x20\\x09-\\x0D]+` starts and
    stops in them, and the ends of the texts, counted in words."""
    data, ends = text_bytes(text)
    if not len(data):
        none = np.empty(0, np.int64)
        return data, none, none, np.zeros(len(ends), np.int64)
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][np.diff(ends) > 0]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[begins[1:] - 1] = solid[begins[1:] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, stops, np.searchsorted(starts, ends)


def hashes_of(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number per word: a polynomial over its bytes, from differences of running sums. These are
    held of STRETCH bytes at a time, or of one longer word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, begin + STRETCH, "right")))
        here = low[begin:stops[to - 1]]
        n = len(here)
        up, down = (POWERS, INVERSES) if n <= STRETCH else (powers(BASE, n), powers(INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[here] * up[:n], out=sums[1:])
        first = starts[at:to] - begin
        out[at:to] = (sums[stops[at:to] - begin] - sums[first]) * down[first]
        at = to
    return mixed(out ^ (stops - starts).astype(np.uint64))


def shingle_sets(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, and the ends by text. A text with
    fewer words than ``width`` has its whole sequence as one shingle, one without words none."""
    low, starts, stops, ends = words_of(text)
    words = hashes_of(low, starts, stops)
    run = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        run = run * BASE + words[i:len(words) - width + 1 + i] if len(run) else run
    run = mixed(run, width)
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(run[a:b - width + 1]))
        elif b > a:
            acc = np.zeros(1, np.uint64)
            for w in words[a:b]:
                acc = acc * BASE + w
            sets.append(mixed(acc, b - a))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return flat, np.append(0, np.cumsum(sizes))


def sums_by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of each row's values; 0 for empty rows."""
    sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return sums[ends[1:]] - sums[ends[:-1]]
