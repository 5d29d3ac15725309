"""Whole-batch word tokenisation and hashing with numpy.

A word is a run of bytes other than space and TAB..CR (0x09-0x0D). All helpers work on
the UTF-8 bytes of an Arrow string column, so a batch of documents becomes a few flat
arrays: word starts and ends, the words of each document, and one 64-bit hash a word.
Hashes depend on the bytes alone, so every task of every run gives the same ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64
_BYTE_SEED, _BASE, _STEP = 20240229, U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def _separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SEPARATOR = _separators()


@functools.cache
def _byte_codes(lower: bool) -> np.ndarray:
    codes = np.random.default_rng(_BYTE_SEED).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
    codes = (codes << U64(1)) | U64(1)
    if lower:
        codes[ord("A"):ord("Z") + 1] = codes[ord("a"):ord("z") + 1]
    codes[SEPARATOR] = 0
    return codes


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: U64, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1) modulo 2 ** 64 (tables grow by doubling)."""
    return _powers(int(base), 1 << max(10, (size - 1).bit_length()))[:size]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most about ``most`` bytes: (first row, end row, bytes, bounds)."""
    data, bounds = text_bytes(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, end, data[bounds[first]:bounds[end]], bounds[first:end + 1] - bounds[first]
        first = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's range of words (length rows + 1)."""
    inside = ~SEPARATOR[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(inside):
        before[0] = after[-1] = False
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, U64)
    values = _byte_codes(lower)[data[starts[0]:]]
    size = np.diff(np.append(starts, len(data)))
    offset = np.arange(len(values), dtype=np.int64) - np.repeat(starts - starts[0], size)
    values *= powers(_BASE, int(size.max()))[offset]
    return mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(U64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (rows not minded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out += hashes[j:j + n]
        return mix(out)
    up = powers(_STEP, len(hashes))
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up, out=total[1:])
    down = powers(U64(pow(int(_STEP), -1, 1 << 64)), n)
    return mix((total[k:] - total[:-k]) * down)


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` consecutive entries."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def row_of(ranges: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's range of words."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def shingles(hashes: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words and the row of each; a row of 1 to k - 1 words has one of all its words."""
    counts = np.diff(ranges)
    grams, row = gram_hashes(hashes, k), row_of(ranges)
    whole = (np.arange(len(grams)) + k <= ranges[1:][row[:len(grams)]]) if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    out, of = grams[whole], row[:len(grams)][whole]
    if len(short):
        extra = np.array([gram_hashes(hashes[ranges[r]:ranges[r + 1]], int(counts[r]))[0] + U64(counts[r]) for r in short], U64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
