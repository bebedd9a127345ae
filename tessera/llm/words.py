"""Vectorised word splitting and hashing over the raw bytes of an Arrow string column.

Every word rule used here separates words by ASCII characters only, so a rule is a table of 256 flags over the
bytes of UTF-8: a byte of a longer character is never a separator. A word's hash is a polynomial over its bytes
modulo 2^64, read off two prefix sums; upper-case A-Z share the weight of a-z, which lower-cases for free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.common import process_cache

#: Odd multiplier of the polynomial and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; bounds the working memory whatever the length of a text.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_weights() -> np.ndarray:
    """A 64-bit weight for each byte; A-Z weigh as a-z."""
    weights = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    weights[65:91] = weights[97:123]
    return weights


def alnum_bytes() -> np.ndarray:
    """Flags of the bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    flags = np.zeros(256, dtype=bool)
    flags[0x30:0x3A] = flags[0x41:0x5B] = flags[0x61:0x7B] = flags[0x80:] = True
    return flags


def spaced_bytes() -> np.ndarray:
    """Flags of the bytes of words `[^\\x20\\x09-\\x0D]+`."""
    flags = np.ones(256, dtype=bool)
    flags[0x20] = flags[0x09:0x0E] = False
    return flags


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (one more than rows); nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words; a word never crosses the end of a row."""
    inside = flags[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from 0 to size."""
    out = np.full((2, size + 1), np.uint64(BASE))
    out[1] = np.uint64(BASE_INVERSE)
    out[:, 0] = 1
    powers, inverse = np.multiply.accumulate(out, axis=1)
    return powers, inverse


def cached_power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return process_cache(("powers", size), lambda: power_table(size))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for words that differ in the case of A-Z only."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    weights, n, i = byte_weights(), len(starts), 0
    size = max(CHUNK, int((ends - starts).max()))
    powers, inverse = (power_table if size > CHUNK else cached_power_table)(size)
    while i < n:
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + size, "right")), i + 1)
        part = data[base : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(weights[part] * powers[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def row_words(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each row's first word (one more than rows)."""
    return np.searchsorted(starts, offsets, "left")


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, whatever rows they cross."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(k):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their bounds: a row of fewer words has its whole sequence as
    one shingle, a row without words none. Repeats are kept."""
    counts = np.diff(bounds)
    full = grams(hashes, k)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(sizes)))
    rows = np.repeat(np.arange(len(counts)), sizes)
    within = np.arange(out_bounds[-1]) - out_bounds[rows]
    at = bounds[rows] + within
    out = full[np.minimum(at, max(len(full) - 1, 0))] if len(full) else np.zeros(len(at), np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        part = hashes[bounds[r] : bounds[r + 1]]
        out[out_bounds[r]] = grams(part, len(part))[0] ^ np.uint64(len(part))
    return out, out_bounds
