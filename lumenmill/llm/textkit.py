"""Vectorised hashing of words and word sequences straight from Arrow buffers.

Words are runs of bytes outside [\\x20\\x09-\\x0D]. A word's 64-bit hash is a polynomial over
random byte values modulo 2**64, taken from prefix sums, so no Python loop touches a byte. Texts
are hashed in chunks cut at word starts: memory stays a small multiple of CHUNK plus eight bytes
a word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_M = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_M_INV = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and for each text the index of its first
    word (n + 1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = word[inner]  # a word never runs on into the next text
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words; lower takes A-Z as a-z."""
    out = np.empty(len(starts), dtype=np.uint64)
    values, first = _BYTE_LOWER if lower else _BYTE, 0
    pw = ipw = np.zeros(0, np.uint64)
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(starts, at + CHUNK)))
        last = min(last, len(starts))
        size = int(ends[last - 1] - at)
        if size > len(pw):
            pw, ipw = _powers(_M, size), _powers(_M_INV, size)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[data[at : at + size]] * pw[:size], out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[e] - sums[s]) * ipw[s] + (e - s).astype(np.uint64))
        first = last
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, across text borders too: the run that starts
    at word i is at i; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 6:
        acc = words[:n].copy()
        for j in range(1, k):
            acc *= np.uint64(_M)
            acc += words[j : n + j]
        return mix(acc)
    out, step = np.empty(n, dtype=np.uint64), 1 << 17
    pw, ipw = _powers(_M, min(step, n) + k), _powers(_M_INV, min(step, n))
    for a in range(0, n, step):
        b = min(n, a + step)
        sums = np.empty(b - a + k, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(words[a : b + k - 1] * pw[: b - a + k - 1], out=sums[1:])
        out[a:b] = mix((sums[k:] - sums[:-k]) * ipw[: b - a])
    return out


def hash_sequence(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole word sequence; firsts as from word_bounds."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F):
        n = len(words)
        pw, ipw = _powers(salt | 1, n + 1), _powers(pow(salt | 1, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(words + np.uint64(salt)) * pw[:n], out=sums[1:])
        a, b = firsts[:-1], firsts[1:]
        out.append(mix((sums[b] - sums[a]) * ipw[a] + (b - a).astype(np.uint64)))
    return out[0], out[1]


def blocks(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in slices of about `most` bytes of text at most, one row at least."""
    sizes = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark's long."""
    return x.view(np.int64)


def ragged(flat: pa.Array, firsts: np.ndarray) -> pa.Array:
    """A list column from its values and offsets."""
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), flat)
