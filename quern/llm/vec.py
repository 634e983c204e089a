"""Whole-batch text primitives on Arrow buffers: no Python object per word or document.

All functions work on slices of an Arrow batch of about ``SLICE`` bytes, so that the arrays, eight
times as large as the text, stay in the processor's cache and out of the memory budget. One longer
text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters to lower case; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if "p" not in _pow or len(_pow["p"]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        for k, base in (("p", _P), ("q", _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["q"][:n]


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    if col.null_count:  # a null row may own bytes
        valid = np.asarray(col.is_valid())
        if (np.diff(off)[~valid] > 0).any():
            col = col.fill_null("")
            off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


#: ASCII letters and the bytes of all other scripts.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes of a kind, such as other than ASCII white space; a row ends its last word."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] the weighted sum of values[i:j]; for :func:`spans`."""
    p, _ = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=s[1:])
    return s


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal runs have equal hashes."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(prefix_sums(buf), start, end)


def codepoints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice as code points, and the rows' offsets in them."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[off]
