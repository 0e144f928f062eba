"""Vectorised word and shingle hashing on Arrow string buffers.

The kernel never builds a Python string per word: it works on the UTF-8 bytes of a whole Arrow column at once. Words are
the maximal runs ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; both rules are safe on raw UTF-8, because every byte of a
multi-byte character has its high bit set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into words at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 17

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the well-known MurmurHash3 constants)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, size=n, dtype=np.uint64) | _U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _table(11, 256)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_STEP = _table(13, 64)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(max(n, 1), _U(_BASE))]))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8, off[-1]) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] :], off - off[0]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``."""
    solid = np.empty(len(raw) + 2, np.bool_)
    solid[0] = solid[-1] = False
    np.logical_not((raw == 32) | ((raw >= 9) & (raw <= 13)), out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; the spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    lens = ends - starts
    total = int(lens.sum())
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(total) - np.repeat(first, lens)
    vals = _BYTE[raw[pos + np.repeat(starts, lens)]] * _powers(int(lens.max()))[pos]
    return _mix(np.add.reduceat(vals, first) + lens.astype(_U) * _U(0xD6E8FEB86659FD93))


def _chunks(off: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + (size or CHUNK_BYTES), "right")) - 1)
        yield a, b
        a = b


def hashed_words(col: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, hashes of the words, offsets of the rows in them) chunk by chunk.

    A row boundary always ends a word. ``size`` is the bytes of a chunk.
    """
    raw, off = text_buffers(col)
    for a, b in _chunks(off, size):
        part = np.full(int(off[b] - off[a]) + (b - a), 32, np.uint8)  # one blank after each row
        o = off[a : b + 1] - off[a]
        mark = np.ones(len(part), np.bool_)
        mark[o[1:] + np.arange(b - a)] = False
        part[mark] = raw[off[a] : off[b]]
        s, e = word_spans(part)
        yield a, b, hash_spans(part, s, e), np.searchsorted(s, o + np.arange(b - a + 1))


def shingles(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, and the rows' offsets; a shorter row with words is one run."""
    n = np.diff(off)
    out = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(out)])
    total = int(at[-1])
    if not total:
        return np.zeros(0, _U), at
    rows = np.repeat(np.arange(len(n)), out)
    start = np.arange(total) - at[rows] + off[rows]
    length = np.minimum(n[rows], k)
    padded = np.concatenate([words, np.zeros(k, _U)])
    acc = np.zeros(total, _U)
    for j in range(k):
        acc += np.where(j < length, padded[start + j], _U(0)) * _STEP[j % len(_STEP)]
    return _mix(acc + length.astype(_U)), at


def sorted_sets(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, and the rows' offsets."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, rows)) if len(off) > 2 else np.argsort(h)
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), np.bool_)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(len(off)))
