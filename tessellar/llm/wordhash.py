"""Words and word n-grams of a whole Arrow batch as 64-bit hashes, without a loop over rows or words.

A word is a longest run of a-z and 0-9 after lower-casing. Its hash is a polynomial over its bytes, taken as the
difference of two prefix sums; all arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the ``n``-th."""
    return _powers(int(BASE), n), _powers(_inverse(int(BASE)), n)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the batch in order, and the ``len(texts) + 1`` offsets of the rows' words."""
    n = len(texts)
    low = pc.utf8_lower(texts.cast(pa.large_string())).fill_null("")
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    off = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[off[0] : off[-1]] if n and low.buffers()[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = _IS_WORD[raw]
    before = np.concatenate(([False], inside[:-1]))
    edge = off[1:-1][off[1:-1] < len(raw)]
    before[edge] = False  # a row ends a word
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    h = np.zeros(len(starts), np.uint64)
    if len(starts):
        up, down = prefix_powers(len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, off, side="left")


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``n`` words within a row, and the rows' offsets into them."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    new = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(new[-1]) - np.repeat(new[:-1], counts) + np.repeat(offsets[:-1], counts)
    g = np.zeros(len(at), np.uint64)
    for i in range(n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[at + i]
    return mix(g), new


def distinct(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(offsets) - 1))))
