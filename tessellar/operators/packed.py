"""Several values packed in one field: split on inconsistent delimiters, with quoting.

The scan works on the raw Arrow string buffer of a whole batch, never on one cell at a time: byte masks find the
delimiters, quote marks and brackets, jump tables pair each opening quote with its closing one, a cumulative sum over
the paired marks says which bytes are protected, and what is left of the delimiter mask gives the child offsets of a
list array, which is then flattened with its parents' ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte classes of the cell grammar. For the masks alone, each multi-byte mark counts as one byte.
BLANK = b" \t\n\r\x0b\x0c"
HARD = b",;|\t\n\r"
SOFT = b"/-"
#: multi-byte marks and the single bytes that stand for them in the masks; values are cut from the cell as it is
FOLD = {"\u201c": 0x01, "\u201d": 0x02, "\u00ab": 0x03, "\u00bb": 0x04, "\u2018": 0x05, "\u2022": 0x06, "\u25aa": 0x06, "\u25e6": 0x06, "\u2023": 0x06, "\u00b7": 0x07, "\u201e": 0x08, "\u2013": 0x0E, "\u2014": 0x0F, "\u201a": 0x10, "\u2019": 0x19, "\uff1b": 0x3B, "\uff0c": 0x2C, "\u00a0": 0x20}
#: opening byte -> closing bytes; low marks open German quotes, which a high opening mark closes
QUOTES = {0x22: (0x22,), 0x27: (0x27,), 0x60: (0x60,), 0x01: (0x02,), 0x08: (0x01, 0x02), 0x03: (0x04,), 0x04: (0x03,), 0x05: (0x19,), 0x10: (0x05, 0x19)}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_BLANK, _HARD, _SOFT, _DIGIT = _table(BLANK), _table(HARD), _table(SOFT + b"\x0e\x0f\x07"), _table(b"0123456789")
_BULLET = _table(b"*\x06\x07-\x0e\x0f")
_CONTROL = np.arange(256) < 32
_CONTROL[np.frombuffer(BLANK, np.uint8)] = False


def _folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as the masks see them, and which of them count: of a multi-byte mark only the first. Control bytes of the
    text itself are ordinary characters."""
    out = np.where(_CONTROL[raw], np.uint8(0x78), raw)
    keep = np.ones(len(raw), bool)
    for mark, byte in FOLD.items():
        m = np.frombuffer(mark.encode(), np.uint8)
        if len(raw) >= len(m):
            at = raw[: len(raw) - len(m) + 1] == m[0]
            for i in range(1, len(m)):
                at &= raw[i : len(raw) - len(m) + 1 + i] == m[i]
            at = np.flatnonzero(at)
            out[at] = byte
            for i in range(1, len(m)):
                keep[at + i] = False
    return out, keep


def _next_at(mask: np.ndarray) -> np.ndarray:
    """For each place, the first place at or after it where the mask holds (the length where there is none)."""
    n = len(mask)
    at = np.where(mask, np.arange(n, dtype=np.int64), n)
    return np.minimum.accumulate(at[::-1])[::-1] if n else at


def _last_at(mask: np.ndarray) -> np.ndarray:
    """For each place, the last place at or before it where the mask holds (-1 where there is none)."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int64), -1)) if len(mask) else np.zeros(0, np.int64)


def _skip_left(b: np.ndarray, lo: np.ndarray, hi: np.ndarray, nonblank_next: np.ndarray) -> np.ndarray:
    return np.minimum(nonblank_next[np.minimum(lo, len(nonblank_next) - 1)], hi)


def split_batch(cells: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """Parents' ordinals of the flattened keywords, and the list array of keywords of each cell (an empty list for
    null, blank and separator-only cells)."""
    cells = cells.cast(pa.large_string()).fill_null("")
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    n = len(cells)
    off = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + n + 1] if n else np.zeros(1, np.int64)
    text = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    raw, kept = _folded(text)
    source = np.append(np.flatnonzero(kept), len(text))  # where a byte of the masks stands in the text
    off = np.concatenate(([0], np.cumsum(kept)))[off - off[0]]
    raw = raw[kept]
    # one separator byte behind every cell, so that no look-around crosses a cell
    size = len(raw) + n
    b = np.full(size, 0x0A, np.uint8)
    cell_of = np.repeat(np.arange(n), np.diff(off))
    b[np.arange(len(raw)) + cell_of] = raw
    start, end = off[:-1] + np.arange(n), off[1:] + np.arange(n)  # b[start:end] is a cell, b[end] its end mark
    if not size:
        return np.zeros(0, np.int64), pa.array([[]] * n, pa.list_(pa.string()))
    blank = _BLANK[b]
    nb_next, nb_last = _next_at(~blank), _last_at(~blank)
    first = np.minimum(nb_next[np.minimum(start, size - 1)], end)
    last = np.maximum(nb_last[np.maximum(end - 1, 0)], start - 1)
    # a list literal: [ ... ] around the whole cell
    full = first <= last
    literal = full & (last > first) & (b[np.minimum(first, size - 1)] == 0x5B) & (b[np.maximum(last, 0)] == 0x5D)
    b = b.copy()
    b[first[literal]] = 0x0A
    b[last[literal]] = 0x0A
    blank = _BLANK[b]
    prev, nxt = np.concatenate(([0x0A], b[:-1])), np.concatenate((b[1:], [0x0A]))
    # a stroke, dash or dot parts only with a blank on either side; a bullet also at the start of an entry
    hard = _HARD[b]
    soft = _SOFT[b] & _BLANK[prev] & _BLANK[nxt]
    sep = hard | soft | (b == 0x06)
    # escaped quotes: behind an odd run of backslashes
    slash = b == 0x5C
    run = np.arange(size) - _last_at(~slash)
    escaped = np.concatenate(([False], (run[:-1] % 2 == 1) & slash[:-1]))
    sep_or_edge = sep.copy()
    # entry starts: places whose last unskipped byte is a separator; numbering and bullets are skipped over
    skip = blank | _BULLET[b]
    number = _numbering(b, size)
    skip |= number
    opens_at = np.concatenate(([True], (sep_or_edge | skip)[:-1]))
    unskipped = _last_at(~skip | sep)
    before = np.concatenate(([-1], unskipped[:-1]))
    at_entry = opens_at & ((before < 0) | sep_or_edge[np.maximum(before, 0)])
    # entry ends: the next byte that isn't blank is a separator or the end of the cell
    after = np.concatenate((_next_at(~blank | hard)[1:], [size - 1]))
    at_close = sep_or_edge[np.minimum(after, size - 1)] | (b[np.minimum(after, size - 1)] == 0x5D) | hard[np.minimum(np.arange(size) + 1, size - 1)]
    cell_end = np.repeat(end, np.diff(np.concatenate((start, [size]))))
    opener, closer_of = np.zeros(size, bool), np.full(size, size, np.int64)
    for o, cs in QUOTES.items():
        is_o = (b == o) & at_entry & ~escaped
        is_c = np.isin(b, cs) & ~escaped & at_close
        if o == 0x22:  # a doubled quote inside quotes is an escaped one: it is no closing mark
            is_c &= ~_doubled(b, is_o)
        nc = np.concatenate((_next_at(is_c)[1:], [size]))
        good = is_o & (nc < cell_end)
        opener |= good
        closer_of = np.where(good, nc, closer_of)
    is_p = (b == 0x28) & ~number
    nc = np.concatenate((_next_at((b == 0x29) & ~number)[1:], [size]))
    good = is_p & (nc < cell_end)
    opener |= good
    closer_of = np.where(good, nc, closer_of)
    inside = np.zeros(size + 1, np.int32)
    nxt_open = _next_at(opener)
    live = nxt_open[np.minimum(start, size - 1)]
    stop = end
    keep = (start < end) & (live < stop)
    live, stop = live[keep], stop[keep]
    while len(live):  # a round takes the next protected span of every cell that has one
        c = closer_of[live]
        np.add.at(inside, live, 1)
        np.add.at(inside, c, -1)
        step = np.minimum(c + 1, size - 1)
        live = np.where(c + 1 < stop, nxt_open[step], size)
        keep = live < stop
        live, stop = live[keep], stop[keep]
    protected = np.cumsum(inside[:-1]) > 0
    cutting = sep & ~protected
    cutting[end] = True
    cut = np.flatnonzero(cutting)
    lo, hi = np.concatenate(([0], cut[:-1] + 1)), cut
    lo, hi = _trim(b, lo, hi)
    # numbering and bullets in front
    for _ in range(2):
        lead = (lo < hi) & (_BULLET[b[np.minimum(lo, size - 1)]] & _BLANK[b[np.minimum(lo + 1, size - 1)]] | number[np.minimum(lo, size - 1)] | (b[np.minimum(lo, size - 1)] == 0x06))
        free = _next_at(~(number | blank | _BULLET[b])) if lead.any() else None
        if free is None:
            break
        lo = np.where(lead, np.minimum(free[np.minimum(lo, size - 1)], hi), lo)
    lo, hi = _trim(b, lo, hi)
    # quotes around
    quote = np.zeros(len(lo), np.uint8)
    for o, cs in QUOTES.items():
        hit = (hi - lo >= 2) & (b[np.minimum(lo, size - 1)] == o) & np.isin(b[np.maximum(hi - 1, 0)], cs) & ~escaped[np.maximum(hi - 1, 0)]
        quote[hit] = o
        lo, hi = np.where(hit, lo + 1, lo), np.where(hit, hi - 1, hi)
    lo, hi = _trim(b, lo, hi)
    full = hi > lo
    parent = np.searchsorted(end, cut[full], side="left")
    values = _take(text, source[lo[full] - parent], source[hi[full] - parent], quote[full])
    counts = np.bincount(parent, minlength=n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return parent, pa.ListArray.from_arrays(offsets, values)


def _numbering(b: np.ndarray, size: int) -> np.ndarray:
    """Bytes of ``1.`` and ``(1)`` at the start of an entry, and of ``1)`` at the start of a line, before a blank."""
    digit = _DIGIT[b]
    out = np.zeros(size, bool)
    last_no = _last_at(~digit)
    ends = np.flatnonzero(((b == 0x2E) | (b == 0x29)) & _BLANK[np.concatenate((b[1:], [0x0A]))] & np.concatenate(([False], digit[:-1])))
    if not len(ends):
        return out
    head = last_no[ends - 1]
    width = ends - head - 1
    paren = (head >= 0) & (b[np.maximum(head, 0)] == 0x28) & (b[ends] == 0x29)
    first = np.where(paren, head, head + 1)
    nb = _last_at(~_BLANK[b] | _HARD[b])
    before = np.where(first > 0, nb[np.maximum(first - 1, 0)], -1)
    line = (before < 0) | (b[np.maximum(before, 0)] == 0x0A)
    ok = (width <= 3) & (line | _HARD[b[np.maximum(before, 0)]] & (paren | (b[ends] == 0x2E)))
    delta = np.zeros(size + 1, np.int32)
    np.add.at(delta, first[ok], 1)
    np.add.at(delta, ends[ok] + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _doubled(b: np.ndarray, opener: np.ndarray) -> np.ndarray:
    """Quote bytes of a doubled pair: by their parity in a run of quotes, not counting an opening one."""
    q = (b == 0x22) & ~opener
    run = np.arange(len(b)) - _last_at(~q)
    nxt = _next_at(~q)
    length = run + nxt - np.arange(len(b)) - 1
    # of a run of odd length the last byte closes; all others are pairs
    return q & (run <= length - (length % 2))


def _trim(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lo):
        return lo, hi
    blank = _BLANK[b]
    lo = np.minimum(_next_at(~blank)[np.minimum(lo, len(b) - 1)], hi)
    hi = np.maximum(np.where(hi > 0, _last_at(~blank)[np.maximum(hi - 1, 0)] + 1, 0), lo)
    return lo, hi


def _take(b: np.ndarray, lo: np.ndarray, hi: np.ndarray, quote: np.ndarray) -> pa.Array:
    """The byte ranges as strings, with escapes undone inside the quotes they belong to."""
    import pyarrow.compute as pc

    length = hi - lo
    offsets = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length) + np.repeat(lo, length)
    out = pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(b[at].tobytes())])
    quoted = pa.array(quote > 0)
    double = pc.replace_substring(out, '""', '"')
    out = pc.if_else(pa.array(quote == 0x22), double, out)
    bare = pc.replace_substring_regex(out, r"\\([\"'\\\x60])", r"\1")
    out = pc.if_else(quoted, bare, out)
    return out.cast(pa.string())


def split_packed(df: DataFrame, column: str, key: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row ``(key, pos, value)`` for each entry of ``column``, ``pos`` counting from 1 in the cell's order.

    Null, blank and separator-only cells give no row; repeated rows give their entries again; a null key is kept; other
    columns, whatever their names, are pruned before the scan; an empty table gives an empty result. A quote that is
    never closed is an ordinary character. Typographic bullets and spaces that part entries are not part of a value.
    """
    slim = df.select(F.col(key).alias("k"), F.col(column).alias("v")).filter(F.col("v").isNotNull())
    kind = slim.schema["k"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(pos, T.IntegerType(), False), T.StructField(value, T.StringType(), False)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, lists = split_batch(batch.column(1))
            ordinal = np.arange(len(parent)) - lists.offsets.to_numpy()[parent] + 1 if len(parent) else parent
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent)), pa.array(ordinal.astype(np.int32)), lists.flatten()], names=[key, pos, value])

    return slim.mapInArrow(scan, schema)
