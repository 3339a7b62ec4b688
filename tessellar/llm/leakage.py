"""Held-out test passages inside a corpus: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is a seed: an edited copy keeps some of them, and which ones can't be told from the item or from
counts. A document that holds a seed is aligned with the item around the seed's diagonal.

Where only runs of ``run`` consecutive words are asked for, fewer seeds do: such a run holds all n-grams of one window of
the item, so the one that the corpus holds least often is taken from each window. No such run is missed, and common phrases
are avoided where anything rarer stands beside them.

The items are the small side. Their words come to the driver in blocks of bounded size, and each block meets the whole
corpus: the number of passes, not the memory, grows with the items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.wordhash import distinct, ngrams, word_hashes


@dataclass(frozen=True)
class Align:
    seed_words: int = 5
    run: int = 10
    match: int = 2
    mismatch: int = -2
    gap: int = -2
    #: matches' score on the seed's own diagonal below which no full alignment is made
    least_score: int = 12
    #: characters of items that meet the corpus at once
    block_chars: int = 20_000_000
    #: only pairs with a run of ``run`` words are asked for, so one seed a window of that many words is enough
    runs_only: bool = False


@dataclass
class Items:
    """A block of items with their words' hashes, and the seeds as sorted hashes with the places they stand at."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # distinct n-gram hashes, ascending
    seeds: np.ndarray
    places: dict[int, list[tuple[int, int]]]


def smith_waterman(a: np.ndarray, b: np.ndarray, cfg: Align) -> tuple[int, int, int, int]:
    """Best local score with linear gaps of words ``a`` against ``b``, the longest common run of words, and the first and
    last place in ``a`` of that run."""
    idx = np.arange(len(b) + 1) * -cfg.gap
    h, run = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    best = longest = last = 0
    for i, x in enumerate(a):
        eq = b == x
        step = np.zeros(len(b) + 1, np.int64)
        step[1:] = np.maximum(h[:-1] + np.where(eq, cfg.match, cfg.mismatch), h[1:] + cfg.gap)
        np.maximum(step, 0, out=step)
        h = np.maximum.accumulate(step + idx) - idx
        run[1:] = np.where(eq, run[:-1] + 1, 0)
        best = max(best, int(h.max()))
        if (m := int(run.max())) > longest:
            longest, last = m, i
    return best, longest, last - longest + 1, last


def _read_block(rows: list, cfg: Align) -> Items:
    texts = pa.array([r[1] for r in rows], pa.string())
    h, o = word_hashes(texts)
    words = [h[o[i] : o[i + 1]] for i in range(len(rows))]
    g, _ = ngrams(h, o, cfg.seed_words)
    return Items([r[0] for r in rows], words, np.unique(g), np.zeros(0, np.uint64), {})


def _corpus_counts(docs: DataFrame, grams: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each of the n-grams stands."""
    held = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            g, o = ngrams(*word_hashes(b.column(1)), n)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = known[at] == g
            row = np.repeat(np.arange(len(o) - 1), np.diff(o))[hit]
            pairs = np.unique(row * len(known) + at[hit]) % len(known)
            total += np.bincount(pairs, minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["g", "c"])

    out = np.zeros(len(grams), np.int64)
    for r in docs.mapInArrow(scan, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")).collect():  # a row a gram of the block
        out[r["g"]] = r["c"]
    return out


def _choose_seeds(block: Items, counts: np.ndarray | None, cfg: Align) -> None:
    """Every n-gram of the items is a seed; with ``counts``, the rarest of each window."""
    width = cfg.run - cfg.seed_words + 1
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, w in enumerate(block.words):
        if len(w) < cfg.seed_words:
            continue
        g, _ = ngrams(w, np.array([0, len(w)]), cfg.seed_words)
        if counts is None:
            picked = set(range(len(g)))
        else:
            rarity = counts[np.searchsorted(block.grams, g)]
            order = np.lexsort((g, rarity)).argsort()  # rank by rarity, then by hash
            picked = {int(s + np.argmin(order[s : s + width])) for s in range(max(1, len(g) - width + 1))}
        for p in picked:
            places[int(g[p])].append((i, p))
    block.places = dict(places)
    block.seeds = np.array(sorted(places), np.uint64)


def _diagonal_score(d: np.ndarray, w: np.ndarray, shift: int, cfg: Align) -> int:
    """The best ungapped local score with ``d[shift + q]`` against ``w[q]``."""
    lo, hi = max(0, -shift), min(len(w), len(d) - shift)
    s = np.concatenate(([0], np.cumsum(np.where(d[shift + lo : shift + hi] == w[lo:hi], cfg.match, cfg.mismatch))))
    return int((s - np.minimum.accumulate(s)).max())


def leaks(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", cfg: Align | None = None) -> DataFrame:
    """``(key, item, score, share, run, at)`` of each document and item it holds a passage of.

    ``score`` is the best local alignment score, ``share`` that score as a part of the item's own, ``run`` the longest run
    of consecutive words both have, and ``at`` the word of the document at which it begins. Null texts and texts under a
    seed's words hold and are nothing; null ids never leak; rows that repeat count once; empty tables give no row.
    """
    cfg = cfg or Align()
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    b = bench.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    chars = b.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // cfg.block_chars))
    kinds = d.schema["k"].dataType.simpleString(), b.schema["i"].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, score int, share double, run int, at int"
    out = None
    for x in range(blocks):
        rows = b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == x).orderBy("i", "t").collect()
        block = _read_block(rows, cfg)
        if len(block.grams):
            _choose_seeds(block, _corpus_counts(d, block.grams, cfg.seed_words) if cfg.runs_only else None, cfg)
            part = d.mapInArrow(_aligner(d.sparkSession.sparkContext.broadcast(block), cfg, key, item, (d.schema["k"].dataType, b.schema["i"].dataType)), schema)
            out = part if out is None else out.unionAll(part)
    if out is None:
        return d.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("run", "score", "share", (-F.col("at")).alias("at"))).alias("m")
    return out.groupBy(key, item).agg(best).select(key, item, "m.score", "m.share", "m.run", (-F.col("m.at")).alias("at"))


def _aligner(held, cfg: Align, key: str, item: str, kinds: tuple):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = held.value
        for b in batches:
            h, o = word_hashes(b.column(1))
            g, go = ngrams(h, o, cfg.seed_words)
            at = np.minimum(np.searchsorted(block.seeds, g), len(block.seeds) - 1)
            hits = np.flatnonzero(block.seeds[at] == g)
            rows = np.searchsorted(go, hits, side="right") - 1
            spans: dict[tuple[int, int], set[int]] = defaultdict(set)
            for r, p in zip(rows.tolist(), hits.tolist(), strict=True):
                for i, q in block.places[int(g[p])]:
                    spans[r, i].add(p - int(go[r]) - q)
            keys: list[int] = []
            out: list[tuple] = []
            for (r, i), shifts in spans.items():
                doc, w = h[o[r] : o[r + 1]], block.words[i]
                shifts = sorted(s for s in shifts if _diagonal_score(doc, w, s, cfg) >= cfg.least_score)
                pad = len(w) // 4 + cfg.run
                best = None
                while shifts:  # diagonals whose windows overlap are one window
                    lo, hi = shifts[0] - pad, shifts[0] + len(w) + pad
                    while shifts and shifts[0] - pad <= hi:
                        hi = shifts.pop(0) + len(w) + pad
                    lo, hi = max(0, lo), min(len(doc), hi)
                    score, run, first, _ = smith_waterman(doc[lo:hi], w, cfg)
                    best = max(best or (-1,), (run, score, -(lo + first)))
                if best:
                    keys.append(r)
                    out.append((block.ids[i], best[1], best[1] / (cfg.match * len(w)), best[0], -best[2]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            names = [key, item, "score", "share", "run", "at"]
            types = [pa.from_numpy_dtype(np.int64) if kinds[1].simpleString() == "bigint" else None, pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, t) if t else pa.array(c) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *arrays], names=names)

    return scan


def found(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents and items that share a run of at least ten words."""
    cfg = Align(runs_only=True)
    return leaks(docs, bench, cfg=cfg).filter(F.col("run") >= cfg.run).select("doc_id", "item_id")


FOUND_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
     x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
     y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)
"""
