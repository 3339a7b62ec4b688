"""BM25 and TF-IDF of many queries over many documents: blocks of postings in files, whole-number scores that leave few
documents, and exact scores of these alone."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.session import _written, checkpoint_dir, cut

#: documents of a block; queries that a task holds at a time
BLOCK, HELD = 65_536, 2_048
#: postings of a term as a share of the block from which they are held as a full row
FULL = 0.04
#: share of the n-th best score so far from which documents are kept
SLACK = 0.93
ONE, LOWER, SIGNED, EIGHT = np.int32(1), np.int32(0xFFFF), np.int32(0x7FFFFFFF), np.arange(8)
DOCS, WORDS = "\x01docs", "\x01words"


def _numpy(x) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.to_numpy(zero_copy_only=False)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of all runs, one behind the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line)``: the words of a text parted by blanks, none for null."""
    return docs.select(key, F.array_join(T.words(F.col(text)), " ").alias("line"))


class Phrases:
    """Phrases as paths of word numbers; ``at`` finds them in rows of words."""

    def __init__(self, phrases: list[str]):
        self.names = phrases
        self.words = pa.array(sorted({w for p in phrases for w in p.split(" ")}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        steps, self.ends = {}, {}
        nodes = len(number)  # the first word is its own node
        for k, p in enumerate(phrases):
            first, *rest = (number[w] for w in p.split(" "))
            node = first
            for w in rest:
                if (node, w) not in steps:
                    steps[node, w], nodes = nodes, nodes + 1
                node = steps[node, w]
            self.ends[node] = k
        size = max(1, len(number))
        order = sorted((a * size + b, to) for (a, b), to in steps.items())
        self.keys, self.to = (np.array(x, np.int64) for x in (zip(*order, strict=True) if order else ((), ())))
        self.end = np.full(nodes + 1, -1)
        self.end[list(self.ends)] = list(self.ends.values())

    def at(self, names: pa.Array, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(document, phrase)``, once each; ``code`` are numbers of ``names``."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = _numpy(pc.index_in(names, self.words).fill_null(-1)).astype(np.int64)[code]
        pos = np.flatnonzero(word >= 0)
        node, found = word[pos], []
        step = 1
        while len(pos):
            there = pos + step < len(word)
            pos, node = pos[there], node[there]
            there = (word[pos + step] >= 0) & (doc[pos + step] == doc[pos])
            pos, node = pos[there], node[there]
            want = node * len(self.words) + word[pos + step]
            i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[i] == want
            pos, node = pos[there], self.to[i[there]]
            end = self.end[node]
            found.append(doc[pos[end >= 0]] * len(self.names) + end[end >= 0])
            step += 1
        hit = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return hit // len(self.names), hit % len(self.names)


def _read(line: pa.Array):
    """Of a batch: words, number of each word in its documents' order, its document, and which of these are terms."""
    split = pc.split_pattern(line, " ")
    doc = np.repeat(np.arange(len(line), dtype=np.int64), _numpy(pc.list_value_length(split)))
    flat = pc.list_flatten(split).dictionary_encode()
    names, code = flat.dictionary, _numpy(flat.indices).astype(np.int64)
    good = _numpy(pc.and_(pc.greater(pc.utf8_length(names), 1), pc.invert(pc.is_in(names, pa.array(T.STOP)))))
    return names, code, doc, good[code] if len(code) else np.zeros(0, bool)


def _pairs(code: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, pair, times)`` of neighbouring terms; a pair is ``first * size + second``."""
    same = doc[1:] == doc[:-1]
    x, tf = np.unique((doc[1:][same] * size + code[:-1][same]) * size + code[1:][same], return_counts=True)
    return x // (size * size), x % (size * size), tf


def frequencies(line: DataFrame, phrases: Phrases) -> DataFrame:
    """``(term, df)`` of words, of neighbouring terms ``a b`` and of phrases ``a_b``, with the numbers of documents and of
    terms in all under two names of their own."""
    ph = line.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches):
        docs = words = 0
        for b in batches:
            names, code, doc, term = _read(b.column(0))
            size = max(1, len(names))
            c, d = code[term], doc[term]
            docs, words = docs + b.num_rows, words + len(c)
            one = np.bincount(np.unique(d * size + c) % size, minlength=size)
            used = np.flatnonzero(one)
            pair, two = np.unique(_pairs(c, d, size)[1], return_counts=True)
            hit, three = np.unique(ph.value.at(names, code, doc)[1], return_counts=True)
            both = pc.binary_join_element_wise(names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), " ")
            told = pa.array([ph.value.names[i].replace(" ", "_") for i in hit], pa.string())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(used)), both, told]), pa.array(np.concatenate((one[used], two, three)), pa.int64())], names=["term", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([DOCS, WORDS]), pa.array([docs, words], pa.int64())], names=["term", "df"])

    return line.select("line").mapInArrow(scan, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Weights:
    """What documents and queries are weighed by: frequencies of all terms, and the numbers of the terms asked for."""

    def __init__(self, freq: DataFrame, asked: DataFrame, k1: float, b: float, floor: float, max_df: float):
        self.k1, self.b = k1, b
        own = freq.filter(~F.contains("term", F.lit(" "))).toArrow().to_pydict()  # words, phrases
        own = dict(zip(own["term"], own["df"], strict=True))
        self.n, total = own.pop(DOCS), own.pop(WORDS)
        self.avgdl = total / self.n if self.n else 0.0
        raw = {t: math.log(self.n - df + 0.5) - math.log(df + 0.5) for t, df in own.items()}
        self.mean = sum(raw.values()) / max(1, len(raw))
        words = {t: df for t, df in own.items() if "_" not in t}
        # pairs seen once need no place
        many = freq.filter(F.contains("term", F.lit(" ")) & (F.col("df") > 1)).toArrow().combine_chunks()
        self.words = pa.array(list(words), pa.string())
        idf = lambda df: np.where(df <= max_df * self.n, np.log((1 + self.n) / (1 + df)) + 1, 0.0)
        self.once = float(idf(np.array([1]))[0])
        self.idf = idf(np.array(list(words.values()), float))
        self.pairs, order = self.numbered_pairs(many["term"])
        self.pair_idf = idf(_numpy(many["df"]).astype(float))[order]
        a = asked.join(freq, "term").toArrow().combine_chunks()
        self.terms = pa.array(a["term"].to_pylist(), pa.string())
        df, kind = _numpy(a["df"]).astype(float), [" " in t for t in self.terms.to_pylist()]
        self.bm = np.array([0.0 if two else (floor * self.mean if raw[t] < 0 else raw[t]) for t, two in zip(self.terms.to_pylist(), kind, strict=True)])
        self.tf = np.where(["_" in t for t in self.terms.to_pylist()], 0.0, idf(df)) if len(df) else df
        number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        self.inner = {i: [number[x] for x in t.split("_") if x in number] for t, i in number.items() if "_" in t}
        # numbers of asked words, pairs and phrases
        self.of_word = _numpy(pc.index_in(self.words, self.terms).fill_null(-1)).astype(np.int64)
        at = np.flatnonzero(kind)
        self.asked_pairs, order = self.numbered_pairs(self.terms.take(pa.array(at)))
        self.of_pair = at[order]

    def numbered_pairs(self, terms) -> tuple[np.ndarray, np.ndarray]:
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        both = _numpy(pc.index_in(pc.list_flatten(pc.split_pattern(terms, " ")), self.words)).astype(np.int64).reshape(-1, 2)
        keys = both[:, 0] * len(self.words) + both[:, 1]
        order = np.argsort(keys)
        return keys[order], order


def _found(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in sorted ``keys``, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, i, -1)


_FIELDS = (("length", np.float64), ("norm", np.float64), ("row", np.int64), ("term", np.int32), ("tf", np.int32), ("start", np.int64), ("doc", np.uint16), ("times", np.int32))


def index(line: DataFrame, key: str, weights, phrases, folder: str, block: int = BLOCK) -> DataFrame:
    """``(path, sizes, keys)`` of the blocks' files, which hold lengths, norms, and the asked terms of each document and the
    documents of each."""
    kind = line.schema[key].dataType.simpleString()

    def scan(batches):
        w, ph = weights.value, phrases.value
        phrase = _numpy(pc.index_in(pa.array([p.replace(" ", "_") for p in ph.names], pa.string()), w.terms).fill_null(-1)).astype(np.int64)
        kept = []
        for b in batches:
            names, code, doc, term = _read(b.column(1))
            m, size = b.num_rows, max(1, len(w.words))
            known = _numpy(pc.index_in(names, w.words).fill_null(-1)).astype(np.int64)
            c, d = known[code[term]], doc[term]
            length = np.bincount(d, minlength=m)
            x, tf = np.unique(d * size + c, return_counts=True)
            d1, c1 = x // size, x % size
            norm = np.bincount(d1, (tf * w.idf[c1]) ** 2, m)
            d2, c2, tf2 = _pairs(c, d, size)
            u, back = np.unique(c2, return_inverse=True)
            at = _found(w.pairs, u)
            norm += np.bincount(d2, (tf2 * np.where(at >= 0, w.pair_idf[at] if len(w.pairs) else w.once, w.once)[back]) ** 2, m)
            a1, a2 = w.of_word[c1], _found(w.asked_pairs, u)[back]
            d3, p3 = ph.at(names, code, doc)
            a3 = phrase[p3]
            s1, s2, s3 = a1 >= 0, a2 >= 0, a3 >= 0
            row = np.concatenate((d1[s1], d2[s2], d3[s3]))
            number = np.concatenate((a1[s1], w.of_pair[a2[s2]], a3[s3]))
            times = np.concatenate((tf[s1], tf2[s2], np.ones(s3.sum(), np.int64)))
            order = np.argsort(row, kind="stable")
            kept.append((b.column(0), length, np.sqrt(norm), np.bincount(row, minlength=m), number[order], times[order]))
        if not kept:
            return
        keys = pa.concat_arrays([k[0] for k in kept])
        length, norm, many, number, times = (np.concatenate([k[i] for k in kept]) for i in range(1, 6))
        first = np.concatenate(([0], np.cumsum(many)))
        fs, path = pafs.FileSystem.from_uri(folder)
        for lo, hi in zip(cuts := np.linspace(0, len(keys), -(-len(keys) // block) + 1).astype(int), cuts[1:], strict=False):
            number_, times_ = number[first[lo] : first[hi]], times[first[lo] : first[hi]]
            doc = np.repeat(np.arange(hi - lo), many[lo:hi])
            order = np.argsort(number_, kind="stable")
            data = (w.k1 * (1 - w.b + w.b * length[lo:hi] / (w.avgdl or 1)), norm[lo:hi], first[lo : hi + 1] - first[lo], number_, times_, np.concatenate(([0], np.cumsum(np.bincount(number_, minlength=len(w.terms))))), doc[order], times_[order])
            name = f"{path}/{uuid.uuid4().hex}.block"
            with fs.open_output_stream(name) as out:
                for (_, kind), x in zip(_FIELDS, data, strict=True):
                    x = np.ascontiguousarray(x, kind)
                    out.write(x.tobytes() + bytes(-x.nbytes % 8))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[len(x) for x in data]], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), keys[lo:hi])], names=["path", "sizes", "keys"])

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return line.select(key, "line").mapInArrow(scan, f"path string, sizes array<bigint>, keys array<{kind}>")


class Block:
    """A block's arrays, mapped from its file where it is a local one."""

    def __init__(self, folder: str, path: str, sizes: list[int]):
        fs, _ = pafs.FileSystem.from_uri(folder)
        with pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as f:
            buffer, at = f.read_buffer(), 0
        for (name, kind), n in zip(_FIELDS, sizes, strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.size = sizes[0]


def _rounded(x):
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


class Query:
    """Terms and factors of a query, and what the blocks so far had for it: extremes of both scores, with the documents that
    may have them, and documents that may be among the best."""

    def __init__(self, number, bm, tf, w):
        self.number, self.m_bm, self.m_tf = number, bm, np.where(w.tf[number] != 0, tf, 0)
        self.w_bm, self.w_tf = self.m_bm * w.bm[number], self.m_tf * w.tf[number] ** 2
        self.norm = math.sqrt(((self.m_tf * w.tf[number]) ** 2).sum())
        self.low, self.high = [1 << 30, 1 << 30], [-1, -1]
        self.ends = [[], [], [], []]  # lowest and highest of both, as (block, documents, whole-number scores)
        self.kept, self.left, self.all = [], [], np.zeros(0, np.int32)
        # a document may hold a term of BM25 and none of TF-IDF; that of a phrase holds its words too
        cosine = set(number[self.m_tf > 0].tolist())
        self.gap = any(cosine.isdisjoint(w.inner.get(x, ())) for x in number[(bm > 0) & (self.m_tf == 0)].tolist())
        self.parts = [x for x in zip(number.tolist(), bm.tolist(), self.m_tf.tolist(), strict=True) if x[1] or x[2]]


def score_blocks(asked: DataFrame, qkey: str, key: str, kind: str, blocks, weights, folder: str, n: int, mix: tuple[float, float], most: int = HELD) -> DataFrame:
    """The best ``n`` documents of each row ``(qkey, term, bm, tf)`` of lists.

    Whole-number scores are sums of rounded products, B in the upper and T in the lower half of one number. Each is off by at
    most one half (one, where it is raised to one) a term, so the documents that may hold an extreme or be among the best
    are known, and only they are scored exactly. What a document must have to be kept is guessed from the blocks before. When
    the bounds are known, a block whose left-out documents could still be among the best is read again.
    """
    schema = f"`{qkey}` {asked.schema[qkey].dataType.simpleString()}, `{key}` {kind}, bm25 double, tfidf double, combined double, rank int"

    def scan(batches):
        w, told = weights.value, blocks.value
        held = [Block(folder, p, s) for p, s in zip(told["path"].to_pylist(), told["sizes"].to_pylist(), strict=True)]
        keys = [x.values for x in told["keys"]]
        for b in batches:
            for lo in range(0, b.num_rows, most):
                yield from some(b.slice(lo, most), w, held, keys)

    def some(b, w, held, keys):
        number = _numpy(pc.index_in(pc.list_flatten(b.column(1)), w.terms).fill_null(-1)).astype(np.int64)
        bm, tf = (_numpy(pc.list_flatten(b.column(i))) for i in (2, 3))
        ends = np.cumsum(_numpy(pc.list_value_length(b.column(1))))
        queries = []
        for hi, many in zip(ends, np.diff(ends, prepend=0), strict=True):
            s = slice(hi - many, hi)
            there = number[s] >= 0
            queries.append(Query(number[s][there], bm[s][there], tf[s][there], w))
        # B stays below 2^15 and T below 2^16: a term's part of BM25 is under k1 + 1, a cosine at most 1
        terms = max([1, *(len(q.number) for q in queries)])
        unit_b = (32_000 - terms) / max([1e-9, *(q.w_bm.sum() * (w.k1 + 1) for q in queries)])
        unit_t = (65_000 - terms) / max([1e-9, *(q.norm for q in queries)])
        longest, widest = max(x.length.max() for x in held), max(x.norm.max() for x in held)
        for q in queries:
            for side, (x, unit, least) in enumerate(((q.w_bm[q.m_bm > 0], unit_b, (w.k1 + 1) / (1 + longest)), (q.w_tf[q.m_tf > 0], unit_t, 1 / max(widest, 1e-300)))):
                x = x * (unit * least)
                worst = float(x.min()) if len(x) else 1.0
                # largest error a term, units a term adds at least, number of terms
                setattr(q, "ab"[side], (0.5 if worst >= 0.5 else 1.0, worst, len(x)))
        for k, block in enumerate(held):
            add = adder(block, w, unit_b, unit_t)
            for q in queries:
                if len(q.number):
                    seen(q, k, add(q), n, mix)
        again = {}
        for q in queries:
            bounds(q, held, w)
            if q.high[0] >= 0:
                for k in doubtful(q, n, mix, unit_b, unit_t):
                    again.setdefault(k, []).append(q)
        for k, qs in again.items():
            add = adder(held[k], w, unit_b, unit_t)
            for q in qs:
                acc = add(q)
                s = q.a_b * (acc >> 16) + q.a_t * (acc & 0xFFFF)
                at = np.flatnonzero((s >= q.least) & (acc > 0))
                q.kept = [x for x in q.kept if x[0] != k] + [(k, at, acc[at])]
        rows, places, values = [], [], []
        for i, q in enumerate(queries):
            if q.high[0] < 0:
                continue
            parts = [(k, d[good]) for k, d, acc in q.kept if (good := q.a_b * (acc >> 16) + q.a_t * (acc & 0xFFFF) >= q.least).any()]
            got = exact(q, parts, held, w)
            bm, tf = _rounded(got[0]), _rounded(got[1])
            both = _rounded(sum(f * ((x - a) / (z - a + 1e-8)) for f, x, (a, z) in zip(mix, (bm, tf), q.bounds, strict=True)))
            rows.append(np.full(len(bm), i))
            places += parts
            values.append((bm, tf, both))
        if not rows:
            return
        names = pa.concat_arrays([keys[k].take(pa.array(d)) for k, d in places])
        got = pa.table([pa.array(np.concatenate(rows)), names, *(pa.array(np.concatenate(x)) for x in zip(*values, strict=True))], names=["q", key, "bm25", "tfidf", "combined"])
        got = got.take(pc.sort_indices(got, sort_keys=[("q", "ascending"), ("combined", "descending"), (key, "ascending")], null_placement="at_start"))
        j = got["q"].to_numpy()
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        got = got.append_column("rank", pa.array(rank + 1, pa.int32())).filter(pa.array(rank < n)).combine_chunks()
        out = [b.column(0).take(got["q"].combine_chunks()), *(got[x].combine_chunks() for x in got.column_names[1:])]
        yield pa.RecordBatch.from_arrays(out, names=[qkey, *got.column_names[1:]])

    return asked.mapInArrow(scan, schema)


def adder(block: Block, w, unit_b: float, unit_t: float):
    """The whole-number scores of a block's documents for a query, in one array that the next call overwrites."""
    made: dict = {}
    size = -(-block.size // 8) * 8
    acc = np.zeros(size, np.int32)

    def part(term, m_bm, m_tf):
        at = slice(block.start[term], block.start[term + 1])
        doc, tf = block.doc[at].astype(np.int64), block.times[at]
        b, t = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
        if m_bm:
            b = np.maximum(1, np.rint(tf * ((w.k1 + 1) * m_bm * w.bm[term] * unit_b) / (tf + block.length[doc]))).astype(np.int32)
        if m_tf:
            t = np.maximum(1, np.rint(tf * (m_tf * w.tf[term] ** 2 * unit_t) / block.norm[doc])).astype(np.int32)
        v = (b << 16) + t
        if len(doc) < FULL * block.size:
            return doc, v
        full = np.zeros(size, np.int32)
        full[doc] = v
        return None, full

    def add(q):
        acc.fill(0)
        for x in q.parts:
            got = made.get(x)
            if got is None:
                got = made[x] = part(*x)
            doc, v = got
            if doc is None:
                np.add(acc, v, out=acc)
            elif len(doc):
                acc[doc] += v
        return acc

    return add


def _reach(low: int, error: float, worst: float, terms: int) -> float:
    """The largest whole-number score that the document with the lowest score may have, if ``low`` is the lowest such."""
    mine = min(terms, low / max(1.0, math.floor(worst + 0.5)))
    return low + error * mine + error * min(terms, (low + error * mine) / worst if worst > 0 else terms)


def _where(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of eights of which few are true."""
    i = (np.flatnonzero(mask.view(np.int64))[:, None] * 8 + EIGHT).ravel()
    return i[mask[i]]


def seen(q: Query, k: int, acc: np.ndarray, n: int, mix: tuple[float, float]) -> None:
    """Takes from a block's scores what a query may need of it."""
    top = int(acc.max())
    if not top:
        return
    low, high = q.low, q.high
    u = acc - ONE
    u &= SIGNED  # zero becomes the largest
    low_b, high_b = int(u.min()) + 1 >> 16, top >> 16
    low[0], high[0] = min(low[0], low_b), max(high[0], high_b)
    if low_b <= (limit := _reach(low[0], *q.a)):
        at = _where(u < (int(limit) + 1 << 16) - 1)
        q.ends[0].append((k, at, acc[at] >> 16))
    if high_b >= (limit := max(1, math.ceil(high[0] - 2 * q.a[0] * q.a[2]))):
        at = _where(acc >= limit << 16)
        q.ends[1].append((k, at, acc[at] >> 16))
    t = acc & LOWER
    np.subtract(t, ONE, out=u)
    u &= SIGNED
    low_t, high_t = int(u.min()) + 1, int(t.max())
    if low_t > 0xFFFF or q.gap and low[1] > 0 and np.count_nonzero(t) < np.count_nonzero(acc):
        low_t = 0
    low[1], high[1] = min(low[1], low_t), max(high[1], high_t)
    if low[1] == 0:
        q.ends[2] = [None]  # a document of the pool without a term of TF-IDF: zero exactly
    elif low_t <= (limit := _reach(low[1], *q.b)):
        at = _where(u < int(limit))
        q.ends[2].append((k, at, t[at]))
    if high_t >= (limit := max(1, math.ceil(high[1] - 2 * q.b[0] * q.b[2]))):
        at = _where(t >= limit)
        q.ends[3].append((k, at, t[at]))
    # units of the combined score, as whole numbers
    f_b, f_t = mix[0] / max(1, q.high[0] - q.low[0]), mix[1] / max(1, q.high[1] - q.low[1])
    scale = min(16_000 / max(f_b, f_t), 2.0e9 / (f_b * q.high[0] + f_t * q.high[1]))
    f_b, f_t = int(f_b * scale), int(f_t * scale)
    s = np.right_shift(acc, 16, out=u)
    s *= f_b
    t *= f_t
    s += t
    if len(q.all) < n:
        group = s[: len(s) // 32 * 32].reshape(32, -1).max(axis=0) if len(s) >= 64 * n else s
        bar = int(np.partition(group, len(group) - n)[len(group) - n]) if len(group) > n else 0
        bar = max(1, int(bar * SLACK))
    else:
        old = (q.all >> 16) * f_b + (q.all & LOWER) * f_t
        bar = max(1, int(np.partition(old, len(old) - n)[len(old) - n] * SLACK))
        if len(old) > 4 * n:
            q.all = q.all[old >= bar]
            q.left += [(x, f_b, f_t, bar, q.high[0], q.high[1]) for x, _, _ in q.kept]
            q.kept = [(x, d[good], a[good]) for x, d, a in q.kept if (good := (a >> 16) * f_b + (a & LOWER) * f_t >= bar).any()]
    at = _where(s >= bar)
    q.left.append((k, f_b, f_t, bar, high_b, high_t))
    if len(at):
        a = acc[at]
        q.kept.append((k, at, a))
        q.all = np.concatenate((q.all, a))


def exact(q: Query, parts, held, w) -> tuple[np.ndarray, np.ndarray]:
    """BM25 and cosine of documents, given by block."""
    if not hasattr(w, "room"):
        w.room = np.zeros((2, len(w.terms)))
    w.room[0, q.number], w.room[1, q.number] = q.w_bm, q.w_tf
    got, many = [], []
    for k, d in parts:
        x = held[k]
        lo = x.row[d]
        many.append(x.row[d + 1] - lo)
        at = _runs(lo, many[-1])
        got.append((x.term[at], x.tf[at], x.length[d], x.norm[d]))
    if not got:
        return np.zeros(0), np.zeros(0)
    term, times, length, norm = map(np.concatenate, zip(*got, strict=True))
    many = np.concatenate(many)
    row = np.repeat(np.arange(len(many)), many)
    bm = np.bincount(row, w.room[0, term] * times * (w.k1 + 1) / (times + length[row]), len(many))
    dot = np.bincount(row, w.room[1, term] * times, len(many))
    tf = np.where(dot > 0, dot / np.where(dot > 0, norm, 1) / (q.norm or 1), 0.0)
    w.room[:, q.number] = 0
    return bm, tf


def bounds(q: Query, held, w) -> None:
    """The exact extremes of both scores, rounded."""
    if q.high[0] < 0:
        return
    parts, cuts = [], [0]
    for i, ends in enumerate(q.ends):
        side, end = divmod(i, 2)
        error, worst, terms = (q.a, q.b)[side]
        if q.high[side] and ends and ends[0] is not None:
            limit = q.high[side] - 2 * error * terms if end else _reach(q.low[side], error, worst, terms)
            parts += [(k, d[good]) for k, d, x in ends if (good := x >= limit if end else x <= limit).any()]
        cuts.append(sum(len(d) for _, d in parts))
    got = exact(q, parts, held, w)
    v = [_rounded(got[i // 2][lo:hi]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    q.bounds = [[float(v[i].min()) if len(v[i]) else 0.0, float(v[i + 1].max()) if len(v[i + 1]) else 0.0] for i in (0, 2)]


def doubtful(q: Query, n: int, mix, unit_b: float, unit_t: float) -> list[int]:
    """Blocks of which documents that weren't kept may be among the best; sets what those must have at least."""
    (b0, b1), (t0, t1) = q.bounds
    a_b, a_t = mix[0] / (b1 - b0 + 1e-8), mix[1] / (t1 - t0 + 1e-8)
    q.a_b, q.a_t = a_b / unit_b, a_t / (unit_t * (q.norm or 1))
    acc = np.concatenate([a for _, _, a in q.kept])
    s = q.a_b * (acc >> 16) + q.a_t * (acc & 0xFFFF)
    # what rounding may move, of scores and of their sum
    off = 2 * (q.a[0] * q.a[2] * q.a_b + q.b[0] * q.b[2] * q.a_t) + 2e-6 * (1 + a_b + a_t)
    q.least = float(np.partition(s, len(s) - n)[len(s) - n]) - off if len(s) >= n else -1.0
    out = []
    for k, f_b, f_t, bar, most_b, most_t in q.left:
        if bar == 1 and f_b and f_t or k in out:
            continue  # all that hold a term were kept
        # f_b B + f_t T < bar, B and T at most those of the block: the largest of their mixed sum lies in a corner
        x = min(most_b, bar / f_b) if f_b else most_b
        y = min(most_t, bar / f_t) if f_t else most_t
        corner = max(q.a_b * x + q.a_t * (min(most_t, max(0.0, bar - f_b * x) / f_t) if f_t else most_t), q.a_t * y + q.a_b * (min(most_b, max(0.0, bar - f_t * y) / f_b) if f_b else most_b))
        if corner >= q.least:
            out.append(k)
    return out


def pool(docs: DataFrame, asked: DataFrame, phrases: list[str], key: str, text: str, qkey: str, n: int, mix: tuple[float, float] = (0.7, 0.3), k1: float = 1.5, b: float = 0.75, floor: float = 0.25, max_df: float = 0.9, block: int = BLOCK, most: int = HELD) -> DataFrame | None:
    """``(qkey, key, bm25, tfidf, combined, rank)`` of queries given as ``asked``, ``(qkey, term, bm, tf)`` with the times a
    term counts in either score. Nothing if terms weigh less than zero, which whole-number scores can't hold.

    The driver holds all words and the pairs of words that stand in more than one document; tasks take queries, and each reads
    the blocks of all documents.
    """
    sc = docs.sparkSession.sparkContext
    line = cut(lines(docs, key, text), "lines")
    phrases = Phrases(phrases)
    freq = cut(frequencies(line, phrases), "frequencies")
    asked = cut(asked.groupBy(qkey).agg(F.collect_list("term").alias("term"), F.collect_list(F.col("bm").cast("bigint")).alias("bm"), F.collect_list(F.col("tf").cast("bigint")).alias("tf")), "asked")
    w = Weights(freq, asked.select(F.explode("term").alias("term")).distinct(), k1, b, floor, max_df)
    if len(w.bm) and w.bm.min() < 0:
        return None
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    _written.append((docs.sparkSession, folder))  # for release
    shared = sc.broadcast(w)
    told = cut(index(line, key, shared, sc.broadcast(phrases), folder, block), "blocks").toArrow().combine_chunks()
    if not told.num_rows or not len(w.terms):
        return None
    return score_blocks(asked.repartition(max(1, min(2 * sc.defaultParallelism, -(-asked.count() // 64)))), qkey, key, docs.schema[key].dataType.simpleString(), sc.broadcast(told), shared, folder, n, mix, most)
