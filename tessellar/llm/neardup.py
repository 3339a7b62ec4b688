"""Near-duplicate texts by multi-index hashing.

A text's fingerprint is a row of symbols, each the 16-bit hash of its least word-shingle hash under one of a fixed family
of hash functions, so that two fingerprints differ in a share of their symbols that estimates 1 - Jaccard. The
fingerprint is cut into segments. For each segment the Hamming ball of radius one is enumerated by its centre-free form:
a key for each symbol left out. Two texts meet in the table of a segment exactly when the segment differs in at most one
symbol. Pairs that meet are verified over the complete fingerprint, and what passes is checked on the shingle sets.

With 12 segments of 5 symbols a pair at the very threshold of 0.6 meets in some table with probability 0.993, one at
0.65 with 0.999, one at 0.8 with more than 0.9999.

Texts with equal shingle sets form a class, found by a hash of the set and not through the tables; only one representative
of it goes through them, so no group of copies, however large, makes a hot key. A key that many different texts share, as
boilerplate gives, is cut into blocks of ids: each pair of blocks is a task's work of fixed size, in which complete
fingerprints are compared before a pair is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.components import components
from tessellar.llm.wordhash import distinct, mix, ngrams, word_hashes
from tessellar.session import cut


@dataclass(frozen=True)
class Index:
    words: int = 3  # of a shingle
    threshold: float = 0.6
    segments: int = 12
    width: int = 5  # symbols of a segment
    #: standard deviations below the expected matches at the threshold that the complete distance may lie
    slack: float = 5.0
    block: int = 500  # ids of a table key that are paired at once; keys of more go by pairs of blocks
    #: inner pairs of classes of equal shingle sets up to this size are all written out; the copies of a larger one are each
    #: paired with its representative. Links to other classes are written out whatever the sizes.
    expand: int = 10_000

    @property
    def symbols(self) -> int:
        return self.segments * self.width

    @property
    def least_matches(self) -> int:
        t = self.threshold
        return max(1, int(self.symbols * t - self.slack * (self.symbols * t * (1 - t)) ** 0.5))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def fingerprint_batch(texts: pa.Array, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: symbols, the class hash of its shingle set, and all sets' 32-bit shingles with offsets."""
    h, o = word_hashes(texts)
    g, off = distinct(*ngrams(h, o, ix.words))
    size = np.diff(off)
    some, n = size > 0, len(size)
    at = off[:-1][some]
    symbols = np.zeros((n, ix.symbols), np.uint16)
    if some.any():
        for k, (a, b) in enumerate(zip(*_family(ix.symbols), strict=True)):
            low = np.minimum.reduceat((g * a + b) >> np.uint64(20), at)
            symbols[some, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    sig = np.zeros(n, np.uint64)
    if some.any():
        sig[some] = mix(np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) + size[some].astype(np.uint64))
    small, soff = distinct(g >> np.uint64(32), off)
    return symbols, sig, small.astype(np.uint32), soff


def fingerprints(df: DataFrame, key: str, text: str, ix: Index) -> DataFrame:
    """``(id, key, sig, fp, shingles)`` of each distinct key whose text has a shingle at all, written to the shared folder."""
    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    slim = slim.groupBy("k").agg(F.max("t").alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                symbols, sig, s, off = fingerprint_batch(b.column(1), ix)
                keep = pa.array(np.diff(off) > 0)
                ids = np.arange(at, at + b.num_rows)
                at += b.num_rows
                fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * ix.symbols), len(sig), [None, pa.py_buffer(symbols.tobytes())]).cast(pa.binary())
                sets = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((4 * off).astype(np.int32).tobytes()), pa.py_buffer(s.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), pa.array(sig.view(np.int64)), fp, sets], names=["id", "k", "sig", "fp", "shingles"]).filter(keep)

    kind = slim.schema["k"].dataType.simpleString()
    return cut(slim.mapInArrow(scan, f"id bigint, k {kind}, sig bigint, fp binary, shingles binary"), "fingerprints")


def _table_keys(ix: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(ids), ix.symbols).astype(np.uint64)
            out = []
            for s in range(ix.segments):
                for hole in range(ix.width):
                    k = mix(np.full(len(ids), s * ix.width + hole + 1, np.uint64))
                    for j in range(ix.width):
                        if j != hole:
                            k = mix(k * np.uint64(31) + fp[:, s * ix.width + j] + np.uint64(1))
                    out.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(ids, len(out)))], names=["key", "id"])

    return scan


def _meetings(limit: int):
    """``(a, b, key, block)``: pairs of ids within runs of equal keys. Of a run of more than ``limit`` the ids alone, each
    with its block. A run may cross batches; of it at most ``limit`` ids are kept."""

    def rows(a: np.ndarray, b: np.ndarray | None, key: int | None, block: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        first, second = (pa.array(a), none) if b is None else (pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))
        keys = none if key is None else pa.array(np.full(len(a), key, np.int64))
        return pa.RecordBatch.from_arrays([first, second, keys, none if block is None else pa.array(block)], names=["a", "b", "key", "block"])

    def inner(ids: np.ndarray) -> pa.RecordBatch:
        x, y = np.triu_indices(len(ids), 1)
        return rows(ids[x], ids[y], None, None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, gone = None, np.zeros(0, np.int64), 0  # the open run: its ids, or how many of a long one are out

        def close() -> Iterator[pa.RecordBatch]:
            if not gone and len(held) > 1:
                yield inner(held)

        def more(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, gone
            held = np.concatenate((held, ids))
            if gone or len(held) > limit:
                yield rows(held, None, last, (gone + np.arange(len(held))) // limit)
                held, gone = held[:0], gone + len(held)

        for batch in batches:
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            if key[0] != last:
                yield from close()
                last, held, gone = key[0], held[:0], 0
            yield from more(ids[: edge[1]])
            if len(size) == 1:
                continue
            yield from close()
            # pairs of neighbours are by far the most frequent; longer runs are taken one by one
            two = np.flatnonzero(size[1:-1] == 2) + 1
            yield rows(ids[edge[two]], ids[edge[two] + 1], None, None)
            for r in np.flatnonzero(size[1:-1] > 2) + 1:
                last, held, gone = key[edge[r]], held[:0], 0
                yield from more(ids[edge[r] : edge[r + 1]])
                yield from close()
            last, held, gone = key[-1], held[:0], 0
            yield from more(ids[edge[-2] :])
        yield from close()

    return scan


def _block_pairs(hot: DataFrame, prints: DataFrame, ix: Index) -> DataFrame:
    """``(a, b)`` of the ids of long runs, by pairs of blocks, whose fingerprints are alike enough."""
    blocks = hot.groupBy("key").agg(F.max("block").alias("top"))
    h = hot.join(blocks, "key").join(prints.select(F.col("id").alias("a"), "fp"), "a")
    one = h.select("key", F.col("block").alias("x"), F.explode(F.sequence("block", "top")).alias("y"), F.lit(0).alias("side"), "a", "fp")
    two = h.filter("block > 0").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "a", "fp")

    def compare(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("a").to_numpy()
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint16).reshape(len(ids), ix.symbols)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        a, b = [], []
        for i in left if len(right) or same else ():
            other = left[left > i] if same else right
            near = other[(fp[other] == fp[i]).sum(axis=1) >= ix.least_matches]
            a.append(np.full(len(near), ids[i]))
            b.append(ids[near])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return one.unionAll(two).groupBy("key", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def _verify_distance(ix: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= ix.least_matches))

    return scan


def _verify_jaccard(ix: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            js = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                k = len(np.intersect1d(x, y, assume_unique=True))
                js.append(k / (len(x) + len(y) - k))
            j = pa.array(js, pa.float64())
            keep = pa.array(np.asarray(js) >= ix.threshold - 1e-12) if js else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), j], names=["a", "b", "jaccard"]).filter(keep)

    return scan


def class_links(prints: DataFrame, ix: Index) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, k, rep)`` of the classes of equal shingle sets, and links ``(a, b, jaccard)`` of representatives."""
    reps = cut(prints.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    members = prints.select("id", "k", "sig").join(reps, "sig").select("id", "k", "rep", "n")
    own = prints.select("id", "fp", "shingles").join(reps.select(F.col("rep").alias("id")), "id")
    keys = own.select("id", "fp").mapInArrow(_table_keys(ix), "key bigint, id bigint")
    width = max(12, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    runs = cut(keys.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_meetings(ix.block), "a bigint, b bigint, key bigint, block bigint"), "runs")
    met = runs.filter("b IS NOT NULL").select("a", "b").distinct()
    hot = runs.filter("b IS NULL").select("key", "a", "block")

    def both(pairs: DataFrame, column: str) -> DataFrame:
        side = prints.select("id", column)
        p = pairs.join(side.withColumnRenamed("id", "a").withColumnRenamed(column, "x"), "a")
        p = p.join(side.withColumnRenamed("id", "b").withColumnRenamed(column, "y"), "b")
        return p.select("a", "b", "x", "y")

    near = both(met, "fp").mapInArrow(_verify_distance(ix), "a bigint, b bigint")
    near = cut(near if hot.isEmpty() else near.unionAll(_block_pairs(hot, prints, ix)).distinct(), "near")
    links = both(near, "shingles").mapInArrow(_verify_jaccard(ix), "a bigint, b bigint, jaccard double")
    return members, cut(links, "links")


def near_pairs(df: DataFrame, key: str = "chunk_id", text: str = "chunk", ix: Index | None = None) -> DataFrame:
    """``(key_a, key_b, jaccard)``, a < b, of the keys whose texts' shingle sets are at least ``threshold`` alike.

    Null keys and null texts take no part, nor do texts of fewer words than a shingle; rows with the same key count once
    (of differing texts the greatest); an empty table gives no pair. Only the two columns named are read. Classes of more
    than ``expand`` equal sets have copy-representative pairs in place of all inner pairs (``near_groups`` counts all).
    """
    ix = ix or Index()
    members, links = class_links(fingerprints(df, key, text, ix), ix)
    # members by blocks, so that no pair of large classes is one task's work
    parts = F.ceil(F.col("n") / ix.block).cast("int")
    m = members.select("rep", "k", "n", F.pmod(F.xxhash64("k"), parts).cast("int").alias("at"))
    sizes = members.filter("id = rep").select("rep", parts.alias("parts"))
    cells = links.join(sizes.select(F.col("rep").alias("a"), F.col("parts").alias("pa")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("parts").alias("pb")), "b")
    cells = cells.select("a", "b", "jaccard", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("x"), "pb").select("a", "b", "jaccard", "x", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("y"))
    left, right = (m.select(F.col("rep").alias(r), F.col("at").alias(at), F.col("k").alias(k)) for r, at, k in (("a", "x", "ka"), ("b", "y", "kb")))
    across = cells.join(left, ["a", "x"]).join(right, ["b", "y"])
    copies = m.filter(F.col("n") > 1).withColumn("top", parts - 1)
    small = copies.filter(F.col("n") <= ix.expand)
    one = small.select("rep", F.col("at").alias("x"), F.explode(F.sequence("at", "top")).alias("y"), F.col("k").alias("ka"))
    two = small.select("rep", F.explode(F.sequence(F.lit(0), "at")).alias("x"), F.col("at").alias("y"), F.col("k").alias("kb"))
    within = one.join(two, ["rep", "x", "y"]).filter("x < y OR ka < kb")
    first = members.filter("id = rep").select("rep", F.col("k").alias("rk"))
    star = copies.filter(F.col("n") > ix.expand).join(first, "rep").filter("k <> rk").select(F.col("k").alias("ka"), F.col("rk").alias("kb"))
    same = F.lit(1.0).alias("jaccard")
    out = across.select("ka", "kb", "jaccard").unionByName(within.select("ka", "kb", same)).unionByName(star.select("ka", "kb", same))
    return out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), "jaccard")


def near_groups(df: DataFrame, key: str = "chunk_id", text: str = "chunk", ix: Index | None = None) -> DataFrame:
    """``(key, group_id, n_links)``: one row for each key with a shingle set; the group is named by its least key.

    ``n_links`` counts the keys whose texts are at least ``threshold`` alike, equal copies among them. A text without a
    partner is a group of its own.
    """
    ix = ix or Index()
    members, links = class_links(fingerprints(df, key, text, ix), ix)
    comp = components(links.select("a", "b"))
    size = members.filter("id = rep").select("rep", "n")
    both = links.select(F.col("a").alias("to"), F.col("b").alias("rep")).unionAll(links.select(F.col("b").alias("to"), F.col("a").alias("rep")))
    both = both.join(size, "rep").groupBy(F.col("to").alias("rep")).agg(F.sum("n").alias("d"))
    m = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(both, "rep", "left")
    m = m.withColumn("root", F.coalesce("root", "rep"))
    names = m.groupBy("root").agg(F.min("k").alias("group_id"))
    return m.join(names, "root").select(F.col("k").alias(key), "group_id", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("n_links"))


def found(pool: DataFrame) -> DataFrame:
    return near_pairs(pool).select("chunk_id_a", "chunk_id_b")


_LINKS = """
     c AS (SELECT chunk_id, max(chunk) AS t FROM pool_candidates WHERE chunk_id IS NOT NULL AND chunk IS NOT NULL GROUP BY 1),
     w AS (SELECT chunk_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM c),
     g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
     n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
     p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
     l AS (SELECT p.a, p.b FROM p JOIN n x ON x.chunk_id = p.a JOIN n y ON y.chunk_id = p.b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)"""

FOUND_SQL = f"WITH {_LINKS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM l"

GROUPS_SQL = f"""
WITH RECURSIVE {_LINKS},
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT chunk_id AS node, chunk_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT r.node AS chunk_id, min(r.root) AS group_id, (SELECT count(*) FROM e WHERE e.a = r.node) AS n_links FROM r GROUP BY 1
"""
