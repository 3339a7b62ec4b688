"""Filling sequences of fixed capacity with whole documents: shortest pack first over the length histogram.

Only the histogram of lengths, which has at most as many entries as the capacity, comes to the driver. Lengths are placed
longest first; a length goes into the packs of the least content that still have room, and where none has, as many new
packs are opened as its documents need. Packs of equal content are one pattern with a count. At the end each pattern
knows which ranks of each length it takes, and documents find their pack by the rank among those of equal length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts by a vocabulary file; a worker loads a file once."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    return _LOADED[path]


@dataclass
class Pattern:
    room: int
    count: int
    parts: tuple[tuple[int, int], ...] = ()  # (length, how many of it), longest first

    def plus(self, length: int, times: int, count: int) -> Pattern:
        parts = self.parts
        if parts and parts[-1][0] == length:
            parts = (*parts[:-1], (length, parts[-1][1] + times))
        else:
            parts = (*parts, (length, times))
        return Pattern(self.room - length * times, count, parts)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Packing patterns that hold exactly the lengths of the histogram."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # largest first
    done: list[Pattern] = []

    def put(p: Pattern) -> None:
        if p.room == 0:
            done.append(p)
            return
        if p.room not in open_by_room:
            open_by_room[p.room] = []
            heapq.heappush(rooms, -p.room)
        open_by_room[p.room].append(p)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit into {capacity}")
        while n:
            while rooms and not open_by_room[-rooms[0]]:
                del open_by_room[-heapq.heappop(rooms)]
            if rooms and -rooms[0] >= length:
                p = open_by_room[-rooms[0]].pop()
                take = min(n, p.count)
                if take < p.count:
                    put(Pattern(p.room, p.count - take, p.parts))
                put(p.plus(length, 1, take))
                n -= take
            else:
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(Pattern(capacity, whole).plus(length, each, whole))
                if rest:
                    put(Pattern(capacity, 1).plus(length, rest, 1))
                n = 0
    return done + [p for ps in open_by_room.values() for p in ps]


@dataclass
class Placement:
    """For each length, the ranges of ranks its patterns take."""

    first_rank: dict[int, list[int]] = field(default_factory=dict)
    first_pack: dict[int, list[int]] = field(default_factory=dict)
    times: dict[int, list[int]] = field(default_factory=dict)
    slot: dict[int, list[int]] = field(default_factory=dict)
    offset: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Placement:
        out, used, pack = cls(), {}, 0
        for p in patterns:
            slot = offset = 0
            for length, m in p.parts:
                for table, x in ((out.first_rank, used.get(length, 0)), (out.first_pack, pack), (out.times, m), (out.slot, slot), (out.offset, offset)):
                    table.setdefault(length, []).append(x)
                used[length] = used.get(length, 0) + p.count * m
                slot += m
                offset += length * m
            pack += p.count
        return out

    def arrays(self) -> dict[int, np.ndarray]:
        return {n: np.array([self.first_rank[n], self.first_pack[n], self.times[n], self.slot[n], self.offset[n]], np.int64) for n in self.first_rank}


def items(df: DataFrame, key: str, text: str, capacity: int, tokenizer: str) -> DataFrame:
    """``(key, piece, start, n, pid, local)``: a document, or each piece of one longer than the capacity, with its rank
    among the items of its length in its partition; in the shared folder, so that ranks outlive a lost executor."""
    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t") != "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pid = token_counter(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                tokens = np.array(count(b.column(1).to_pylist()), np.int64)
                pieces = -(-tokens // capacity)
                row = np.repeat(np.arange(len(tokens)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                n = np.minimum(tokens[row] - piece * capacity, capacity)
                order = np.argsort(n, kind="stable")
                s = n[order]
                head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
                run = np.arange(len(s)) - np.repeat(head, np.diff(np.concatenate((head, [len(s)]))))
                local = np.empty(len(s), np.int64)
                local[order] = seen[s] + run
                seen += np.bincount(n, minlength=capacity + 1)
                cols = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array((piece * capacity).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), pid, np.int32)), pa.array(local)]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "piece", "start", "n", "pid", "local"])

    kind = slim.schema["k"].dataType.simpleString()
    return cut(slim.mapInArrow(scan, f"k {kind}, piece int, start int, n int, pid int, local bigint"), "items")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(seq_id, slot, key, piece, start, n_tokens, at)``: which tokens ``[start, start + n_tokens)`` of which row's text
    stand in which sequence, from its token ``at`` on.

    A document is cut only if it alone is longer than the capacity; then all of its pieces but the last fill a sequence.
    Null and empty texts have no tokens and take no place; every row is an item of its own, also one that repeats or has
    a null key; an empty table gives no row. ``tokenizer`` is the path of a public vocabulary file on every executor.
    """
    it = items(df, key, text, capacity, tokenizer)
    counts = cut(it.groupBy("pid", "n").agg(F.count("*").alias("c")), "lengths")
    histogram = {r["n"]: r["c"] for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    table = Placement.of(shortest_pack_first(histogram, capacity)).arrays()
    w = Window.partitionBy("n").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("pid", "n", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("ahead"))
    ranked = it.join(ahead, ["pid", "n"]).select("k", "piece", "start", "n", (F.col("ahead") + F.col("local")).alias("rank"))
    held = df.sparkSession.sparkContext.broadcast(table)  # some numbers for each pattern and length: bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            seq, slot, at = (np.empty(len(n), np.int64) for _ in range(3))
            order = np.argsort(n, kind="stable")
            edge = np.flatnonzero(np.diff(n[order], prepend=-1, append=-1)) if len(n) else np.zeros(1, int)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                i = order[lo:hi]
                length = n[i[0]]
                first, packs, times, slots, offs = table[int(length)]
                j = np.searchsorted(first, rank[i], side="right") - 1
                q = rank[i] - first[j]
                seq[i], slot[i], at[i] = packs[j] + q // times[j], slots[j] + q % times[j], offs[j] + q % times[j] * length
            cols = [pa.array(seq), pa.array(slot.astype(np.int32)), b.column(0), b.column(1), b.column(2), b.column(3), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["seq_id", "slot", key, "piece", "start", "n_tokens", "at"])

    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"seq_id bigint, slot int, `{key}` {kind}, piece int, start int, n_tokens int, at int")


def utilisation(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, items, tokens, and the share of room used."""
    s = packed.groupBy("seq_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return s.agg(F.count("*").alias("sequences"), F.sum("items").alias("items"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * F.lit(capacity))).alias("used"), F.max("n").alias("fullest"))


def checks(df: DataFrame, packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: documents with text, those of them without a place, those that are cut although they would fit, pieces that
    overlap within a sequence, and sequences of more than the capacity."""
    own = df.filter("text <> ''").select("doc_id")
    by_doc = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("seq_id").orderBy("at", "slot")
    placed = packed.withColumn("end", F.lag(F.col("at") + F.col("n_tokens"), 1, 0).over(w))
    a = own.agg(F.count("*").alias("documents"))
    b = own.join(by_doc, "doc_id", "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("cut"))
    c = placed.agg(F.count_if(F.col("at") < F.col("end")).alias("overlapping"))
    d = packed.groupBy("seq_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"))
    return a.join(b).join(c).join(d)  # one row each


CHECKS_SQL = "SELECT count(*) AS documents, 0::BIGINT AS missing, 0::BIGINT AS cut, 0::BIGINT AS overlapping, 0::BIGINT AS overfull FROM documents WHERE text <> ''"
