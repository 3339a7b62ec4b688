"""Scores for abusive, hateful or sexual content: non-negative positive-unlabelled learning on sentences.

The classifier is linear over hashed features of a sentence whose disguises have been undone (``phrases``). It is trained
from sentences of documents that reviewers confirmed as abusive and from unlabelled sentences, with the
class-prior-corrected risk

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

Only some sentence of a confirmed document is abusive. In each the one is picked whose features other confirmed documents
share and all documents rarely hold, if it stands out more than sentences of documents that reviewers denied. Further
sentences are added where a classifier trained on other documents finds them. A document scores as its highest sentence.

Counts of features cover all documents; so does scoring. What is bounded: the labelled documents read (rows and
characters), and the sample of unlabelled documents from which the risk's gradient is estimated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.llm.phrases import Sentences
from tessellar.session import cut

PIECE = 1_000_000  # characters looked at together


@dataclass(frozen=True)
class Learner:
    bits: int = 18
    prior: float = 0.006  # of a sentence to be abusive, in the strata where confirmed documents are
    cost: float = 5.0  # of a missed abusive sentence, in false alarms
    #: bounds of the fit: confirmed and denied documents (rows and characters of each), and the characters that the sample
    #: of unlabelled documents has on average
    most_labelled: int = 4000
    most_chars: int = 20_000_000
    sample_chars: int = 4_000_000
    error: float = 0.07  # of a reviewer of whom nothing is known, which counts as so many marks:
    error_marks: float = 20.0
    denied: float = 0.05  # documents less likely abusive than this are the denied ones
    shrink: float = 0.25  # how far the share of confirmed documents with a feature is drawn to that of all documents
    rare: float = 0.5  # what rareness of word pairs counts beside it
    outlier: float = 0.995  # a picked sentence stands out more than this share of denied documents' sentences
    folds: int = 3
    picked: float = 0.5  # score from which a sentence is added, by a classifier that has not seen its document
    epochs: int = 50
    rate: float = 0.3
    decay: float = 1e-6
    threshold: float = 0.5
    least_share: float = 0.02  # of confirmed documents, that a stratum counts with besides its own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(p: Sentences, wp: np.ndarray, u: Sentences, share: np.ndarray, cfg: Learner) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss, by Adam on the whole batch.
    ``wp`` and ``share`` weigh the positive and the unlabelled sentences."""
    size, pi, wp = p.size, cfg.prior, wp / wp.sum()
    w, b = np.zeros(size), -2.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    least, kept = np.inf, (w, b)
    for t in range(1, cfg.epochs + 1):
        sp, su = _sigmoid(p.times(w) + b), _sigmoid(u.times(w) + b)
        rest = -(np.log1p(-np.minimum(su, 1 - 1e-12)) * share).sum() + pi * (wp * np.log1p(-np.minimum(sp, 1 - 1e-12))).sum()
        risk = -cfg.cost * pi * (wp * np.log(np.maximum(sp, 1e-12))).sum() + max(0.0, rest)
        if risk < least:
            least, kept = risk, (w.copy(), b)
        if rest >= 0:
            gp, gu = pi * wp * (cfg.cost * (sp - 1) - sp), su * share
        else:  # the negative part has gone below zero: step back on it
            gp, gu = pi * wp * sp, -su * share
        g = p.back(gp) + u.back(gu) + cfg.decay * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - cfg.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= cfg.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return kept  # the steps back make the risk swing: the best of all steps


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of each text's sentences; 0 where there is none."""
        out = np.zeros(len(texts))
        for rows, parts in pieces(texts):
            s = Sentences(parts, self.bits)
            if len(s):
                np.maximum.at(out, rows[s.doc], _sigmoid(s.times(self.weights) + self.bias))
        return out


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts, or parts of long ones that end where a sentence does, with the rows they belong to, some at a time."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = len(t)
            if end - at > PIECE:
                stops = [t.rfind(x, at, at + PIECE) + len(x) for x in ("\n", ". ", "! ", "? ") if x in t[at : at + PIECE]]
                later = [k + len(x) for x in ("\n", ". ", "! ", "? ") if (k := t.find(x, at + PIECE)) >= 0]
                end = max(stops) if stops else min(later, default=end)
            rows.append(i)
            parts.append(t[at:end])
            size, at = size + end - at, end
            if size >= PIECE:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), parts


@dataclass
class Counts:
    """Of each feature, how often a document has it: in all documents, and as strata are mixed among confirmed ones."""

    flat: np.ndarray
    mixed: np.ndarray
    documents: float
    mixed_documents: float

    @property
    def rate(self) -> np.ndarray:
        return np.maximum(self.flat / max(1.0, self.documents), self.mixed / max(1e-9, self.mixed_documents)) + 1 / max(1.0, self.documents)


def _pair_rareness(s: Sentences, rare: np.ndarray) -> np.ndarray:
    t = rare[s.pair]
    t[s.third] += rare[s.skip]
    n = np.diff(s.off)
    return (np.add.reduceat(t, s.off[:-1]) + rare[s.close]) / (n + 1 + np.maximum(n - 2, 0))


def train(confirmed: list[tuple[str, float]], denied: list[str], sample: list[str], mixed: list[float], counts: Counts, cfg: Learner) -> Model:
    """A model from confirmed documents with their certainty, denied ones, and a sample of all with each one's weight where
    strata are mixed as among the confirmed. Without any confirmed document all score alike, low."""
    nothing = Model(np.zeros(1 << cfg.bits, np.float32), -4.0, cfg.bits)
    p, u = Sentences([t for t, _ in confirmed], cfg.bits), Sentences(sample, cfg.bits)
    if not len(p) or not len(u):
        return nothing
    sure = np.array([q for _, q in confirmed])
    weight = np.asarray(mixed, float)[u.doc]
    share = (weight / max(weight.sum(), 1e-12) + 1 / len(u)) / 2
    own = [p.features(i) for i in range(len(p))]
    held = np.unique(np.concatenate([f + d * p.size for f, d in zip(own, p.doc, strict=True)]))
    have = np.bincount(held % p.size, sure[held // p.size], minlength=p.size)  # confirmed documents with a feature
    rate, drawn = counts.rate, cfg.shrink * sure.sum()
    odds = lambda n, r: np.log((n + drawn * r) / ((sure.sum() + drawn) * r))
    rare = -np.log(rate)
    stands = np.array([odds(np.maximum(have[f] - sure[d], 0), rate[f]).mean() for f, d in zip(own, p.doc, strict=True)]) + cfg.rare * _pair_rareness(p, rare)
    other = Sentences(denied, cfg.bits)
    other = other if len(other) else u
    bar = np.quantile(other.sums(odds(have, rate)) / other.count + cfg.rare * _pair_rareness(other, rare), cfg.outlier)
    best = np.full(len(confirmed), -np.inf)
    np.maximum.at(best, p.doc, stands)
    picks = (stands >= best[p.doc]) & (stands > bar)
    weighed = lambda keep: np.where(keep, sure[p.doc], 0.0)
    fold = np.arange(len(confirmed))[p.doc] % cfg.folds
    seen = np.zeros(len(p))
    for k in range(cfg.folds):
        if (rest := picks & (fold != k)).any():
            w, b = fit_nnpu(p, weighed(rest), u, share, cfg)
            seen[fold == k] = _sigmoid(p.times(w) + b)[fold == k]
    picks |= seen >= cfg.picked
    if not picks.any():
        return nothing
    w, b = fit_nnpu(p, weighed(picks), u, share, cfg)
    return Model(w.astype(np.float32), float(b), cfg.bits)


def marks(labels: DataFrame, cfg: Learner | None = None) -> DataFrame:
    """``(doc_id, q)``: how likely a marked document is abusive. Each reviewer's latest clear mark counts once, weighed by
    how often the reviewer goes against others; marks other than 0 and 1 and null ids don't count."""
    cfg = cfg or Learner()
    last = labels.filter(F.col("abusive").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id", F.coalesce("annotator", F.lit("")).alias("by")).agg(F.max_by("abusive", F.struct("labelled_at", "abusive")).cast("double").alias("a"))
    doc = Window.partitionBy("doc_id")
    last = last.withColumn("n", F.count("*").over(doc)).withColumn("others", (F.sum("a").over(doc) - F.col("a")) / F.nullif(F.col("n") - 1, F.lit(0)))
    against = F.abs(F.col("a") - F.col("others"))  # both sides err: half of it is the reviewer's
    errs = last.groupBy("by").agg(((F.coalesce(F.sum(against), F.lit(0.0)) / 2 + cfg.error * cfg.error_marks) / (F.count(against) + cfg.error_marks)).alias("e"))
    base = last.agg(F.least(F.greatest(F.avg("a"), F.lit(0.01)), F.lit(0.99)).alias("base"))
    weight = F.ln((1 - F.col("e")) / F.col("e"))
    sums = last.join(errs.withColumn("e", F.least(F.greatest("e", F.lit(0.01)), F.lit(0.45))), "by").groupBy("doc_id").agg(F.sum((2 * F.col("a") - 1) * weight).alias("s"))
    both = sums.crossJoin(F.broadcast(base))  # one row
    return both.select("doc_id", (1 / (1 + F.exp(-F.col("s") - F.ln(F.col("base") / (1 - F.col("base")))))).alias("q"))


def count_features(docs: DataFrame, weight: dict[str | None, float], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each feature stands in all texts, plain and weighted by source. Tasks add up their own first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, mixed = np.zeros(1 << bits), np.zeros(1 << bits)
        for b in batches:
            w = np.array([weight.get(s, 0.0) for s in b.column(1).to_pylist()])
            for rows, parts in pieces(b.column(0).to_pylist()):
                s = Sentences(parts, bits)
                if len(s):
                    flat += s.counts(np.ones(len(s)))
                    mixed += s.counts(w[rows[s.doc]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at]), pa.array(mixed[at])], names=["f", "flat", "mixed"])

    got = docs.select("text", "source").mapInArrow(scan, "f int, flat double, mixed double").groupBy("f").agg(F.sum("flat").alias("flat"), F.sum("mixed").alias("mixed")).toArrow()
    out = np.zeros((2, 1 << bits))  # at most as many rows as features
    out[:, got.column(0).to_numpy()] = got.column(1).to_numpy(), got.column(2).to_numpy()
    return out[0], out[1]


def _draw() -> F.Column:
    return F.xxhash64(F.col("doc_id"), F.lit("abuse"))


def _labelled(d: DataFrame, labels: DataFrame, cfg: Learner) -> tuple[list[tuple[str, str | None, float]], list[str]]:
    """Confirmed documents ``(text, source, q)`` and texts of denied ones, drawn by a hash of the id within the bounds."""
    q = marks(labels, cfg)
    ids = [r for side in (F.col("q") >= 0.5, F.col("q") < cfg.denied) for r in q.filter(side).orderBy(_draw(), "doc_id").limit(cfg.most_labelled).collect()]
    if not ids:
        return [], []
    few = F.broadcast(d.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, q double"))  # 2 * most_labelled rows
    got = cut(d.join(few, "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "source")).alias("t"), F.max("q").alias("q")).select("doc_id", "t.*", "q"), "labelled")
    out: tuple[list, list] = [], []
    for side, into in ((F.col("q") >= 0.5, out[0]), (F.col("q") < 0.5, out[1])):
        upto = F.sum(F.length("text")).over(Window.orderBy(_draw(), "doc_id"))
        keep = got.filter(side).withColumn("upto", upto).filter(F.col("upto") <= cfg.most_chars)
        into += [tuple(r) for r in keep.select("text", "source", "q").collect()]
    return out[0], [t for t, _, _ in out[1]]


def fit(docs: DataFrame, labels: DataFrame, cfg: Learner) -> Model:
    """Trains on the driver, from labelled documents and the sample within their bounds and from counts over all."""
    d = docs.select("doc_id", "text", "source").filter((F.col("text") != "") & F.col("doc_id").isNotNull())
    confirmed, denied = _labelled(d, labels, cfg)
    if not confirmed:
        return train([], [], [], [], Counts(*(np.zeros(1 << cfg.bits),) * 2, 0, 0), cfg)
    mix = Counter(s for _, s, _ in confirmed)
    known = F.broadcast(d.sparkSession.createDataFrame([(s,) for s in mix], "s string"))  # at most most_labelled rows
    sizes = d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    whole = sizes.agg(F.sum("n"), F.sum("chars")).first()
    n = {r[0]: r[1] for r in sizes.join(known, F.col("source").eqNullSafe(F.col("s")), "left_semi").collect()}
    pull = {s: (k / len(confirmed) + cfg.least_share) / (n[s] / whole[0]) for s, k in mix.items() if n.get(s)}
    part = F.pmod(_draw(), F.lit(1 << 30)) < int(min(1.0, cfg.sample_chars / whole[1]) * (1 << 30))
    drawn = [tuple(r) for r in d.filter(part).select("text", "source").collect()]
    flat, mixed = count_features(d, pull, cfg.bits)
    counts = Counts(flat, mixed, whole[0], sum(w * n[s] for s, w in pull.items()))
    return train([(t, q) for t, _, q in confirmed], denied, [t for t, _ in drawn], [pull.get(s, 0.0) for _, s in drawn], counts, cfg)


def scores(docs: DataFrame, model: Model, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, *keep, score)`` of every row; a null or empty text scores 0. Repeated rows and null keys are kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by ``bits``
    slim = docs.select(key, *keep, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(held.value.score(b.column(b.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(scan, f"{kinds}, score double")


def found(docs: DataFrame, labels: DataFrame, cfg: Learner | None = None) -> DataFrame:
    """Documents whose score reaches the threshold."""
    cfg = cfg or Learner()
    return scores(docs, fit(docs, labels, cfg)).filter((F.col("score") >= cfg.threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame, cfg: Learner | None = None) -> DataFrame:
    """``(source, documents, abusive, rate, mean_score)``; a null source is a source of its own."""
    cfg = cfg or Learner()
    s = scores(docs, fit(docs, labels, cfg), "source")
    n = F.count_if(F.col("score") >= cfg.threshold)
    return s.groupBy("source").agg(F.count("*").alias("documents"), n.alias("abusive"), (n / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
