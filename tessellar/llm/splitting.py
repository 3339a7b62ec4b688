"""Cutting oversized items at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t\n]+")
#: a line that opens a page
MARK = re.compile(r"[ \t]*#+[ \t]*page[ \t]+(\d{1,9})[ \t]*(-[ \t]*empty[ \t]*)?#+[ \t\r]*", re.I)
#: a page in one of the spellings in use: 8, 008, 8.0, p. 8, S. 8, Page 8
PAGE = re.compile(r"\s*(?:(?:pages?|pp?|seite|s|pág|pag)\b\.?)?\s*(\d{1,9})(?:\.0*)?\s*", re.I)
SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]]*$")
#: ends with a full stop, but closes no sentence
ABBREVIATION = re.compile(r"(?:^|\()(?:[A-Za-z]|no|nos|dr|mr|mrs|ms|st|vs|cf|approx|art|fig|inc|ltd|co|e\.g|i\.e|z\.b|bzw)\.$", re.I)
CLAUSE_END = re.compile(r"[,;:–—][\"'”’)]*$")
#: strengths of the boundary behind a word
HARD, CLAUSE, LINE, SENTENCE, PARAGRAPH, NEW_PAGE = 0, 1, 2, 3, 4, 5


@dataclass(frozen=True)
class Piece:
    text: str
    n_words: int
    n_overlap: int
    page: int
    pages: tuple[int, ...]


def page_number(page: str | None) -> int:
    m = PAGE.fullmatch(page) if page is not None else None
    return int(m[1]) if m else -1


def layout(text: str, page: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Of each word outside page marks: its place in the text, its page (-2 on a page marked empty), and the strength
    of the boundary behind it."""
    spans: list[tuple[int, int]] = []
    pages: list[int] = []
    ends: list[int] = []
    at, table = 0, False
    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        if (m := MARK.fullmatch(line)) is not None:
            page = -2 if m[2] else int(m[1])
            if ends:
                ends[-1] = NEW_PAGE
            continue
        found = list(WORD.finditer(line))
        if not found:
            if ends:
                ends[-1] = max(ends[-1], PARAGRAPH)
            continue
        if (row := found[0][0].startswith("|")) != table:
            table = row
            if ends:
                ends[-1] = max(ends[-1], SENTENCE)
        for m in found:
            w = m[0]
            spans.append((here + m.start(), here + m.end()))
            pages.append(page)
            ends.append(SENTENCE if SENTENCE_END.search(w) and not ABBREVIATION.search(w) else CLAUSE if CLAUSE_END.search(w) else HARD)
        ends[-1] = max(ends[-1], SENTENCE if row else LINE)
    if ends:
        ends[-1] = NEW_PAGE
    return spans, pages, ends


def cut_points(ends: list[int], limit: int, max_overlap: int) -> list[tuple[int, int]]:
    """``(first word of the overlap, end)`` of each piece.

    The least number of pieces comes first: equal targets are set, and each moves to the strongest boundary within half a
    piece; what is left is then parted anew. Where a piece with its overlap breaks the limit, or ends inside a sentence, one more piece is tried; ends inside
    a sentence are taken only where twice the least number of pieces doesn't avoid them either.
    """
    n = len(ends)
    if n <= limit:
        return [(0, n)]
    starts = [0] * (n + 1)  # where the sentence that ends before a place begins
    s = 0
    for i in range(n):
        starts[i + 1] = s
        if ends[i] >= SENTENCE:
            s = i + 1
    fallback = None
    least = math.ceil(n / limit)
    # a sentence that doesn't fit beside the overlap from the one before it: no number of pieces ends all of them at sentences
    stops = [i + 1 for i in range(n) if ends[i] >= SENTENCE]
    lengths = [b - a for a, b in zip([0, *stops], stops, strict=False)]
    hopeless = (stops[-1] if stops else 0) < n or any(b > limit or (stop > limit and min(a, max_overlap) + b > limit) for a, b, stop in zip([0, *lengths], lengths, stops, strict=False))
    if hopeless:  # the least number of pieces that keep the limit, by halving: long texts without sentences take no longer
        low, high = least, least
        while high < n and _cuts(ends, starts, high, limit, max_overlap) is None:
            low, high = high + 1, min(n, 2 * high)
        while low < high:
            k = (low + high) // 2
            low, high = (low, k) if _cuts(ends, starts, k, limit, max_overlap) is not None else (k + 1, high)
        return _cuts(ends, starts, high, limit, max_overlap) or [(i, i + 1) for i in range(n)]
    for k in range(least, n + 1):
        out = _cuts(ends, starts, k, limit, max_overlap)
        if out is not None and all(ends[stop - 1] >= SENTENCE for _, stop in out):
            return out
        fallback = fallback or out
        if fallback and k >= 2 * least + 2:
            return fallback
    return fallback or [(i, i + 1) for i in range(n)]


def _cuts(ends: list[int], starts: list[int], k: int, limit: int, max_overlap: int) -> list[tuple[int, int]] | None:
    n, out, at = len(ends), [], 0
    reach = max(1, n // (2 * k))
    for j in range(1, k + 1):
        head = max(starts[at], at - max_overlap) if at else 0
        if j == k:
            stop = n
        else:
            target = at + round((n - at) / (k - j + 1))  # what is left, in equal parts
            low, high, most = max(at + 1, target - reach), min(n - (k - j), target + reach, head + limit), min(n - (k - j), head + limit)
            if low > high:
                return None
            near = lambda i: (ends[i - 1], -abs(i - target), -i)  # noqa: B023, E731
            stop = max(range(low, high + 1), key=near)
            if ends[stop - 1] < SENTENCE:  # none nearby: the strongest the limit allows
                stop = max(range(at + 1, most + 1), key=near)
        if stop - head > limit:
            return None
        out.append((head, stop))
        at = stop
    return out


def split_text(text: str, page: int = -1, limit: int = 250, max_overlap: int | None = None) -> list[Piece]:
    """The pieces of a text: see ``split_oversized``."""
    spans, pages, ends = layout(text, page)
    if not spans:
        return []
    shown = lambda a, b: "".join(x for x in re.split(r"(?<=\n)", text[spans[a][0] : spans[b - 1][1]]) if not MARK.fullmatch(x.rstrip("\n")))
    out, at = [], 0
    for head, stop in cut_points(ends, limit, max_overlap or max(1, limit // 2)):
        own = pages[at:stop]
        seen = tuple(dict.fromkeys(p for p in own if p != -2))
        out.append(Piece(shown(head, stop), stop - head, at - head, seen[0] if seen else -1, seen))
        at = stop
    return out


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "chunk", page: str = "page", limit: int = 250, only_oversized: bool = True) -> DataFrame:
    """Pieces ``(key, pos, text, n_words, n_overlap, page_no, pages)`` of at most ``limit`` words.

    ``pos`` counts from 1. From the second piece on, a piece begins with the last sentence of the one before it
    (``n_overlap`` words; of a sentence longer than half the limit, its end). ``page_no`` is the page of its first own
    word, ``pages`` all pages on which its own words stand. Lines that mark a page are no text. Without
    ``only_oversized``, texts under the limit come as one piece. Null and blank texts, and texts of nothing but page
    marks, give no row; a null key is kept; rows with the same key count once (of differing ones the greatest text);
    an unknown page is -1; an empty table gives no row. Other columns are pruned first.
    """
    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(page).alias("p")).filter(F.col("t").isNotNull())
    if only_oversized:  # more than `limit` words have as many blanks between them; counted without a pattern, before the shuffle
        slim = slim.filter((F.length("t") > 2 * limit) & (F.length("t") - F.length(F.translate("t", " \t\n", "")) >= limit))
    slim = slim.groupBy("k").agg(F.max(F.struct("t", "p")).alias("r")).select("k", "r.t", "r.p")
    kind = slim.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, t, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if only_oversized and sum(1 for _ in WORD.finditer(t)) <= limit:
                    continue
                rows += [(k, i, x.text, x.n_words, x.n_overlap, x.page, list(x.pages)) for i, x in enumerate(split_text(t, page_number(p), limit), 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [b.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            names = [key, "pos", "text", "n_words", "n_overlap", "page_no", "pages"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return slim.mapInArrow(cut, f"`{key}` {kind}, pos int, text string, n_words int, n_overlap int, page_no int, pages array<int>")


def found(pool: DataFrame, limit: int = 250) -> DataFrame:
    """The pages on which each oversized chunk has text."""
    p = split_oversized(pool, limit=limit)
    return p.select("chunk_id", F.explode("pages").alias("page_no")).distinct()


def checks(pool: DataFrame, limit: int = 250) -> DataFrame:
    """``(chunk_id, words, within, joined)`` of each oversized chunk: the words that its pieces hold without their overlaps,
    whether all pieces keep the limit, and whether each begins with the end of the one before it."""
    p = split_oversized(pool, limit=limit).withColumn("w", F.filter(F.split("text", "[ \\t\\n]+"), lambda x: x != ""))
    before = F.lag("w").over(Window.partitionBy("chunk_id").orderBy("pos"))
    p = p.withColumn("before", before).withColumn("o", F.col("n_overlap"))
    tail = F.slice("before", F.size("before") - F.col("o") + 1, F.col("o")) == F.slice("w", F.lit(1), F.col("o"))
    joined = F.when(F.col("pos") == 1, F.col("o") == 0).otherwise((F.col("o") > 0) & tail)
    return p.groupBy("chunk_id").agg(F.sum(F.size("w") - F.col("o")).alias("words"), F.every((F.size("w") <= limit) & (F.size("w") == F.col("n_words"))).alias("within"), F.every(joined).alias("joined"))


CHECKS_SQL = r"""
WITH c AS (SELECT chunk_id, r.t AS t FROM (SELECT chunk_id, max({'t': chunk, 'p': page}) AS r FROM pool_candidates WHERE len(regexp_extract_all(chunk, '[^ \t\n]+')) > 250 GROUP BY 1)),
     l AS (SELECT chunk_id, unnest(string_split(t, chr(10))) AS line FROM c)
SELECT chunk_id, sum(len(regexp_extract_all(line, '[^ \t\n]+')))::BIGINT AS words, true AS within, true AS joined FROM l
WHERE NOT regexp_full_match(line, '(?i)[ \t]*#+[ \t]*page[ \t]+\d{1,9}[ \t]*(-[ \t]*empty[ \t]*)?#+[ \t\r]*') GROUP BY 1 HAVING words > 0
"""

FOUND_SQL = r"""
WITH c AS (SELECT chunk_id, r.t AS t, r.p AS p FROM (SELECT chunk_id, max({'t': chunk, 'p': page}) AS r FROM pool_candidates WHERE len(regexp_extract_all(chunk, '[^ \t\n]+')) > 250 GROUP BY 1)),
     l AS (SELECT chunk_id, p, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT chunk_id, p, string_split(t, chr(10)) AS x FROM c)),
     m AS (SELECT *, regexp_full_match(line, '(?i)[ \t]*#+[ \t]*page[ \t]+\d{1,9}[ \t]*(-[ \t]*empty[ \t]*)?#+[ \t\r]*') AS mark FROM l),
     o AS (SELECT *, last_value(CASE WHEN mark AND regexp_matches(line, '(?i)empty') THEN -2 WHEN mark THEN regexp_extract(line, '(\d+)', 1)::INT END IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY i) AS opened FROM m)
SELECT DISTINCT chunk_id, coalesce(opened, try_cast(nullif(regexp_extract(p, '(?i)^\s*(?:(?:pages?|pp?|seite|s)\.?)?\s*(\d{1,9})(?:\.0*)?\s*$', 1), '') AS INT), -1)::INT AS page_no
FROM o WHERE NOT mark AND trim(line, ' ' || chr(9)) <> '' AND coalesce(opened, 0) <> -2
"""
