"""Repair of text taken from scanned pages: parted words, misread characters, running titles, page numbers.

Counts come from all chunks: how often each word and each pair of neighbouring words stands, and in which masked forms
lines recur (digits masked, the words of the file's own name masked, look-alike glyphs folded). All counts are kept. They
grow with the corpus, so workers don't hold them: Spark sorts them by hash, the driver streams them into files, and each
node looks up in its copy of the files by binary search, mapped and not read into memory.

Words are grouped by their confusable-glyph skeleton. A word is a misread one if its skeleton's most frequent form is many
times as frequent and its neighbours are known beside that form. Line by line, a chunk is then read with its neighbours;
SQL windows put what is left together into paragraphs.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.llm.splitting import MARK, page_number
from tessellar.session import cut

# Glyphs taken for one another by character recognition. Each glyph is written as the strokes it shares
# with others (n as rl, m as rn, d as cl, u as ii ...), so that glyphs and pairs of glyphs read alike become equal.
STROKES = str.maketrans({"1": "l", "!": "l", "|": "l", "í": "l", "ì": "l", "i": "l", "0": "o", "@": "a", "4": "a", "5": "s", "$": "s", "f": "t", "7": "t", "(": "c", "e": "c", "é": "c", "6": "ll", "8": "ll", "b": "ll", "h": "ll", "u": "ll", "q": "g", "9": "g", "n": "rl", "m": "rrl", "d": "cl", "w": "vv"})
#: the same among capitals
CAPITALS = str.maketrans({"F": "E", "V": "U", "M": "N", "H": "N", "Q": "O", "0": "O", "D": "O", "G": "C", "6": "C", "1": "I", "L": "I", "T": "I", "!": "I", "8": "B", "5": "S", "4": "A", "2": "Z", "P": "R", "Y": "V", "X": "K"})
HYPHENS = "\u00ad\u00ac\u2010\u2011-"
EDGE = ".,;:\"'“”‘’()[]{}|…?!%•·–—*#"
CUT_END = re.compile(rf"([^\W_][\w'’@!({HYPHENS}]*?)[{HYPHENS}][ \t\r]*$")
NUMBER = re.compile(r"[-+]?\d[\d.,]*%?")
PLAIN_PAGE = re.compile(r"\s*(\d{1,4})\s*")
DRESSED_PAGE = re.compile(r"\s*(?:[-–—\[(|]\s*\d{1,4}\s*[-–—\])|]?|\d{1,4}\s*[-–—\])|]|(?:page|seite|p\.|s\.|pg\.?)\s*\d{1,4}(?:\s*(?:of|von|/)\s*\d{1,4})?|\d{1,4}\s*(?:/|of)\s*\d{1,4})\s*", re.I)
ROMAN = re.compile(r"\s*(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*")
LEADERS = re.compile(r"^(.*?\S)(\s*\.{2,}\s*|\s*\t\s*|\s{2,}|\s)(\d{1,4})\s*$")
LEADING = re.compile(r"^\s*(\d{1,4})(\s{2,}|\t|\s)(\S.*)$")
SENTENCE = re.compile(r"[.!?:;][\"'”’)]*\s*$")


@dataclass(frozen=True)
class Scan:
    ratio: float = 20.0  # how many times as frequent the right form must be
    sure: float = 200.0  # ... and without known neighbours beside it
    least_lines: int = 3  # occurrences of a line form that may be a running title


def skeletons(w: str) -> tuple[str, str, str]:
    """A word's skeletons: by strokes, by strokes where nn is read as im, and by capitals."""
    return w.translate(STROKES), w.replace("nn", "im").translate(STROKES), w.upper().translate(CAPITALS)


def own_words(document: str | None) -> frozenset[str]:
    """The words of a file's name, by which running titles name it."""
    stem = re.sub(r"\.\w{1,5}$", "", document or "").lower()
    return frozenset(skeletons(w)[0] for w in re.findall(r"[^\W\d_]{2,}", stem) if w not in ("ar", "of", "the", "report", "annual"))


def line_form(line: str, own: frozenset[str]) -> str:
    """A line with digits, own words and glyphs masked, without a page number at either end."""
    out: list[str] = []
    for w in line.lower().split():
        bare = w.strip(EDGE)
        if not bare:
            continue
        digits = sum(c.isdigit() for c in bare)
        if digits * 2 >= len(bare) and digits > 1 or bare.isdigit():
            k = "0"
        else:
            k = skeletons(bare)[0]
            if k in own:
                k = "<own>"
        if k != "<own>" or not out or out[-1] != "<own>":
            out.append(k)
    while out and out[0] == "0":
        out.pop(0)
    while len(out) > 1 and out[-1] == "0":
        out.pop()
    return " ".join(out)


def _title_like(line: str) -> bool:
    s = line.strip()
    return 3 < len(s) <= 80 and not SENTENCE.search(s) and s[-1] not in f",{HYPHENS}" and (s[0].isupper() or s[0].isdigit()) and len(s.split()) <= 10 and not s.startswith("|")


def is_dressed_page(line: str) -> bool:
    return DRESSED_PAGE.fullmatch(line) is not None or (len(line.strip()) > 0 and ROMAN.fullmatch(line) is not None)


def latest(df: DataFrame) -> DataFrame:
    """One row for each chunk id, the latest delivery."""
    r = F.struct("document", "page", "heading", "chunk")
    return df.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max_by(r, F.struct("ingested_at", r)).alias("r")).select("chunk_id", "r.*")


def _counts(docs: DataFrame) -> DataFrame:
    """``(kind, key, n, strong)``: words (w), line forms (l) and headings without line breaks (h) with their counts. A form
    is a running title for certain where it stands before the title within a heading; ``strong`` counts these."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        forms: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            rows = [("w", k, n, 0) for k, n in words.items()] + [(a, k, n, s) for (a, k), (n, s) in forms.items()]
            words.clear()
            forms.clear()
            c = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["kind", "key", "n", "strong"])

        for b in batches:
            for column in (1, 2):
                flat = pc.list_flatten(pc.utf8_split_whitespace(pc.utf8_lower(b.column(column).fill_null(""))))
                for x in pc.value_counts(flat).to_pylist():
                    w, n = x["values"], x["counts"]
                    if w and w[-1] not in HYPHENS and (w := w.strip(EDGE)):
                        words[w] += n
                        if "-" in w:
                            for part in w.split("-"):
                                words[part] += n
            for d, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = None
                if h:
                    ls = [x for x in h.split("\n") if x.strip()]
                    if len(ls) == 1:
                        forms["h", " ".join(ls[0].lower().split())][0] += 1
                    elif ls and not CUT_END.search(ls[0]) and _title_like(ls[0]):
                        own = own_words(d)
                        forms["l", line_form(ls[0], own)][1] += 1
                if t and "\n" in t:
                    ls = t.split("\n")
                    for x in ls:
                        if _title_like(x) and not is_dressed_page(x):
                            own = own_words(d) if own is None else own
                            forms["l", line_form(x, own)][0] += 1
            if len(words) + len(forms) > 300_000:
                yield flush()
        yield flush()

    return docs.select("document", "heading", "chunk").mapInArrow(scan, "kind string, key string, n bigint, strong bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("strong").alias("strong"))


def hashed(key: str) -> int:
    return int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big")


def _hashed(c: Column) -> Column:
    """``hashed`` in hexadecimal digits, so in the same order."""
    return F.substring(F.md5(c), 1, 16)


class Stored:
    """A table of keys with a number or a text each, in files of sorted 64-bit hashes that every node has."""

    def __init__(self, spark, name: str, rows: DataFrame):
        """``rows``: ``(h, v)`` with ``v`` a number or a text, or ``h`` alone."""
        self.name, self.kind, self.size = f"{name}-{uuid.uuid4().hex}", dict(rows.dtypes).get("v"), 0
        here = Path(tempfile.mkdtemp(prefix="tessellar-lexicon-"))
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        paths = [here / f"{self.name}.{x}" for x in ("h", "v", "t")[: 1 if self.kind is None else 3 if self.kind == "string" else 2]]
        files, end = [p.open("wb") for p in paths], 0

        def put(batch: list) -> None:
            nonlocal end
            np.array([int(r[0], 16) for r in batch], np.uint64).tofile(files[0])
            if self.kind == "string":
                texts = [r[1].encode() for r in batch]
                ends = end + np.cumsum([len(x) for x in texts])
                ends.astype(np.int64).tofile(files[1])
                files[2].write(b"".join(texts))
                end = int(ends[-1])
            elif self.kind:
                np.array([r[1] for r in batch], np.int64).tofile(files[1])
            self.size += len(batch)

        batch: list = []
        for r in rows.orderBy("h").toLocalIterator(prefetchPartitions=True):  # one partition at a time
            batch.append(r)
            if len(batch) == 100_000:
                put(batch)
                batch = []
        if batch:
            put(batch)
        for f in files:
            f.close()
        if self.size:
            for p in paths:
                spark.sparkContext.addFile(str(p))
        self.open = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": None}

    def get(self, key: str, default=None):
        if self.open is None:
            kinds = {"h": np.uint64} | ({} if self.kind is None else {"v": np.int64} | ({"t": np.uint8} if self.kind == "string" else {}))
            self.open = {x: np.memmap(SparkFiles.get(f"{self.name}.{x}"), t, "r") if self.size else np.zeros(0, t) for x, t in kinds.items()}
            self.seen: dict = {}
        if key in self.seen:
            v = self.seen[key]
        else:
            h = np.uint64(hashed(key))
            at, v = int(np.searchsorted(self.open["h"], h)), None
            if at < self.size and self.open["h"][at] == h:
                if self.kind == "string":
                    v = self.open["t"][int(self.open["v"][at - 1]) if at else 0 : int(self.open["v"][at])].tobytes().decode()
                else:
                    v = int(self.open["v"][at]) if self.kind else 1
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = v
        return default if v is None else v

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str):
        return self.get(key)


@dataclass
class Lexicon:
    """What is known of all chunks: words, the skeletons' main forms, pairs of neighbours, running titles, headings."""

    words: Stored
    main: Stored  # by the skeleton's side and the skeleton
    pairs: Stored
    titles: Stored
    headings: Stored
    cfg: Scan

    def mates(self, w: str, capitals: bool = False) -> list[str]:
        """More frequent forms that a word, in capitals or not, may be a misreading of."""
        n = self.words.get(w, 0)
        least = self.cfg.ratio * max(1, n)
        return [m for m in dict.fromkeys(self.main.get(f"{i} {k}") for i, k in enumerate(skeletons(w)[: 3 if capitals else 2])) if m and m != w and self.words[m] >= least]

    def beside(self, a: str, b: str) -> bool:
        return a in self.words and b in self.words and f"{a} {b}" in self.pairs


def _pairs(docs: DataFrame) -> DataFrame:
    """``(pair)``: each two neighbouring words, once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4000):
                b = big.slice(lo, 4000)
                both = pc.binary_join_element_wise(b.column(0).fill_null(""), b.column(1).fill_null(""), "\n")
                lists = pc.utf8_split_whitespace(pc.utf8_lower(both))
                flat = pc.utf8_trim(pc.list_flatten(lists), EDGE).dictionary_encode()
                at, known = flat.indices.to_numpy().astype(np.int64), flat.dictionary
                row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                filled = np.asarray(pc.binary_length(known)) > 0
                ok = filled[at[:-1]] & filled[at[1:]] & (row[:-1] == row[1:])
                key = np.unique(at[:-1][ok] * len(known) + at[1:][ok])
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(known.take(pa.array(key // max(1, len(known)))), known.take(pa.array(key % max(1, len(known)))), " ")], names=["pair"])

    return docs.select("heading", "chunk").mapInArrow(scan, "pair string").select(_hashed(F.col("pair")).alias("h")).distinct()


def _main_forms(words: DataFrame, cfg: Scan) -> DataFrame:
    """``(h, v)``: each skeleton's most frequent form, where it is frequent enough to be anything's right form."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f"{i} {k}", n, w) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(w) > 1 and not NUMBER.fullmatch(w) for i, k in enumerate(skeletons(w))]
            c = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], names=["k", "n", "w"])

    forms = words.filter(F.col("n") >= cfg.ratio).select("key", "n").mapInArrow(scan, "k string, n bigint, w string")
    return forms.groupBy("k").agg(F.max(F.struct("n", "w")).alias("m")).select(_hashed(F.col("k")).alias("h"), F.col("m.w").alias("v"))


def learn(docs: DataFrame, cfg: Scan) -> Lexicon:
    counts = cut(_counts(docs), "counts")
    spark, of = docs.sparkSession, lambda kind: counts.filter(F.col("kind") == kind)
    h = _hashed(F.col("key")).alias("h")
    lines = of("l").filter((F.col("key") != "") & (F.col("n") + F.col("strong") >= cfg.least_lines) & (F.col("strong") >= 1))
    return Lexicon(
        Stored(spark, "words", of("w").select(h, F.col("n").alias("v"))),
        Stored(spark, "main", _main_forms(of("w"), cfg)),
        Stored(spark, "pairs", _pairs(docs)),
        Stored(spark, "titles", lines.select(h)),
        Stored(spark, "headings", of("h").filter("n >= 2").select(h, F.col("n").alias("v"))),
        cfg,
    )


class Reader:
    """Reads the lines of one text with what a lexicon knows."""

    def __init__(self, lex: Lexicon):
        self.lex, self.cfg = lex, lex.cfg
        self.fine: dict[str, bool] = {}

    def is_fine(self, token: str) -> bool:
        """Whether a token can't be a misreading: no more frequent form has its skeleton."""
        if (r := self.fine.get(token)) is None:
            r = not self.candidates(token)
            if len(self.fine) > 500_000:
                self.fine.clear()
            self.fine[token] = r
        return r

    def candidates(self, token: str) -> list[tuple[str, str]]:
        """``(part as it stands, right form)`` choices for a token."""
        raw = token.lower()
        bare = raw.strip(EDGE)
        if not bare or NUMBER.fullmatch(bare) or not any(c.isalpha() for c in bare):
            return []
        lex = self.lex
        shapes = [bare]
        if (raw[:1] in "(!" and raw[:1] and ")" not in raw) or raw[-1:] in "!":
            shapes.append(raw.strip(EDGE.replace("(", "").replace("!", "")))
        out = []
        capitals = len(bare) > 3 and token == token.upper()
        for s in shapes:
            n = lex.words.get(s, 0)
            if s != bare and lex.words.get(bare, 0) >= 5:
                break
            if "-" in s and n == 0:
                out += [(p, m) for p in s.split("-") if len(p) > 1 for m in lex.mates(p, capitals)]
            elif len(s) > 1:
                out += [(s, m) for m in lex.mates(s, capitals)]
        return out

    def misread(self, token: str, before: str, after: str) -> tuple[str, str] | None:
        a, b = before.lower().strip(EDGE), after.lower().strip(EDGE)
        for part, right in self.candidates(token):
            if self.lex.beside(a, right) or self.lex.beside(right, b):
                return part, right
            odd = any(not c.isalpha() and c not in "'’" for c in part) or any(ord(c) > 127 for c in part)
            known = a in self.lex.words and self.lex.words[a] > 4, b in self.lex.words and self.lex.words[b] > 4
            n = self.lex.words.get(part, 0)
            if odd or not any(known) or "-" in token or (len(part) > 3 and (n <= 3 or self.lex.words[right] >= self.cfg.sure * n)):
                return part, right
        return None

    def parted(self, first: str, mark: str, second: str) -> str | None:
        """The whole word of which a line break parts ``first`` and ``second``, or nothing for a compound parted at its
        own hyphen."""
        a, b = first.lower().strip(EDGE), second.lower().strip(EDGE)
        if not a or not b:
            return None
        words = self.lex.words
        whole, compound = words.get(a + b, 0), words.get(f"{a}-{b}", 0)
        if not whole and not compound:  # a part may be misread
            m = [self.lex.words[x] for x in self.lex.mates(a + b)]
            whole = max(m, default=0)
            compound = max((self.lex.words[x] for x in self.lex.mates(f"{a}-{b}")), default=0)
        if whole or compound:
            return first + second if whole > compound else None
        if not b[0].isalpha() or b[0].isupper():
            return None
        both = words.get(a, 0) > 4 and words.get(b, 0) > 4
        return None if both and mark == "-" else first + second

    def lines(self, text: str, page: int, own: frozenset[str], heading: bool) -> list[tuple[list[str], str, bool, bool]]:
        """For each line: its kinds, its repaired text (empty for titles and page numbers), whether a word runs on into
        the next kept line, and whether it is blank."""
        raw = text.split("\n")
        kinds: list[list[str]] = [[] for _ in raw]
        out = list(raw)
        kept: list[int] = []
        for i, line in enumerate(raw):
            if not line.strip():
                continue
            if self._page(line, raw, i, page):
                kinds[i], out[i] = ["pageno"], ""
            elif self._title(line, own, raw, i, heading):
                kinds[i], out[i] = ["header"], ""
            else:
                kept.append(i)
        if heading:
            for i in kept:
                if (t := self._beside_title(raw[i], page)) is not None:
                    kinds[i].append("pageno")
                    out[i] = t
        glue = [False] * len(raw)
        for j, i in enumerate(kept):
            nxt = kept[j + 1] if j + 1 < len(kept) else None
            m = CUT_END.search(out[i])
            head = raw[nxt].split(maxsplit=1)[0] if m and nxt is not None and not heading_break(raw[nxt]) else ""
            if m and head:
                mark = out[i].rstrip()[-1]
                word = self.parted(m[1], mark, head)
                if word is None and head[0].islower():  # a compound keeps its hyphen
                    glue[i] = True
                    out[i] = out[i].rstrip()[:-1] + "-"
                if word is not None:
                    kinds[i].append("hyphen")
                    glue[i] = True
                    out[i] = out[i].rstrip()[:-1]
                    if (hit := self.misread(word, "", "")) is not None:
                        true, low = hit[1], m[1].lower().strip(EDGE)
                        if not true.startswith(low):
                            kinds[i].append("misread")
                        if not true.endswith(head.lower().strip(EDGE)):
                            kinds[nxt].append("misread")
        for j, i in enumerate(kept):
            toks = out[i].split()
            skip_first = j > 0 and glue[kept[j - 1]]
            fixes = []
            for k, t in enumerate(toks):
                if (k == 0 and skip_first) or (k == len(toks) - 1 and (glue[i] or t[-1] in HYPHENS)) or self.is_fine(t):
                    continue
                before = toks[k - 1] if k else (out[kept[j - 1]].split() or [""])[-1] if j else ""
                after = toks[k + 1] if k + 1 < len(toks) else (raw[kept[j + 1]].split() or [""])[0] if j + 1 < len(kept) else ""
                if (hit := self.misread(t, before, after)) is not None:
                    fixes.append((t, like(t, *hit)))
            if fixes:
                kinds[i].append("misread")
                for t, better in fixes:
                    out[i] = out[i].replace(t, better, 1)
        return [(list(dict.fromkeys(k)), o, g, not r.strip()) for k, o, g, r in zip(kinds, out, glue, raw, strict=True)]

    def _title(self, line: str, own: frozenset[str], raw: list[str], i: int, heading: bool) -> bool:
        if not _title_like(line) or (heading and (len(raw) < 2 or i == max(k for k, x in enumerate(raw) if x.strip()))):
            return False
        return line_form(line, own) in self.lex.titles

    def _page(self, line: str, raw: list[str], i: int, page: int) -> bool:
        if MARK.fullmatch(line):
            return False
        if is_dressed_page(line):
            return True
        m = PLAIN_PAGE.fullmatch(line)
        if m is None:
            return False
        n = int(m[1])
        near = [next((x for x in seq if x.strip()), "") for seq in (raw[:i][::-1], raw[i + 1 :])]
        numeric = [NUMBER.fullmatch(x.strip()) is not None for x in near]
        if page >= 0:
            return page <= n <= page + 12 and not all(numeric)
        label = near[0].strip() and len(near[0].split()) <= 3 and not SENTENCE.search(near[0])
        return not any(numeric) and not label and n < 1900

    def _beside_title(self, line: str, page: int) -> str | None:
        """A heading without the page number beside it."""
        whole = " ".join(line.lower().split())
        if (m := LEADERS.match(line)) is not None and MARK.fullmatch(line) is None:
            strong = ".." in m[2] or "\t" in m[2] or len(m[2]) > 1
            if strong or (self._known_title(m[1]) and self.lex.headings.get(whole, 0) * 4 < self._known_title(m[1])):
                return m[1]
        if (m := LEADING.match(line)) is not None:
            if len(m[2]) > 1 or m[2] == "\t" or (self._known_title(m[3]) and self.lex.headings.get(whole, 0) * 4 < self._known_title(m[3])):
                return m[3]
        return None

    def _known_title(self, t: str) -> int:
        return self.lex.headings.get(" ".join(t.lower().split()), 0)


def heading_break(line: str) -> bool:
    return line.lstrip()[:1] in "|#"


def like(token: str, part: str, right: str) -> str:
    """The token with its misread part set right, in the token's case."""
    at = token.lower().find(part)
    if at < 0:
        return token
    old = token[at : at + len(part)]
    new = right.upper() if sum(c.isupper() for c in old) > 1 else right.capitalize() if old[0].isupper() or (at == 0 and not old[0].isalpha() and old[1:2].isupper()) else right
    return token[:at] + new + token[at + len(part) :]


def read_lines(pool: DataFrame, cfg: Scan | None = None) -> DataFrame:
    """``(chunk_id, field, line_no, kinds, text, glue, blank)`` for each line of each chunk and heading.

    Each chunk id counts once, by its latest delivery; null ids, texts and headings give no line; an empty table gives no
    row; extra columns are pruned. ``kinds`` names what was wrong with a line; ``text`` is the line repaired, empty for
    running titles and page numbers; ``glue`` says that its last word goes on in the next line that isn't empty.
    """
    cfg = cfg or Scan()
    docs = cut(latest(pool), "chunks")
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, cfg))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                rows: list[tuple] = []
                for c, d, p, h, t in zip(*(x.to_pylist() for x in big.slice(lo, 2000).columns), strict=True):
                    own, page = own_words(d), page_number(p)
                    for field, text in (("heading", h), ("chunk", t)):
                        if text:
                            rows += [(c, field, i, k, x, g, e) for i, (k, x, g, e) in enumerate(reader.lines(text, page, own, field == "heading"))]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = [big.column(0).type, pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["chunk_id", "field", "line_no", "kinds", "text", "glue", "blank"])

    return docs.select("chunk_id", "document", "page", "heading", "chunk").mapInArrow(scan, "chunk_id string, field string, line_no int, kinds array<string>, text string, glue boolean, blank boolean")


def reflow(lines: DataFrame) -> DataFrame:
    """``(chunk_id, heading, chunk)``: lines joined into paragraphs by SQL windows. A blank line ends a paragraph unless a
    word or sentence runs on across it; rows of a table and page marks stay lines of their own."""
    w = Window.partitionBy("chunk_id", "field").orderBy("line_no")
    x = lines.filter((F.trim("text") != "") | F.col("blank")).withColumn("t", F.trim("text"))
    x = x.withColumn("gap", F.max(F.when(F.col("blank"), F.col("line_no"))).over(w)).filter(~F.col("blank"))
    x = x.withColumn("last", F.lag("t").over(w)).withColumn("last_no", F.lag("line_no").over(w)).withColumn("joined", F.coalesce(F.lag("glue").over(w), F.lit(False)))
    row = F.col("t").startswith("|") | F.col("t").startswith("#")
    ended = F.col("last").rlike(r"[.!?:;][\"'”’)]*$") | F.col("last").startswith("|") | F.col("last").startswith("#")
    fresh = F.col("last").isNotNull() & ~F.col("joined") & (row | F.col("last").startswith("|") | F.col("last").startswith("#") | ((F.coalesce(F.col("gap"), F.lit(-1)) > F.col("last_no")) & (ended | ~F.col("t").rlike(r"^\p{Ll}"))))
    lead = F.when(F.col("last").isNull() | F.col("joined"), "").when(fresh & row & F.col("last").startswith("|"), "\n").when(fresh, "\n\n").otherwise(" ")
    parts = x.select("chunk_id", "field", F.struct("line_no", F.concat(lead, "t").alias("s")).alias("p")).groupBy("chunk_id", "field").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = parts.select("chunk_id", "field", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("s"))
    return text.groupBy("chunk_id").agg(F.max(F.when(F.col("field") == "heading", F.col("s"))).alias("heading"), F.max(F.when(F.col("field") == "chunk", F.col("s"))).alias("chunk"))


def found(pool: DataFrame) -> DataFrame:
    return read_lines(pool).filter(F.size("kinds") > 0).select("chunk_id", "field", "line_no", F.explode("kinds").alias("kind"))
