"""Segmentation of documents: pages, lines, headings, sections, tables, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T

MARK = r"(?i)###\s*Page\s+(\d+)\s*###"
PAGE_LINE = r"(?i)^(#*\s*)?(Page|p\.)?\s*\d+\s*(#*\s*)?$"


def split_pages(df: DataFrame, key: str = "doc_id", text: str = "text", keep_preamble: bool = True) -> DataFrame:
    """``(key, ord, page_no, page_text)``. With ``keep_preamble`` text before the first mark is page 0 and marks are cut
    off; without, it is dropped, a text without marks is page 1, and a page's text begins with its mark."""
    t = F.col(text)
    marks = F.regexp_extract_all(t, F.lit(MARK), 0)
    nums = F.transform(F.regexp_extract_all(t, F.lit(MARK), 1), lambda x: x.cast("int"))
    parts = F.split(t, MARK)
    x = df.filter(t.isNotNull()).select(F.col(key), parts.alias("parts"), marks.alias("marks"), nums.alias("nums"))
    if keep_preamble:
        pages = F.zip_with("parts", F.concat(F.array(F.lit(0)), "nums"), lambda p, n: F.struct(n.alias("page_no"), F.trim(p).alias("page_text")))
        y = x.select(key, F.posexplode(pages).alias("ord", "p")).filter("ord > 0 or p.page_text <> ''")
    else:
        tail = F.when(F.size("nums") == 0, F.array(F.struct(F.lit(1).alias("page_no"), F.col("parts")[0].alias("page_text")))).otherwise(
            F.zip_with(F.slice("parts", F.lit(2), F.size("nums")), F.arrays_zip("nums", "marks"), lambda p, m: F.struct(m["nums"].alias("page_no"), F.trim(F.concat(m["marks"], p)).alias("page_text")))
        )
        y = x.select(key, F.posexplode(tail).alias("ord", "p"))
    return y.select(key, "ord", "p.page_no", "p.page_text")


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)``."""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def is_page_line(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_LINE)


def heading_text(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"^#+\s*", "")


def is_heading(line: Column, following: Column | None = None) -> Column:
    """A ``#`` line of one to nine words that doesn't end as a sentence and is written like a title; not a page number,
    and, with a following line given, not one that is followed by another ``#`` line."""
    h = heading_text(line)
    title = (h == F.upper(h)) | (h == F.initcap(h)) | (T.capital_share(h) > 0.7) | h.rlike(r"^\p{Lu}")
    ok = F.trim(line).startswith("#") & (h != "") & (F.size(F.split(h, r"\s+")) < 10) & ~h.rlike(r"[.:?;!]$") & title & ~is_page_line(line)
    return ok if following is None else ok & ~F.coalesce(F.trim(following).startswith("#"), F.lit(False))


def line_map(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line with its page: the last page line's number carried forward, 1 before any."""
    w = Window.partitionBy(key).orderBy("line_no")
    n = F.when(is_page_line(F.col("line")), F.regexp_extract("line", r"(\d{1,9})", 1).cast("int"))
    x = lines(df, key, text)
    following = F.lead("line").over(w)
    return x.select(key, "line_no", "line", F.coalesce(F.last(n, ignorenulls=True).over(w), F.lit(1)).alias("page_no"), F.coalesce(is_heading(F.col("line"), following), F.lit(False)).alias("heading"))


def sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, section, heading, page_no, n_lines, section_text)``: the lines under each heading; headings without lines
    vanish, and lines before any heading stand under ``No Heading``."""
    w = Window.partitionBy(key).orderBy("line_no")
    x = line_map(df, key, text).withColumn("section", F.sum(F.col("heading").cast("int")).over(w))
    x = x.withColumn("title", F.last(F.when(F.col("heading"), heading_text(F.col("line"))), ignorenulls=True).over(w))
    body = x.filter(~F.col("heading") & (F.trim("line") != "") & ~is_page_line(F.col("line")))
    packed = F.array_sort(F.collect_list(F.struct("line_no", "line", "page_no"))).alias("ls")
    g = body.groupBy(key, "section").agg(F.first("title").alias("title"), packed)
    return g.select(key, "section", F.coalesce("title", F.lit("No Heading")).alias("heading"), F.col("ls")[0]["page_no"].alias("page_no"), F.size("ls").alias("n_lines"), F.array_join(F.transform("ls", lambda p: p["line"]), "\n").alias("section_text"))


def heading_levels(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, start, level, title, parent)``: lines that are headings by their form, at three levels, each with the
    last heading of a level above it that no shallower one has closed (an as-of lookup by windows)."""
    w = Window.partitionBy(key).orderBy("line_no")
    x = lines(df, key, text).withColumn("start", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1)
    s = F.trim("line")
    caps = (s == F.upper(s)) & s.rlike(r"\p{Lu}") & (F.length(s) > 3)
    level = F.when(caps & ~s.startswith("|"), 1).when(s.rlike(r"^\*\*.+\*\*$") | s.rlike(r"^#\s+\S") | s.rlike(r"^[0-9]+\.\s+[A-Z]") | s.rlike(r"^[A-Z][a-z]+:$"), 2).when(s.rlike(r"^[0-9]+\.[0-9]+\s+[A-Z]") | s.rlike(r"^[a-z]\)\s+[A-Z]"), 3)
    h = x.withColumn("level", level).filter("level is not null").withColumn("title", s)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("l1_at", F.max(F.when(F.col("level") == 1, F.col("line_no"))).over(before)).withColumn("l1", F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(before))
    h = h.withColumn("l2_at", F.max(F.when(F.col("level") == 2, F.col("line_no"))).over(before)).withColumn("l2", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(before))
    open2 = (F.col("level") == 3) & (F.col("l2_at") > F.coalesce("l1_at", F.lit(-1)))
    return h.select(key, "line_no", "start", "level", "title", F.when(open2, F.col("l2")).when(F.col("level") > 1, F.col("l1")).alias("parent"))


TABLE = r"(?:\|[^\n]*\|\n)+"


def tables(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tables, n_rows, rest)``: runs of table rows, and the text without them."""
    t = F.regexp_extract_all(text, F.lit(TABLE), 0)
    rows = F.aggregate(t, F.lit(0), lambda a, x: a + F.size(F.split(x, "\n")) - 1)
    return df.filter(F.col(text).isNotNull()).select(key, F.size(t).alias("n_tables"), rows.alias("n_rows"), F.regexp_replace(text, TABLE, "").alias("rest"))


def word_windows(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, window)``: consecutive windows of ``size`` blank-separated words."""
    w = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    x = df.select(key, w.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size))
    return x.select(key, "w", F.posexplode(starts).alias("pos", "at")).select(key, "pos", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("window"))


def pack(sentences: Column, most: int) -> Column:
    """Sentences packed in order into chunks of at most ``most`` words, as an array of ``(n_words, s)``: a fold that looks
    only at the last chunk, so a row's chunks need no shuffle."""
    zero = F.array().cast("array<struct<n:int,s:string>>")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(F.split(x, " "))
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["n"] + n <= most)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["n"] + n).alias("n"), F.concat_ws(" ", last["s"], x).alias("s"))))
        return F.when(fits, longer).otherwise(F.concat(acc, F.array(F.struct(n.alias("n"), x.alias("s")))))

    return F.aggregate(sentences, zero, step)


def pack_sentences(df: DataFrame, most: int, keys: list[str], text: str) -> DataFrame:
    """``(*keys, chunk_no, n_words, chunk)``: sentences packed greedily into chunks of at most ``most`` words; a sentence
    longer than that is a chunk of its own."""
    x = df.select(*keys, F.posexplode(pack(T.sentences(F.col(text)), most)).alias("chunk_no", "p"))
    return x.select(*keys, "chunk_no", F.col("p.n").alias("n_words"), F.col("p.s").alias("chunk"))


def split_long(sentences: Column, most: int) -> Column:
    """Sentences of more than ``most`` words cut into windows of that many, the others as they are."""

    def windows(x: Column) -> Column:
        w = F.split(x, " ")
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(most)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(most)), " "))

    return F.flatten(F.transform(sentences, windows))


def chunks_and_tables(df: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, chunk_no, kind, n_words, chunk)``: the text without its tables packed into chunks of at most ``most`` words,
    longer sentences cut into windows, and behind them each table as a chunk of its own, whatever its length. Null texts
    have none."""
    t = F.concat(F.col(text), F.lit("\n"))  # the last line may be a table's
    own = F.transform(F.regexp_extract_all(t, F.lit(TABLE), 0), lambda x: F.struct(F.lit("table").alias("kind"), F.size(F.split(F.trim(x), r"\s+")).alias("n"), F.rtrim(F.regexp_replace(x, r"\n$", "")).alias("s")))
    rest = F.transform(pack(split_long(T.sentences(F.regexp_replace(t, TABLE, "")), most), most), lambda p: F.struct(F.lit("text").alias("kind"), p["n"].alias("n"), p["s"].alias("s")))
    x = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.concat(rest, own)).alias("chunk_no", "p"))
    return x.select(key, "chunk_no", "p.kind", F.col("p.n").alias("n_words"), F.col("p.s").alias("chunk"))


def stitched(df: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)``: the first occurrence of each page in ``wanted`` (``key, page_no``), in the document's order, a newline
    behind each. Documents without any of their wanted pages have no row."""
    w = Window.partitionBy(key, "page_no").orderBy("ord")
    p = split_pages(df, key, text, keep_preamble=False).join(wanted.select(key, "page_no"), [key, "page_no"], "left_semi")
    p = p.withColumn("r", F.row_number().over(w)).filter("r = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "page_text"))).alias("ps"))
    return p.select(key, F.array_join(F.transform("ps", lambda x: F.concat(F.regexp_replace(x["page_text"], r"^\s+|\s+$", ""), F.lit("\n"))), "").alias(text))


def with_overlap(chunks: DataFrame, keys: list[str], sentences: int) -> DataFrame:
    """Each chunk behind the last ``sentences`` sentences of the chunk before it."""
    w = Window.partitionBy(*keys).orderBy("chunk_no")
    s = T.sentences(F.col("chunk"))
    tail = F.array_join(F.slice(s, -F.least(F.size(s), F.lit(sentences)), F.least(F.size(s), F.lit(sentences))), " ")
    lead = F.lag(tail).over(w)
    return chunks.select(*keys, "chunk_no", lead.isNotNull().alias("has_overlap"), F.concat_ws(" ", lead, "chunk").alias("chunk"))


def sentence_context(df: DataFrame, reach: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, context)``: each sentence with up to ``reach`` neighbours on either side."""
    s = T.sentences(F.col(text))
    x = df.select(key, s.alias("s")).select(key, "s", F.posexplode("s").alias("pos", "x"))
    lo = F.greatest(F.lit(0), F.col("pos") - reach)
    return x.select(key, "pos", F.array_join(F.slice("s", lo + 1, F.col("pos") + reach - lo + 1), " ").alias("context"))


def breakpoints(df: DataFrame, group: str, order: str, vector: str, share: float) -> DataFrame:
    """``(group, order, sim, segment)``: a sequence of vectors broken where the similarity of neighbours falls below the
    ``share`` percentile of the group's similarities."""
    from tessellar.functions.vectors import dot

    w = Window.partitionBy(group).orderBy(order)
    x = df.select(group, order, F.round(dot(F.lag(vector).over(w), F.col(vector)), 5).alias("sim"))
    cut = x.groupBy(group).agg(F.percentile("sim", F.lit(share)).alias("cut"))
    return x.join(cut, group).select(group, order, "sim", F.sum(F.when(F.col("sim") < F.col("cut"), 1).otherwise(0)).over(w).alias("segment"))


def semantic_pages(df: DataFrame, key: str, text: str, target: int = 120, most: int = 250, least: int = 10, threshold: float = 0.6) -> DataFrame:
    """``(key, chunk_no, n_words, chunk)``: sentences joined while they resemble the chunk so far, which may so pass ``most``
    words; chunks under ``least`` words at the end are dropped. Resemblance is the cosine of hashed word counts; the fold
    depends on what it has built, so it runs on Arrow batches, a row at a time."""
    import math
    import re
    import zlib
    from collections import Counter

    import pyarrow as pa

    slim = df.select(F.col(key).alias("k"), T.sentences(F.col(text)).alias("s")).filter(F.size("s") > 0)
    kind = slim.schema["k"].dataType.simpleString()

    def vec(s: str) -> Counter:
        return Counter(zlib.crc32(w.encode()) % 512 for w in re.findall("[a-z0-9]+", s.lower()))

    def cos(a: Counter, b: Counter) -> float:
        n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b[k] for k, x in a.items()) / n if n else 0.0

    def fold(ss: list[str]):
        chunk, n, total = [], 0, Counter()
        for s in ss:
            w, v = len(s.split(" ")), vec(s)
            bar = threshold + (0.015 if n >= target else 0) + (0.05 if n > most else 0)
            if chunk and (n > most or n + w > most and n >= least) and cos(total, v) < bar:
                yield n, " ".join(chunk)
                chunk, n, total = [], 0, Counter()
            chunk.append(s)
            n += w
            total += v
        if n >= least:
            yield n, " ".join(chunk)

    def scan(batches):
        for b in batches:
            rows = [(k, i, n, c) for k, ss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (n, c) in enumerate(fold(ss))]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], b.column(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string())], names=[key, "chunk_no", "n_words", "chunk"])

    return slim.mapInArrow(scan, f"`{key}` {kind}, chunk_no int, n_words int, chunk string")


def blocks(df: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, block)``: pieces of at most ``most`` characters, cut behind the last full stop in reach if there is one.
    Where a piece begins depends on the one before, so a row at a time on Arrow batches."""
    import pyarrow as pa

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t") != "")
    kind = slim.schema["k"].dataType.simpleString()

    def cut(t: str):
        at = 0
        while at < len(t):
            stop = min(at + most, len(t))
            if stop < len(t) and (dot := t.rfind(".", at, stop)) > at:
                stop = dot + 1
            yield t[at:stop]
            at = stop

    def scan(batches):
        for b in batches:
            rows = [(k, i, x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(cut(t))]
            c = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], b.column(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string())], names=[key, "pos", "block"])

    return slim.mapInArrow(scan, f"`{key}` {kind}, pos int, block string")
