"""Sources and sinks: text files with page marks, page folders, workbooks as CSV, results, traces, grouped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T


def whole_texts(spark: SparkSession, *paths: str, glob: str = "*.txt") -> DataFrame:
    """``(filepath, filename, file_size_bytes, file_modified, file_hash, text)``: one row a file, each path once."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(list(dict.fromkeys(paths)))
    name = F.element_at(F.split("path", "/"), -1)
    return b.dropDuplicates(["path"]).select(F.col("path").alias("filepath"), name.alias("filename"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("file_modified"), F.md5("content").alias("file_hash"), F.decode("content", "UTF-8").alias("text"))


def page_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(page_no, text)`` of the files ``page_<n>.txt`` of a folder."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter="page_*.txt")
    return t.select(F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\d+)", 1).cast("int").alias("page_no"), F.col("value").alias("text"))


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> ''")


def single_column(spark: SparkSession, path: str) -> DataFrame:
    """``(row_no, value)`` of a CSV file's first column, blank and empty-like cells dropped, row numbers kept."""
    c = spark.read.csv(path, header=True)
    x = c.select(F.monotonically_increasing_id().alias("row_no"), F.trim(F.col(f"`{c.columns[0]}`")).alias("value"))
    return x.filter(~F.lower("value").isin("", "nan", "null"))


def wide_to_long(df: DataFrame, name: str = "question", value: str = "cell", id_column: str | None = None) -> DataFrame:
    """``(question, pos, cell)``: each column is a question, its cells that aren't blank in order; empty columns vanish."""
    order = id_column or "_row"
    x = df if id_column else df.withColumn("_row", F.monotonically_increasing_id())
    cols = [c for c in x.columns if c != order]
    long = x.select(order, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.trim(F.col(f"`{c}`").cast("string")).alias(value)) for c in cols])).alias("p")).select(order, f"p.{name}", f"p.{value}").filter(F.col(value) != "")
    return long.select(name, F.row_number().over(Window.partitionBy(name).orderBy(order)).alias("pos"), value)


def levels(df: DataFrame, question: str = "Question", prefix: str = "Response") -> DataFrame:
    """``(question, level, response)`` of a workbook with a column for each level."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    x = df.unpivot([question], cols, "name", "response").filter("response is not null")
    return x.select(question, F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("level"), "response")


def keyword_list(cell: Column) -> Column:
    """A cell as a list: a list literal or comma-separated, blanks and quotes around entries stripped, blank ones dropped."""
    inner = F.regexp_replace(F.trim(cell), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'\\s]+|[\"'\\s]+$", "")), lambda x: x != "")


def keyword_book(df: DataFrame) -> DataFrame:
    """``(question, keywords)``: of a question that stands more than once the last row (the largest id) counts."""
    x = df.filter("question is not null and keywords is not null").groupBy(F.trim("question").alias("question")).agg(F.max_by("keywords", "kw_id").alias("cell"))
    return x.select("question", keyword_list(F.col("cell")).alias("keywords"))


def scanned(pages: DataFrame, least: int = 100, first: int = 5) -> DataFrame:
    """``(key, scanned)``: a file is digital if its first pages hold more than ``least`` characters a page."""
    x = pages.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter(F.col("n") <= first)
    return x.groupBy("doc_id").agg((F.sum(F.length(F.trim("page_text"))) <= least * F.count("*")).alias("scanned"))


def to_ingest(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files whose path and hash the store doesn't hold."""
    return files.join(store.select("filepath", "file_hash").distinct(), ["filepath", "file_hash"], "left_anti")


def write_chunks(df: DataFrame, path: str, by: str = "filename") -> None:
    """Replaces the chunks of the files in ``df`` and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """CSV with a header, scores to four places."""
    out = df.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
    out.write.mode("overwrite").csv(path, header=True)


def write_trace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def grouped_text(df: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """Lines of a report: a header line wherever the group changes, then the text."""
    # the group changes at its first row: found by an aggregate, so no large group is sorted in one task
    first = df.groupBy(*group).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    x = df.alias("a").join(first.alias("b"), same, "inner").select("a.*", "b._first", key_of(group).alias("_key"))
    head = F.col("_first") == F.struct(*order)
    return x.select(*group, *order, F.when(head, F.concat(F.lit("== "), F.col("_key"), F.lit(" ==\n"))).otherwise("").alias("header"), F.col(text).alias("body"))


def key_of(group: list[str]) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(f"a.{g}").cast("string"), F.lit("?")) for g in group])


def stage_dump(df: DataFrame, group: str, score: str, key: str, text: str, n: int = 50, preview: int = 200) -> DataFrame:
    """The best rows of each group with rank and a preview of their text."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(group, "rank", key, score, F.substring(T.squash(F.col(text)), 1, preview).alias("preview"))


def sheet_names(df: DataFrame, column: str) -> DataFrame:
    """``(name, sheet)``: sheet names of at most 31 allowed characters, numbered where they would repeat."""
    x = df.select(F.col(column).alias("name")).filter("name is not null").distinct().withColumn("s", F.substring(F.regexp_replace("name", r"[\[\]:*?/\\]", "_"), 1, 27))
    w = Window.partitionBy(F.lower("s")).orderBy("name")
    n = F.row_number().over(w)
    return x.select("name", F.when(n == 1, F.col("s")).otherwise(F.concat_ws("_", "s", n)).alias("sheet"))
