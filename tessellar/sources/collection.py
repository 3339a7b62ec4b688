"""A store of chunks: Parquet tables under one folder, partitioned by file, with equality filters, id lookup and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import dense

SCHEMA = "chunk_id string, filepath string, file_hash string, page int, chunk_index int, chunk_text string, chunk_method string, chunk_size_words int, has_overlap boolean, heading string, embedding array<float>, filename string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_collections(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


@dataclass(frozen=True)
class Collection:
    """``add`` replaces the files it brings and leaves the others; readers push their filters to the scan."""

    spark: SparkSession
    root: str
    name: str

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def exists(self) -> bool:
        fs, p = _fs(self.spark, self.path)
        return bool(fs.exists(p))

    def create(self) -> Collection:
        if not self.exists():
            self.spark.createDataFrame([], SCHEMA).write.parquet(self.path)
        return self

    def drop(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)

    def add(self, chunks: DataFrame) -> None:
        """Columns that ``chunks`` lacks become null."""
        have = set(chunks.columns)
        cols = [c.split() for c in SCHEMA.split(", ")]
        out = chunks.select(*[(F.col(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in cols])
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filename").parquet(self.path)

    def get(self, where: dict | None = None, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """``where``: column to value, or ``{"$and": [...]}`` / ``{"$or": [...]}`` of such."""
        x = self.spark.read.schema(SCHEMA).parquet(self.path)
        if where:
            x = x.filter(_condition(where))
        if ids is not None:
            x = x.filter(F.col("chunk_id").isin(ids))
        return x.limit(limit) if limit else x

    def count(self) -> int:
        return self.get().count()

    def to_ingest(self, files: DataFrame) -> DataFrame:
        """Files whose path and content hash aren't here."""
        return files.join(self.get().select("filepath", "file_hash").distinct(), ["filepath", "file_hash"], "left_anti")

    def query(self, vectors: DataFrame, n: int) -> DataFrame:
        """``(qid, id, sim, rank)`` of the nearest chunks, ids hashed from ``chunk_id``; ``vectors``: ``(id, embedding)``."""
        base = self.get().select(F.xxhash64("chunk_id").alias("id"), "embedding")
        return dense.knn(base, vectors, n, "id", skip_self=False)


def _condition(where: dict) -> Column:
    out = None
    for k, v in where.items():
        if k in ("$and", "$or"):
            parts = [_condition(w) for w in v]
            c = parts[0]
            for p in parts[1:]:
                c = (c & p) if k == "$and" else (c | p)
        else:
            c = F.col(k) == (v["$eq"] if isinstance(v, dict) else v)
        out = c if out is None else out & c
    return out
