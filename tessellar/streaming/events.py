"""Streams of events: tumbling and sliding windows, sessions, repeated events dropped. An extension: the pipeline itself is
batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.session import checkpoint_dir


def read_events(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A stream over a table's files: a folder of parts, or a single file beside others."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    x = r.parquet(path) if os.path.isdir(path) else r.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return x.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_now(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result, kept in the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    write: Callable = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
