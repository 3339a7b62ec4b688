"""Session factory and the few cluster-facing helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_session(app: str = "tessellar", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings every query relies on; on a cluster the submitted settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where none is set, a local session (as in tests)
    gets a temporary one; a cluster must name one, as its nodes share no temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = held.get() if held.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="tessellar-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        d = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(d)
    return d


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Adds ``name``, the row's number from 1 in the order of a column of unlike values, without a sort in one task: rows
    are sorted by ranges, and each range starts behind the sizes of those before it."""
    x = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    x = x.withColumn("_p", F.shiftright("_m", 33)).withColumn("_o", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = x.groupBy("_p").agg(F.count("*").alias("_c"))  # one row for each range
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return x.join(F.broadcast(before), "_p").withColumn(name, (F.col("_b") + F.col("_o") + 1).cast("bigint")).drop("_m", "_p", "_o", "_b")


#: tables of ``cut`` that are still there, with the session that wrote them
_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: lineage ends there and executors may be lost.
    ``release`` deletes what was written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Deletes the tables ``cut`` has written so far, once no frame that reads them is needed; their number."""
    n = 0
    while _written:
        spark, path = _written.pop()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n
