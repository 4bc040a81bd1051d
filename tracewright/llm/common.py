"""Reading tables, scratch tables in the shared folder, and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


_written: list[str] = []

#: Rows of an Arrow batch between the JVM and Python; texts of 100 kB then make batches of 100 MB at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session sets a bound of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Hand freed memory back to the system at the end of a task: idle Python workers stay beside their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is set only for a plain local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    had = spark.sparkContext.getCheckpointDir()
    if had:
        return had.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    _written.append(f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that this process has written, and how many. Frames that read them can't be used afterwards."""
    conf, n = spark._jsparkSession.sessionState().newHadoopConf(), len(_written)
    for name in _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _written.clear()
    return n


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a scratch table and read it back: lineage ends there, and the planner sees the true size.

    Joins against the result are broadcast by Spark only if its files are below spark.sql.autoBroadcastJoinThreshold.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_size(df: DataFrame, *cols: str) -> int:
    """Total bytes of string columns over the whole table (one narrow aggregate)."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"])


def lowest(keys: DataFrame, most: int) -> DataFrame:
    """The `most` distinct values of the one column of keys with the lowest hashes (all, if there are fewer), as a table.

    A bound on the hash goes first, so that a task passes on its part of the answer and not `most` rows of its own.
    """
    (name,) = keys.columns
    bound = int((1.5 * most + 100) / max(1, keys.count()) * (1 << 32))
    few = keys.where((hash32(name) < bound) & F.col(name).isNotNull()).distinct()
    return materialize(few.orderBy(hash32(name), name).limit(most), "lowest")


def hash32(*cols: Column | str) -> Column:
    """Unsigned 32 bits of the md5 of the columns' text, joined by ':'; the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
