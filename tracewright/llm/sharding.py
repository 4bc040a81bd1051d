"""Placement of keys on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime number of slots; the broadcast table has this many rows whatever the data (under 1 MB).
SLOTS = 65_537


def _h(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Slot -> index into shards. Shards take turns; each claims the first free slot in its own order of preference.

    A shard's order is offset, offset + skip, offset + 2 * skip, ... modulo the prime slot count, from its name alone.
    Every shard gets slots // n or one more, and removing a shard leaves most other slots where they were.
    """
    n = len(shards)
    if not n or n > slots or len(set(shards)) != n:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_h(x, "offset") % slots for x in shards]
    skip = [_h(x, "skip") % (slots - 1) + 1 for x in shards]
    out, left = np.full(slots, -1, np.int32), slots
    while True:
        for i in range(n):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            left -= 1
            if not left:
                return out


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """df with slot (int) and shard (string): one hash and one broadcast lookup a row, no shuffle.

    Null keys hash as the empty string and so share a shard. Equal keys share a shard; order, repeats and other columns
    don't matter. Columns named slot or shard in df are replaced. Empty table: empty result.
    """
    spark = df.sparkSession
    lookup = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(lookup_table(shards, slots).tolist())], "__tw_slot int, __tw_shard string")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = df.drop("slot", "shard").withColumn("__tw_slot", (hashed % slots).cast("int"))
    return rows.join(F.broadcast(lookup), "__tw_slot").select(*[F.col(f"`{c}`") for c in rows.columns if c != "__tw_slot"], F.col("__tw_slot").alias("slot"), F.col("__tw_shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; rows are spread over tasks first, so that a hot shard isn't one task's work."""
    placed.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(docs, "doc_id", SHARDS)


def sql() -> str:
    """The placement in SQL; the table is written out as two digits a slot."""
    digits = "".join(f"{i:02d}" for i in lookup_table(SHARDS).tolist())
    slot = "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {n} AS INTEGER)".format(n=SLOTS)
    return f"SELECT doc_id, source, slot, 'shard-' || substr('{digits}', 2 * slot + 1, 2) AS shard FROM (SELECT doc_id, source, {slot} AS slot FROM documents) d"
