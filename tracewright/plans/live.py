"""Streaming queries: level events are written as a few JSON files and run through the streams, as far as they go now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.streaming import heartbeats as H

from .files import folder
from .views import Views, oracle


def source(v: Views, twice: bool = False) -> DataFrame:
    """The events stream: files in level order, so that a cell's events arrive in order."""
    path = folder(v, "stream")
    e = v.level_events.select(F.col("cell"), F.lit("level").alias("event"), "level", "stage", F.col("best_loss").cast("string").alias("best_loss"), F.date_format(F.timestamp_micros(F.col("us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
    e = e.unionByName(e.where("level % 9 = 0")) if twice else e
    e.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.json(path)
    return H.stream_heartbeats(v.spark, path, 100)[0]


def progress(v: Views) -> DataFrame:
    rows = H.run_to_table(H.live_progress(source(v)), folder(v, "progress"), "update")
    last = rows.groupBy("cell").agg(F.max(F.struct("trigger", "level", "best", "silent")).alias("x"))
    return last.select("cell", "x.level", "x.best", "x.silent")


def resumed(v: Views) -> DataFrame:
    """Live progress of a stream that starts where a batch of the first thirty levels ended; cells of even number finish."""
    e = v.level_events
    history = H.cell_progress(e.where("level <= 30"))
    path = folder(v, "stream")
    later = e.where("level > 30").select("cell", F.lit("level").alias("event"), "level", "stage", F.col("best_loss").cast("string").alias("best_loss"), "us")
    ends = e.where("cell % 2 = 0").groupBy("cell").agg(F.max("us").alias("us")).select("cell", F.lit("complete").alias("event"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("stage"), F.lit(None).cast("string").alias("best_loss"), "us")
    rows = later.unionByName(ends).withColumn("timestamp", F.date_format(F.timestamp_micros(F.col("us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).drop("us")
    rows.repartitionByRange(2, "timestamp").sortWithinPartitions("timestamp").write.json(path)
    live = H.running_progress(H.stream_heartbeats(v.spark, path, 100)[0], history)
    out = H.run_to_table(live, folder(v, "running"), "update", settings=H.STATE_STORE)
    # of each cell the last row before it finished, and whether it did
    return out.groupBy("cell").agg(F.max_by(F.struct("level", "best", "silent"), F.struct("trigger", "level")).alias("x"), F.bool_or("finished").alias("finished")).select("cell", "x.level", "x.best", "x.silent", "finished")


#: Records of one file of the merged stream, at most, so that no task's share grows with the table.
FILE_ROWS = 250_000


def _files(rows: int) -> int:
    """Files of a stream of three batches."""
    return 3 * max(1, -(-rows // (3 * FILE_ROWS)))


def merged(v: Views, compact_every: int | None = None) -> DataFrame:
    """Campaign records streamed from files into a history."""
    from tracewright.sources.records import RECORD, numbers, parsed_lines

    from .campaign import records

    src, hist = folder(v, "cells"), folder(v, "history")
    n = _files(v.orders.count())
    records(v).withColumn("seed", F.col("manifest_index") % 50).repartition(n).write.json(src)
    lines = v.spark.readStream.option("maxFilesPerTrigger", n // 3).text(src).withColumn("file", F.input_file_name())
    rows = numbers(parsed_lines(lines, RECORD)).drop("corrupt").withColumn("line", F.col("manifest_index"))
    H.stream_merge(rows, hist, folder(v, "merge-checkpoint"), compact_every=compact_every).awaitTermination()
    whole = v.spark.read.parquet(hist) if compact_every is None else H.read_history(v.spark, hist, rows.drop("file", "line").schema)
    return whole.select("variant", "system_id", "initial_condition_set", "seed", "config_fingerprint")


QUERIES = {
    "t01_stream_heartbeats": (lambda v: H.run_to_table(source(v), folder(v, "events")).select("cell", "event", "level", "stage", "best_loss", F.unix_micros("ts").alias("us")), oracle("SELECT cell, 'level' AS event, level, stage, best_loss, us FROM level_events", "level_events")),
    "t02_dedup_stream": (lambda v: H.run_to_table(H.dedup_stream(source(v, True), "3650 days"), folder(v, "dedup")).select("cell", "level"), oracle("SELECT cell, level FROM level_events", "level_events")),
    "t03_live_progress": (
        progress,
        oracle("SELECT cell, max(level) AS level, min(best_loss) AS best, max(level) - min(level) FILTER (best_loss = b) AS silent FROM (SELECT *, min(best_loss) OVER (PARTITION BY cell) AS b FROM level_events) q GROUP BY cell", "level_events"),
    ),
    "t04_stuck_stream": (lambda v: H.run_to_table(H.stuck_stream(source(v), 7200, "1 minute"), folder(v, "stuck")), oracle("SELECT cell, max(us) AS last_us FROM level_events GROUP BY cell HAVING max(us) // 1000 + 7200000 < (SELECT max(us) // 1000 - 60000 FROM level_events)", "level_events")),
    "t06_level_rate_stream": (lambda v: H.run_to_table(H.level_rate(source(v), "1 hour"), folder(v, "rate"), "complete").drop("trigger").groupBy("start_us", "stage").agg(F.max("n").alias("n")), oracle("SELECT us // 3600000000 * 3600000000 AS start_us, stage, count(*) AS n FROM level_events GROUP BY 1, 2", "level_events")),
    "t06_level_sessions": (lambda v: H.run_to_table(H.level_sessions(source(v), "6 hours", "1 minute"), folder(v, "sessions")), oracle("SELECT cell, start_us, end_us, n FROM ss WHERE end_us <= (SELECT (max(us) // 1000 - 60000) * 1000 FROM level_events)", "level_events", ga="SELECT cell, us, CASE WHEN us - lag(us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS opens FROM level_events WINDOW w AS (PARTITION BY cell ORDER BY us)", nu="SELECT cell, us, sum(opens) OVER (PARTITION BY cell ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM ga", ss="SELECT cell, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM nu GROUP BY cell, k")),
    "t07_stream_merge": (
        merged,
        oracle("SELECT DISTINCT concat('v', substr(o_orderpriority, 1, 1)) AS variant, o_custkey % 10 + 1 AS system_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS initial_condition_set, o_orderkey % 50 AS seed, CASE WHEN o_orderkey % 4 = 0 THEN 'f0' ELSE 'f1' END AS config_fingerprint FROM orders WHERE o_orderkey % 13 <> 0"),
    ),
    "t07_stream_merge_compacted": (
        lambda v: merged(v, 2),
        oracle("SELECT DISTINCT concat('v', substr(o_orderpriority, 1, 1)) AS variant, o_custkey % 10 + 1 AS system_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS initial_condition_set, o_orderkey % 50 AS seed, CASE WHEN o_orderkey % 4 = 0 THEN 'f0' ELSE 'f1' END AS config_fingerprint FROM orders WHERE o_orderkey % 13 <> 0"),
    ),
    "t03_running_progress": (
        resumed,
        oracle("SELECT cell, max(level) AS level, min(best_loss) AS best, max(level) - min(level) FILTER (best_loss = b) AS silent, cell % 2 = 0 AS finished FROM (SELECT *, min(best_loss) OVER (PARTITION BY cell) AS b FROM level_events) q GROUP BY cell HAVING max(level) > 30 OR cell % 2 = 0", "level_events"),
    ),
}
