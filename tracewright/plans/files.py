"""Queries that write tables as files and read them through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import campaign as E
from tracewright.sources import records as S
from tracewright.sources.scratch import shared_folder

from .campaign import REC_SQL, records
from .derivatives import r
from .views import Views, oracle


def folder(v: Views, tag: str) -> str:
    return f"{shared_folder(v.spark)}/{tag}-{uuid.uuid4().hex}"


def systems(v: Views) -> DataFrame:
    """The series of events as a nested benchmark file per task, read back."""
    g = v.traj_events.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "u1", "u2"))).alias("s"))
    sol = F.struct(F.col("s.t").alias("t"), F.array(F.col("s.u1"), F.col("s.u2")).alias("y"))
    rows = g.select(F.col("traj_id").cast("int").alias("id"), F.lit(2).alias("dim"), F.array(F.array(sol)).alias("solutions"))
    path = folder(v, "systems")
    rows.write.json(path)
    return S.read_systems(v.spark, path, array=False)


def record_files(v: Views) -> str:
    path = folder(v, "records")
    S.write_records(records(v).withColumn("loss", F.when(F.col("manifest_index") % 50 == 0, "Infinity").otherwise(F.col("loss").cast("string"))), path)
    return path


def run_folders(v: Views) -> DataFrame:
    """Status and metrics files of one folder per run of 50 customers; some are missing, some broken."""
    c, root = v.customer.groupBy(F.floor(F.col("c_custkey") / 50).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")), folder(v, "runs")
    run = F.concat(F.lit("run"), F.col("k").cast("string"))
    parts = {
        "config": c.select(run.alias("run"), F.concat(F.lit('{"run_id":"'), run, F.lit('"}')).alias("value")),
        "status": c.where("k % 7 <> 1").select(run.alias("run"), F.when(F.col("k") % 5 == 0, '{"status": "run').otherwise(F.lit('{"status":"finished","finished_at":"t"}')).alias("value")),
        "metrics": c.where("k % 9 <> 1").select(run.alias("run"), F.concat(F.lit('{"loss":'), F.col("n").cast("string"), F.lit("}")).alias("value")),
        "result": c.select(run.alias("run"), F.lit('{"ok":true}').alias("value")),
    }

    # a folder a run: tasks write a few dozen each and move them into place themselves
    tasks = c.count() // 64 + 1
    for name, df in parts.items():
        df.repartition(tasks, "run").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("run").text(f"{root}/{name}")
    schemas = {"config": "experiment_id string", "status": "status string, finished_at string", "metrics": "loss double", "result": "ok boolean"}
    t = S.read_run_folders(v.spark, root + "/{name}", schemas, "*", r"run=([^/]+)/")
    return E.build_registry(c.select(run.alias("run_id")), t["config"].select("run_id", "readable"), t["status"], t["metrics"], t["result"].select("run_id", "readable"))


def registry_csv(v: Views) -> DataFrame:
    path = folder(v, "registry")
    v.run_registry.select("run_id", "variant_slug", "system_id", "loss", "r2").write.option("header", True).csv(path)
    return S.read_registry(v.spark, path, "run_id long, variant_slug string, system_id long, loss double, r2 double")


def heartbeats(v: Views) -> str:
    path = folder(v, "beats")
    e = v.level_events.select(F.date_format(F.timestamp_micros(F.col("us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.when(F.col("level") == 1, "start").otherwise("level").alias("event"), F.concat(F.lit("v"), F.col("cell").cast("string")).alias("variant"), F.col("cell").alias("system_id"), "level", "stage", F.col("best_loss").cast("string").alias("best_loss"))
    lines = e.select(F.when((F.col("level") == 5) & (F.col("system_id") % 10 == 0), "{broken").otherwise(F.to_json(F.struct("*"))).alias("value"))
    lines.write.text(f"{path}/a.jsonl.d")
    return path


def read_beats(v: Views) -> DataFrame:
    lines = v.spark.read.option("recursiveFileLookup", True).text(heartbeats(v)).select("value", F.lit("all").alias("file"))
    return S.parsed_lines(lines, S.HEARTBEAT)


def comparison(v: Views) -> DataFrame:
    path = folder(v, "comparison")
    # scaled before it is rounded, as the SQL engine does: rounding the number's decimal text differs at some ties
    t = v.traj_events.withColumns({"t": F.round(F.col("t") * 10000) / 10000, "yhat1": F.col("u2") * 2})
    S.write_comparison_csv(t, path, ["t", "u1", "yhat1"])
    return v.spark.read.option("header", True).option("sep", ";").schema("t string, u1 string, yhat1 string").csv(path)


def csv_sink(v: Views) -> DataFrame:
    path = folder(v, "csv")
    S.write_csv(v.traj_events.select("traj_id", "seq", "u1", "u2"), path)
    return v.spark.read.option("header", True).schema("traj_id long, seq int, u1 string, u2 string").csv(path)


QUERIES = {
    "s01_read_systems": (lambda v: systems(v).select("traj_id", "seq", "t", F.element_at("u", 1).alias("u1"), F.element_at("u", 2).alias("u2")), oracle("SELECT traj_id, seq, t, u1, u2 FROM traj_events", "traj_events")),
    "s03_read_records": (
        lambda v: S.read_records(v.spark, record_files(v)).select("manifest_index", "variant", "system_id", "seed", "initial_condition_set", "error", "loss"),
        oracle("SELECT manifest_index, variant, system_id, seed, initial_condition_set, error, CASE WHEN manifest_index % 50 = 0 THEN 'Infinity'::DOUBLE ELSE loss END AS loss FROM rc", rc=REC_SQL),
    ),
    "s04_read_run_folders": (run_folders, oracle("SELECT 'run' || k AS run_id, CASE WHEN k % 7 = 1 THEN NULL WHEN k % 5 = 0 THEN 'corrupted' ELSE 'finished' END AS status, CASE WHEN k % 7 = 1 THEN 'never_started' WHEN k % 5 = 0 THEN 'corrupted' ELSE 'finished' END AS inferred_status, k % 9 <> 1 AS metrics_available, (k % 7 <> 1 AND k % 5 = 0) OR (k % 7 <> 1 AND k % 5 <> 0 AND k % 9 = 1) AS corrupted, CASE WHEN k % 9 <> 1 THEN n END AS loss FROM (SELECT CAST(floor(c_custkey / 50.0) AS INT) AS k, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) q")),
    "s05_read_registry": (registry_csv, oracle("SELECT run_id, variant_slug, system_id, loss, r2 FROM run_registry", "run_registry")),
    "s06_read_heartbeats": (
        lambda v: S.numbers(read_beats(v)).where("event = 'level' and corrupt is null").select("system_id", "variant", "level", "stage", "best_loss", F.unix_micros(F.to_timestamp("timestamp")).alias("us")),
        oracle("SELECT cell AS system_id, 'v' || cell AS variant, level, stage, best_loss, us FROM level_events WHERE level > 1 AND NOT (level = 5 AND cell % 10 = 0)", "level_events"),
    ),
    "s06_malformed": (
        lambda v: read_beats(v).agg(F.count("corrupt").alias("malformed"), F.count_if(F.col("event") == "start").alias("starts")),
        oracle("SELECT count(*) FILTER (level = 5 AND cell % 10 = 0) AS malformed, count(*) FILTER (level = 1) AS starts FROM level_events", "level_events"),
    ),
    "s07_write_csv": (lambda v: csv_sink(v).select("traj_id", "seq", F.round(F.col("u1").cast("double"), 6).alias("u1"), F.round(F.col("u2").cast("double"), 6).alias("u2")), oracle("SELECT traj_id, seq, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM traj_events", "traj_events")),
    "s08_write_comparison": (comparison, oracle("SELECT replace(printf('%.8f', round(t, 4)), '.', ',') AS t, replace(printf('%.8f', u1), '.', ',') AS u1, replace(printf('%.8f', u2 * 2), '.', ',') AS yhat1 FROM traj_events", "traj_events")),
    "s09_write_records": (lambda v: S.read_records(v.spark, record_files(v)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")), oracle("SELECT variant, count(*) AS n, count(error) AS errors FROM rc GROUP BY 1", rc=REC_SQL)),
    "s11_fingerprint": (
        lambda v: r(v.run_registry.select("run_id", S.fingerprint_column(F.concat(F.lit('{"seed":'), F.col("seed").cast("string"), F.lit(',"variant":"'), F.col("variant_slug"), F.lit('"}'))).alias("fingerprint"))),
        oracle("""SELECT run_id, substr(sha256('{"seed":' || seed || ',"variant":"' || variant_slug || '"}'), 1, 16) AS fingerprint FROM run_registry""", "run_registry"),
    ),
}
