"""Readers and writers of benchmark JSON, campaign records, run folders, registries and heartbeats. Schemas are explicit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEMS = "id int, eq string, eq_description string, dim int, source string, substituted array<array<string>>, init array<array<double>>, solutions array<array<struct<t: array<double>, y: array<array<double>>>>>"
#: Metric fields are read as text: writers spell non-finite numbers as strings.
RECORD = "manifest_index long, variant string, system_id long, system_name string, representability string, seed long, initial_condition_set int, config_fingerprint string, git_hash string, error string, timestamp string, loss string, r2 string, final_stage long, stage_overshoot long, wasted_levels long, elapsed_s string, pruned_match boolean, u0 array<double>, support_terms array<array<string>>, eq_final_stages array<int>"
HEARTBEAT = "timestamp string, event string, variant string, system_id long, seed long, initial_condition_set int, level int, stage int, best_loss string"
METRICS = ("loss", "r2", "elapsed_s", "best_loss")


class MalformedInput(ValueError):
    pass


def read_systems(spark: SparkSession, path: str, ic: int = 1, array: bool = True) -> DataFrame:
    """traj_id, seq, t, u (array) of the chosen initial-condition set of nested benchmark files.

    array: each file is one JSON array, read whole; else one system a line, which Spark can split.
    """
    sys_ = spark.read.schema(SYSTEMS).option("multiLine", array).json(path)
    sol = F.get(F.get("solutions", F.lit(0)), F.lit(ic - 1))
    rows = sys_.select(F.col("id").alias("traj_id"), "dim", sol.alias("s")).where(F.col("s").isNotNull()).select("traj_id", "dim", "s", F.posexplode("s.t").alias("pos", "t"))
    return rows.select("traj_id", (F.col("pos") + 1).alias("seq"), "t", F.transform("s.y", lambda y: F.get(y, F.col("pos"))).alias("u"))


def numbers(df: DataFrame) -> DataFrame:
    """Metric texts as doubles: Infinity, -Infinity and NaN count, anything else that is no number is null."""
    return df.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in METRICS if c in df.columns})


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema, corrupt (the text of a malformed line or a non-object, else null) and file."""
    full = T._parse_datatype_string(schema).add("corrupt", "string")
    j = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    body = lines.where(F.trim("value") != "")
    obj = F.when(F.trim("value").startswith("{"), j)
    return body.select("file", obj.alias("j"), "value").select("file", "j.*", "value").withColumn("corrupt", F.when(F.trim("value").startswith("{"), F.col("corrupt")).otherwise(F.col("value"))).drop("value")


def _lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select("value", F.input_file_name().alias("file"))


def read_records(spark: SparkSession, path: str, strict: bool = True, schema: str = RECORD) -> DataFrame:
    """Cell records of JSON-lines files. Blank lines are skipped; strict: a malformed line or no line at all is an error.

    Not strict: malformed lines stay as rows with corrupt set.
    """
    rows = parsed_lines(_lines(spark, path, "*.json*"), schema)
    if strict:
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count("corrupt").alias("bad")).first()
        if n["bad"]:
            raise MalformedInput(f"{n['bad']} malformed lines under {path}")
        if not n["n"]:
            raise MalformedInput(f"no records under {path}")
        rows = rows.drop("corrupt")
    return numbers(rows)


def read_run_folders(spark: SparkSession, root: str, schemas: Mapping[str, str], glob: str = "{name}.json", run: str = r"/([^/]+)/[^/]+$") -> dict[str, DataFrame]:
    """name -> table with run_id, readable and the schema's columns, for files <root>/<run>/<name>.json.

    root and glob may hold {name}; run is the pattern that finds the run in a file's path.
    """
    out, key = {}, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    # folders are listed by a few tasks a core, not by one a folder
    had = spark.conf.get(key)
    spark.conf.set(key, str(min(int(had), 4 * spark.sparkContext.defaultParallelism)))
    try:
        texts = {name: spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob.format(name=name)).text(root.format(name=name)) for name in schemas}
    finally:
        spark.conf.set(key, had)
    for name, schema in schemas.items():
        text = texts[name]
        struct = T._parse_datatype_string(schema).add("corrupt", "string")
        j = F.from_json("value", struct, {"columnNameOfCorruptRecord": "corrupt"})
        rows = text.select(F.regexp_extract(F.input_file_name(), run, 1).alias("run_id"), "value").select("run_id", j.alias("j"), F.trim("value").startswith("{").alias("obj"))
        out[name] = rows.select("run_id", (F.col("obj") & F.col("j.corrupt").isNull()).alias("readable"), *[F.col(f"j.{f.name}").alias(f.name) for f in struct if f.name != "corrupt"])
    return out


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry or aggregate CSV with header; without rows it is an error."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if df.isEmpty():
        raise MalformedInput(f"no rows under {path}")
    return df


def read_heartbeats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(level events, files): cell file, level, stage, best_loss, us; and per file its start time and malformed lines."""
    rows = numbers(parsed_lines(_lines(spark, path, "*.json*"), HEARTBEAT))
    us = F.unix_micros(F.to_timestamp("timestamp"))
    files = rows.groupBy("file").agg(F.min(F.when(F.col("event") == "start", us)).alias("start_us"), F.count("corrupt").alias("malformed"), F.count_if(F.col("event") == "level").alias("levels"))
    return rows.where("event = 'level' and corrupt is null").select("file", "variant", "system_id", "seed", "level", "stage", "best_loss", us.alias("us")), files


def six_digits(df: DataFrame) -> DataFrame:
    """Doubles as %.6g text, as the CSV sink writes them."""
    return df.select(*[F.format_string("%.6g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    six_digits(df).write.option("header", True).csv(path)


def comparison(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as text with eight digits and a decimal comma."""
    return df.select(*[F.replace(F.format_string("%.8f", c), F.lit("."), F.lit(",")).alias(c) for c in cols])


def write_comparison_csv(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    comparison(df, cols).write.option("header", True).option("sep", ";").csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a row; Spark's task commit makes files appear whole or not at all."""
    df.write.json(path)


def config_fingerprint(config: Mapping[str, object]) -> str:
    """First 16 hex digits of the SHA-256 of a canonical text: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprint_column(canonical):
    """The same of a column that holds canonical text."""
    return F.substring(F.sha2(canonical, 256), 1, 16)
