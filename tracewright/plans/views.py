"""Analysis views over the star-schema and event tables, in one SQL text for Spark and for the oracle engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: US(x): microseconds since the epoch; JK(x): field k of a JSON text.
VIEWS = {
    "traj_events": ("events", """
SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
       (US(ts) - min(US(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t, value / 100 AS u1, CAST(JK(props) AS DOUBLE) / 100 AS u2
FROM events"""),
    "traj_supplier": ("lineitem", """
SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY us) AS INT) AS seq,
       (us - min(us) OVER (PARTITION BY traj_id)) / 8.64e10 / 365 AS t, u1, u2, u3
FROM (SELECT l_suppkey AS traj_id, US(l_shipdate) AS us, avg(l_quantity) / 50 AS u1, avg(round(l_discount * 100)) / 10 AS u2,
             CAST(count(*) AS DOUBLE) AS u3 FROM lineitem GROUP BY l_suppkey, US(l_shipdate)) d"""),
    "run_registry": ("orders", """
SELECT o_orderkey AS run_id, concat('v', substr(o_orderpriority, 1, 1)) AS variant_slug, o_custkey % 10 + 1 AS system_id,
       concat('system_', CAST(o_custkey % 10 + 1 AS VARCHAR(8))) AS system_name, o_orderkey % 5 AS seed, o_orderkey % 2 + 1 AS initial_condition_set,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 100000 END AS loss,
       CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'false' END AS exact_support_match,
       CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE month(o_orderdate) % 5 + 1 END AS final_stage,
       o_custkey % 5 + 1 AS expected_stage, day(o_orderdate) % 7 AS wasted_levels,
       greatest(0, month(o_orderdate) % 5 - o_custkey % 5) AS stage_overshoot, o_totalprice / 1000 AS elapsed_s,
       o_custkey % 13 AS total_invalid_evals, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 - o_totalprice / 1000000 END AS r2
FROM orders"""),
    "level_events": ("events", """
SELECT user_id AS cell, level, CAST(floor((level - 1) / 15.0) + 1 AS INT) AS stage, value AS best_loss, ts, US(ts) AS us,
       user_id % 4 + 1 AS dim, CASE WHEN user_id % 3 = 0 THEN 'exact' ELSE 'surrogate' END AS representability,
       CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS pretune
FROM (SELECT user_id, value, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS level FROM events) e"""),
    "evaluations": ("lineitem", """
SELECT l_suppkey AS fit_id, CAST(row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS INT) AS i,
       CASE WHEN l_quantity >= 45 THEN 1000000.0 ELSE l_extendedprice / 1000 END AS loss
FROM lineitem"""),
    "stage_residuals": ("lineitem", """
SELECT l_suppkey AS traj_id, l_linenumber % 4 + 1 AS split, CAST(l_quantity AS INT) % 5 + 1 AS stage,
       min(l_extendedprice) / 300000 AS residual, max(l_tax) / 10 AS floor_ms, count(*) % 7 <> 0 AS usable
FROM lineitem GROUP BY l_suppkey, l_linenumber % 4 + 1, CAST(l_quantity AS INT) % 5 + 1 HAVING count(*) % 11 <> 0"""),
    "structure_terms": ("lineitem", """
SELECT l_orderkey AS run_id, l_linenumber % 2 + 1 AS eq, l_partkey % 11 + 1 AS term, max(round(l_discount - 0.05, 4)) AS coef
FROM lineitem GROUP BY l_orderkey, l_linenumber % 2 + 1, l_partkey % 11 + 1"""),
    "candidates": ("part", """
SELECT CAST(floor(p_partkey / 50.0) AS INT) AS traj_id, p_partkey AS cand_id, p_partkey - p_partkey % 5 AS parent_id, p_size % 6 + 1 AS n_params,
       p_retailprice / 1000 AS residual, CAST((p_partkey * 7919) % 1009 AS DOUBLE) / 1009 AS loss
FROM part"""),
}


def _spark(sql: str) -> str:
    sql = re.sub(r"\bUS\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)
    return re.sub(r"\bJK\((\w+)\)", r"get_json_object(\1, '$.k')", sql).replace("VARCHAR(8)", "STRING")


def _oracle(sql: str) -> str:
    sql = re.sub(r"\bUS\((\w+)\)", r"epoch_us(\1)", sql)
    return re.sub(r"\bJK\((\w+)\)", r"json_extract_string(\1, '$.k')", sql)


class Views:
    """Tables and views of one data folder, by attribute. Times are read in UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            base, sql = VIEWS[name]
            return self.spark.sql(_spark(re.sub(rf"\bFROM {base}\b", f"FROM {{{base}}}", sql)), **{base: getattr(self, base)})
        raise AttributeError(name)


def oracle(select: str, *views: str, **ctes: str) -> str:
    """SQL for the oracle engine: the views, then the named steps, then the query."""
    parts = [f"{v} AS ({_oracle(VIEWS[v][1])})" for v in views] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + select
