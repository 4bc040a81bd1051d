"""Queries over campaign data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import campaign as E

from .aggregates import AG
from .derivatives import r
from .views import Views, oracle

REC_SQL = "SELECT o_orderkey AS manifest_index, concat('v', substr(o_orderpriority, 1, 1)) AS variant, o_custkey % 10 + 1 AS system_id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS INT) END AS initial_condition_set, o_orderkey % 5 AS seed, CASE WHEN o_orderkey % 4 = 0 THEN 'f0' ELSE 'f1' END AS config_fingerprint, CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' WHEN o_orderkey % 17 = 0 THEN '' END AS error, o_totalprice / 100000 AS loss, CASE WHEN o_custkey % 3 = 0 THEN 'surrogate' ELSE 'exact' END AS representability, o_orderkey % 2 = 0 AS pruned_match FROM orders"
MAN = {
    "vs": "SELECT DISTINCT concat('v', substr(o_orderpriority, 1, 1)) AS variant FROM orders", "ss": "SELECT DISTINCT o_custkey % 10 + 1 AS system_id FROM orders",
    "mf": "SELECT row_number() OVER (ORDER BY variant, system_id, initial_condition_set, seed) - 1 AS manifest_index, variant, system_id, initial_condition_set, seed FROM vs, ss, (VALUES (1), (2)) i(initial_condition_set), (VALUES (0), (1), (2), (3), (4), (5)) s(seed)",
}
OK = "(error IS NULL OR error = '')"
K5 = "variant, system_id, initial_condition_set, seed, config_fingerprint"
REGD = "CASE WHEN o_orderkey % {} = {} THEN NULL ELSE o_orderkey % {} <> {} END"


def records(v: Views) -> DataFrame:
    """Campaign records made from orders; some fail, some lack the condition set."""
    o = v.orders
    k = F.col("o_orderkey")
    return o.select(
        k.alias("manifest_index"), F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1)).alias("variant"), (F.col("o_custkey") % 10 + 1).alias("system_id"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("initial_condition_set"), (k % 5).alias("seed"),
        F.when(k % 4 == 0, "f0").otherwise("f1").alias("config_fingerprint"), F.when(k % 13 == 0, "timeout").when(k % 17 == 0, "").alias("error"), (F.col("o_totalprice") / 100000).alias("loss"),
        F.when(F.col("o_custkey") % 3 == 0, "surrogate").otherwise("exact").alias("representability"), (k % 2 == 0).alias("pruned_match"), F.when(k % 5 > 1, F.sequence(F.lit(1), (k % 4 + 1).cast("int"))).alias("u0"),
        F.when(k % 5 > 0, F.array(F.array(F.lit("u1")), F.array(F.lit("u1"), F.lit("u2")))).alias("support_terms"), F.when(k % 7 != 0, F.col("o_totalprice") / 1000000).alias("r2"),
    )


def manifest(v: Views) -> DataFrame:
    o = records(v)
    ints = lambda name, xs: v.spark.createDataFrame([(x,) for x in xs], f"{name} int")
    return E.build_manifest(o.select("variant").distinct(), o.select("system_id").distinct(), ints("initial_condition_set", (1, 2)), ints("seed", range(6)))


def folders(v: Views) -> tuple[DataFrame, ...]:
    k = F.col("o_orderkey")
    base = v.orders.select(k, (k % 1000).alias("x"), F.col("o_totalprice").alias("p"))
    some = lambda m, a, b, *c: base.where(k % m != a).select(k.alias("run_id"), (k % m != b).alias("readable"), *c)
    st = some(7, 1, 2, F.when(k % 3 == 0, "running").when(k % 3 == 1, "finished").otherwise("failed").alias("status"), F.when(k % 5 == 0, F.lit("t")).alias("finished_at"))
    return base.select(k.alias("run_id")), some(23, 3, 4), st, some(11, 5, 6, F.col("p").alias("loss")), some(13, 7, 8)


FOLD = "SELECT o_orderkey AS run_id, o_totalprice AS loss, " + ", ".join(f"CASE WHEN o_orderkey % {m} = {a} THEN NULL ELSE o_orderkey % {m} <> {b} END AS {n}" for n, m, a, b in (("c", 23, 3, 4), ("s", 7, 1, 2), ("m", 11, 5, 6), ("t", 13, 7, 8))) + ", CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'finished' ELSE 'failed' END AS status, o_orderkey % 5 = 0 AS fin FROM orders"
REG = "SELECT run_id, CASE WHEN NOT coalesce(c, false) OR NOT s THEN 'corrupted' WHEN s THEN status END AS status, CASE WHEN NOT coalesce(c, false) THEN 'corrupted' WHEN s IS NULL THEN 'never_started' WHEN NOT s THEN 'corrupted' WHEN status = 'running' AND NOT fin THEN 'interrupted' ELSE status END AS inferred_status, coalesce(c, false) AND coalesce(m, false) AS metrics_available, NOT coalesce(c, false) OR coalesce(NOT s, false) OR coalesce(NOT m, false) OR (s IS NOT NULL AND status = 'finished' AND (NOT coalesce(t, false) OR m IS NULL)) AS corrupted, CASE WHEN coalesce(c, false) AND coalesce(m, false) THEN loss END AS loss FROM fo"


def merging(v: Views):
    rec = records(v).withColumn("seed", F.col("manifest_index") % 50)
    new = rec.where("manifest_index % 2 = 0").withColumns({"file": F.concat(F.lit("f"), (F.col("manifest_index") % 9).cast("string")), "line": F.col("manifest_index")})
    return E.merge_records(new, rec.where("manifest_index % 2 = 1"))


MRG = {
    "rc": REC_SQL.replace("o_orderkey % 5 AS seed", "o_orderkey % 50 AS seed"),
    "rr": f"SELECT * REPLACE (coalesce(initial_condition_set, 1) AS initial_condition_set), {OK} AS ok FROM rc",
    "hv": f"SELECT DISTINCT {K5}, true AS seen FROM rr WHERE manifest_index % 2 = 1",
    "nw": f"SELECT *, row_number() OVER (PARTITION BY {K5}, ok ORDER BY 'f' || manifest_index % 9, manifest_index) AS rn FROM rr WHERE manifest_index % 2 = 0",
    "mg": f"SELECT nw.*, ok AND seen IS NULL AND rn = 1 AS added FROM nw LEFT JOIN hv USING ({K5})",
}
CELL = {**AG, "cells": "SELECT * FROM ag WHERE NOT (variant_slug = 'v4' AND system_id = 3)"}


def cells(v: Views) -> DataFrame:
    return A.aggregate_runs(v.run_registry).where("NOT (variant_slug = 'v4' AND system_id = 3)")


def classes(v: Views) -> DataFrame:
    """Two rows a system: exact only if both are."""
    s = v.run_registry.select("system_id").distinct()
    two = F.array(F.lit("exact"), F.when(F.col("system_id") % 3 == 0, "surrogate").otherwise("exact"))
    return s.where("system_id <> 10").select("system_id", F.explode(two).alias("representability"))


def one(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


SCI = "CASE WHEN {x} IS NULL THEN '--' WHEN {x} = 0 THEN '0' ELSE printf('%.1f', {x} / pow(10.0e0, floor(log10(abs({x}))))) || 'e' || CAST(floor(log10(abs({x}))) AS INT) END"
RAW = "SELECT o_orderkey AS run_id, concat('v', substr(o_orderpriority, 1, 1)) AS variant, o_custkey % 10 + 1 AS system_id, CASE o_orderkey % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'no' WHEN 3 THEN '1.0' ELSE 'n/a' END AS exact_support_match, CASE WHEN o_orderkey % 6 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS loss FROM orders"


def raw_registry(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return v.orders.select(k.alias("run_id"), F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1)).alias("variant"), (F.col("o_custkey") % 10 + 1).alias("system_id"), F.when(k % 5 == 0, " TRUE").when(k % 5 == 1, "0").when(k % 5 == 2, "no").when(k % 5 == 3, "1.0").otherwise("n/a").alias("exact_support_match"), F.when(k % 6 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("loss"))


def readout(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    rec = v.orders.select((F.col("o_custkey") % 20).alias("system_id"), k.alias("line_no"), (F.col("o_totalprice") / 1000).alias("loss"), F.when(k % 13 == 0, "timeout").alias("error"), F.when(k % 3 == 0, F.array(F.lit(3), F.lit(1))).otherwise(F.array(F.lit(3), F.lit(2))).alias("eq_final_stages"), F.when(k % 2 == 0, F.array(F.array(F.lit("u2"), F.lit("u1")), F.array(F.lit("u1*u2")))).when(k % 7 != 0, F.array(F.array(F.lit("u1")), F.array(F.lit("u1*u2")))).alias("support_terms"))
    return E.gate_readout(rec, 150.0, [3, 1], [["u1", "u2"], ["u1*u2"]], ["system_id"])


def identity(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return E.check_identity(v.orders.select((F.col("o_custkey") % 25).alias("campaign"), F.when(F.col("o_custkey") % 25 > 5, "h0").otherwise(F.concat(F.lit("h"), (k % 2).cast("string"))).alias("git_hash"), F.lit("c0").alias("config_fingerprint"), F.lit("b0").alias("behaviour_fingerprint"), F.when((k % 997 == 0) & (F.col("o_custkey") % 2 == 0), "c9").otherwise("c0").alias("manifest_fingerprint")))


QUERIES = {
    "e01_build_manifest": (manifest, oracle("SELECT * FROM mf", **MAN)),
    "e02_manifest_order": (
        lambda v: E.manifest_order(manifest(v), records(v).select("system_id", (F.col("system_id") % 4 + 1).alias("dim")).distinct(), {1: 250.0, 2: 10440.0, 3: 63800.0, 4: 300.0}),
        oracle("SELECT manifest_index, dim, row_number() OVER (PARTITION BY dim ORDER BY manifest_index) AS by_dim, row_number() OVER (ORDER BY CASE dim WHEN 1 THEN 250 WHEN 2 THEN 10440 WHEN 3 THEN 63800 ELSE 300 END DESC, manifest_index) AS by_cost FROM (SELECT *, system_id % 4 + 1 AS dim FROM mf) q", **MAN),
    ),
    "e03_remaining_cells": (
        lambda v: E.remaining_cells(manifest(v), records(v), "f1"),
        oracle(f"SELECT * FROM mf WHERE NOT EXISTS (SELECT 1 FROM rc WHERE {OK} AND config_fingerprint = 'f1' AND rc.variant = mf.variant AND rc.system_id = mf.system_id AND coalesce(rc.initial_condition_set, 1) = mf.initial_condition_set AND rc.seed = mf.seed)", **MAN, rc=REC_SQL),
    ),
    "e04_build_registry": (lambda v: E.build_registry(*folders(v)), oracle(REG, fo=FOLD)),
    "e05_registry_counts": (
        lambda v: E.registry_counts(E.build_registry(*folders(v))),
        oracle("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (inferred_status = '{k}') AS {k}" for k in ("finished", "failed", "interrupted", "never_started", "corrupted")) + " FROM rg", fo=FOLD, rg=REG),
    ),
    "e06_merge_records": (lambda v: merging(v)[0].select("manifest_index", "variant", "system_id", "initial_condition_set", "seed", "config_fingerprint"), oracle(f"SELECT manifest_index, {K5} FROM mg WHERE added", **MRG)),
    "e06_merge_counts": (lambda v: merging(v)[1], oracle("SELECT count(*) AS considered, count(*) FILTER (added) AS added, count(*) FILTER (ok AND NOT added) AS skipped_duplicates, count(*) FILTER (NOT ok) AS skipped_failed FROM mg", **MRG)),
    "e07_history_to_registry": (
        lambda v: E.history_to_registry(records(v)).select("run_id", "phase", "system_dim", "status", "success", "failure_reason", "exact_support_match", "metrics_available"),
        oracle(f"SELECT concat_ws('_', manifest_index, variant, system_id, initial_condition_set, seed) AS run_id, 'B' AS phase, CASE WHEN manifest_index % 5 > 1 THEN manifest_index % 4 + 1 WHEN manifest_index % 5 = 1 THEN 2 END AS system_dim, CASE WHEN {OK} THEN 'finished' ELSE 'failed' END AS status, {OK} AS success, CASE WHEN NOT {OK} THEN error END AS failure_reason, CASE WHEN representability <> 'surrogate' THEN pruned_match END AS exact_support_match, {OK} AS metrics_available FROM rc", rc=REC_SQL),
    ),
    "e08_normalize_registry": (
        lambda v: E.normalize_registry(raw_registry(v)),
        oracle("SELECT run_id, variant AS variant_slug, system_id, CASE lower(trim(exact_support_match)) WHEN 'true' THEN true WHEN '1.0' THEN true WHEN '0' THEN false WHEN 'no' THEN false END AS exact_support_match, try_cast(loss AS DOUBLE) AS loss FROM rw", rw=RAW),
    ),
    "e09_reindex": (
        lambda v: E.reindex(cells(v).select("variant_slug", "system_id", "n_seeds"), one(v.run_registry, "variant_slug"), one(v.run_registry, "system_id"), {"n_seeds": 0}),
        oracle("SELECT a.variant_slug, b.system_id, coalesce(n_seeds, 0) AS n_seeds FROM (SELECT DISTINCT variant_slug FROM run_registry) a CROSS JOIN (SELECT DISTINCT system_id FROM run_registry) b LEFT JOIN cells c ON c.variant_slug = a.variant_slug AND c.system_id = b.system_id", "run_registry", **CELL),
    ),
    "e10_ordered_variants": (
        lambda v: E.ordered_variants(v.run_registry, ["v3", "v9", "v1"]),
        oracle("SELECT variant_slug, row_number() OVER (ORDER BY CASE variant_slug WHEN 'v3' THEN 1 WHEN 'v1' THEN 3 ELSE 9 END, variant_slug) AS pos FROM (SELECT DISTINCT variant_slug FROM run_registry) q", "run_registry"),
    ),
    "e11_split_by_class": (
        lambda v: E.split_by_class(cells(v).where("system_id <> 10"), classes(v)).select("variant_slug", "system_id", "cls"),
        oracle("SELECT variant_slug, system_id, CASE WHEN system_id % 3 = 0 THEN 'surrogate' ELSE 'exact' END AS cls FROM cells WHERE system_id <> 10", "run_registry", **CELL),
    ),
    "e11_class_coverage": (lambda v: E.class_coverage(cells(v), classes(v)), oracle("SELECT DISTINCT system_id, 'unclassified' AS problem FROM cells WHERE system_id = 10", "run_registry", **CELL)),
    "e12_split_by_support": (
        lambda v: E.split_by_support(cells(v).withColumn("exact_match_rate", F.when(F.col("system_id") % 4 == 0, None).otherwise(F.col("exact_match_rate")))).select("variant_slug", "system_id", "cls"),
        oracle("SELECT variant_slug, system_id, CASE WHEN bool_or(system_id % 4 <> 0 AND exact_match_rate IS NOT NULL) OVER (PARTITION BY system_id) THEN 'exact' ELSE 'surrogate' END AS cls FROM cells", "run_registry", **CELL),
    ),
    "e13_main_results": (
        lambda v: r(E.main_results(E.split_by_class(cells(v), classes(v), False), ["v3", "v1"]), n=8),
        oracle("SELECT block, row_number() OVER (PARTITION BY block ORDER BY system_id, pos) AS row, system_id, variant_slug, round(mean_loss, 8) AS mean_loss, round(exact_match_rate, 8) AS exact_match_rate, CASE WHEN block = 2 THEN round(mean_r2, 8) END AS mean_r2 FROM (SELECT *, CASE WHEN system_id % 3 = 0 THEN 2 ELSE 1 END AS block, CASE variant_slug WHEN 'v3' THEN '0' WHEN 'v1' THEN '1' ELSE variant_slug END AS pos FROM cells WHERE system_id <> 10) q", "run_registry", **CELL),
    ),
    "e14_format_cells": (
        lambda v: E.format_cells(E.reindex(cells(v), one(v.run_registry, "variant_slug"), one(v.run_registry, "system_id"))),
        oracle(f"SELECT a.variant_slug, b.system_id, CASE WHEN coalesce(n_valid, 0) = 0 THEN '--' ELSE {SCI.format(x='mean_loss')} || CASE WHEN std_loss IS NOT NULL THEN ' +- ' || {SCI.format(x='std_loss')} ELSE '' END || '; EM: ' || CASE WHEN exact_match_rate IS NULL THEN '--' ELSE CAST(round_even(exact_match_rate * 100, 0) AS INT) || '%' END END AS cell FROM (SELECT DISTINCT variant_slug FROM run_registry) a CROSS JOIN (SELECT DISTINCT system_id FROM run_registry) b LEFT JOIN cells c ON c.variant_slug = a.variant_slug AND c.system_id = b.system_id", "run_registry", **CELL),
    ),
    "e15_audit_pairs": (
        # every customer's orders by the remainder of their numbers: some remainders are missing, some repeated
        lambda v: E.audit_pairs(*[v.orders.select(F.col("o_custkey").alias("system_id"), (F.col("o_orderkey") % 4).alias("initial_condition_set"))] * 3),
        oracle("SELECT s AS system_id, i AS initial_condition_set, CASE WHEN n = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM (SELECT s, i, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_custkey AS s FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderkey % 4 AS i FROM orders) b LEFT JOIN orders o ON o.o_custkey = s AND o.o_orderkey % 4 = i GROUP BY ALL) q WHERE n <> 1"),
    ),
    "e16_check_identity": (
        identity,
        oracle("SELECT campaign, n_hashes, 1 AS n_configs, 1 AS n_behaviours, n_mismatched, n_hashes <= 1 AND n_mismatched = 0 AS ok FROM (SELECT o_custkey % 25 AS campaign, count(DISTINCT CASE WHEN o_custkey % 25 > 5 THEN 'h0' ELSE 'h' || o_orderkey % 2 END) AS n_hashes, count(*) FILTER (o_orderkey % 997 = 0 AND o_custkey % 2 = 0) AS n_mismatched FROM orders GROUP BY 1) q"),
    ),
    "e17_gate_readout": (
        readout,
        oracle("SELECT system_id, CASE WHEN k % 3 = 0 THEN 'REPORTABLE' ELSE 'IMPLEMENTATION_CHECK_FAILED' END AS verdict, k % 2 = 0 AS du1_exact, true AS du2_exact, CASE WHEN l < 150 THEN 'better' WHEN l = 150 THEN 'equal' ELSE 'worse' END AS loss_vs_anchor FROM (SELECT o_custkey % 20 AS system_id, max(o_orderkey) AS k, max_by(o_totalprice / 1000, o_orderkey) AS l FROM orders WHERE o_orderkey % 13 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0) GROUP BY 1) q"),
    ),
    "e18_diff_frozen": (
        lambda v: E.diff_frozen(v.customer.select("c_custkey", "c_mktsegment", F.lit("now").alias("at")), v.customer.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit("then").alias("at")), ["at"]),
        oracle("SELECT c_custkey, c_mktsegment, 'new' AS side FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT c_custkey, 'X', 'frozen' FROM customer WHERE c_custkey % 50 = 0"),
    ),
    "e19_validate_inputs": (
        lambda v: E.validate_inputs(cells(v).withColumn("n_valid", F.when(F.col("system_id") == 2, 0).otherwise(F.col("n_valid"))), v.spark.createDataFrame([("v1",), ("v8",)], "variant_slug string"), v.spark.createDataFrame([(1,), (77,)], "system_id int")),
        oracle("SELECT 'missing_variant' AS kind, 'v8' AS what UNION ALL SELECT 'missing_system', '77' UNION ALL SELECT 'no_valid_runs', variant_slug || '/' || system_id FROM cells WHERE system_id = 2", "run_registry", **CELL),
    ),
    "e20_infer_seed": (
        lambda v: E.infer_seed(v.run_registry.select("variant_slug", "system_id", F.col("run_id").alias("line_no"), F.when(F.col("run_id") % 3 == 0, F.col("seed").cast("int")).alias("seed")), [42, 43, 44]),
        oracle("SELECT variant_slug, system_id, run_id AS line_no, CASE WHEN run_id % 3 = 0 THEN seed ELSE 42 + (row_number() OVER (PARTITION BY variant_slug, system_id ORDER BY run_id) - 1) % 3 END AS seed FROM run_registry", "run_registry"),
    ),
}
