"""Queries that aggregate run registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A

from .derivatives import r
from .views import Views, oracle

MATCH = "CASE lower(exact_support_match) WHEN 'true' THEN 1e0 WHEN 'false' THEN 0e0 END"


def agg_sql(keys: str) -> str:
    m = lambda c: f"avg({c}) FILTER (loss IS NOT NULL)"
    return (
        f"SELECT {keys}, min(system_name) AS system_name, count(*) AS n_seeds, count(loss) AS n_valid, avg(loss) AS mean_loss, stddev_samp(loss) AS std_loss, {m(MATCH)} AS exact_match_rate, "
        f"{m('CASE WHEN final_stage >= 0 THEN final_stage END')} AS mean_final_stage, {m('stage_overshoot')} AS mean_stage_overshoot, {m('wasted_levels')} AS mean_wasted_levels, {m('elapsed_s')} AS mean_elapsed_s, "
        f"{m('total_invalid_evals')} AS mean_invalid_evals, {m('r2')} AS mean_r2, count(r2) FILTER (loss IS NOT NULL) AS n_r2 FROM run_registry GROUP BY {keys}"
    )


MEANS = ["mean_loss", "std_loss", "exact_match_rate", "mean_final_stage", "mean_stage_overshoot", "mean_wasted_levels", "mean_elapsed_s", "mean_invalid_evals", "mean_r2"]


def rounded(keys: str) -> str:
    return f"SELECT {keys}, system_name, n_seeds, n_valid, n_r2, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)} FROM ag"


AG = {"ag": agg_sql("variant_slug, system_id")}


def _cmp(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN abs({a} - {b}) <= greatest(1e-12 * greatest(abs({a}), abs({b})), 1e-12) THEN 'equal' WHEN {a} < {b} THEN 'lower' ELSE 'higher' END"


def _wide(metric: str, **names: str) -> str:
    return f"SELECT system_id, {', '.join(f'max(CASE WHEN variant_slug = {v!r} THEN {metric} END) AS {k}' for k, v in names.items())} FROM ag GROUP BY system_id"


H = AG | {
    "w1": _wide("mean_stage_overshoot", n="v3", o="v2", p="v1"),
    "h1": f"SELECT system_id, CASE WHEN a AND b THEN 'correct' WHEN a OR b THEN 'partial' ELSE 'wrong' END AS direction FROM (SELECT system_id, coalesce({_cmp('n', 'o')} = 'lower', false) AS a, coalesce({_cmp('n', 'p')} = 'lower', false) AS b FROM w1) q",
    "g2": "SELECT system_id, bool_and(coalesce(exact_match_rate = 0, false)) AS collapsed, min(mean_loss) FILTER (variant_slug <> 'v5') AS best, min_by(variant_slug, mean_loss) FILTER (variant_slug <> 'v5') AS bv, max(mean_loss) FILTER (variant_slug = 'v5') AS bl, max(exact_match_rate) FILTER (variant_slug = 'v5') AS br, max(exact_match_rate) FILTER (variant_slug = 'v3') AS nr FROM ag GROUP BY system_id",
    "h2": "SELECT system_id, collapsed, CASE WHEN collapsed THEN bv END AS best_variant, coalesce(CASE WHEN collapsed THEN best <= bl ELSE nr >= br END, false) AS competitive FROM g2",
    "w3": _wide("mean_wasted_levels", n="v3", o="v2", p="v1"),
    "h3": f"SELECT system_id, CASE WHEN a AND b THEN 'correct' WHEN a OR b THEN 'partial' ELSE 'wrong' END AS direction, tie FROM (SELECT system_id, coalesce({_cmp('n', 'o')} IN ('lower', 'equal'), false) AS a, coalesce({_cmp('n', 'p')} IN ('lower', 'equal'), false) AS b, coalesce({_cmp('n', 'o')} = 'equal', false) OR coalesce({_cmp('n', 'p')} = 'equal', false) AS tie FROM w3) q",
    "w4": _wide("exact_match_rate", h="v3", s="v2", p="v1"),
    "h4": "SELECT system_id, coalesce(h >= s AND s >= p, false) AS expected_order, coalesce(p >= s AND s >= h AND p > h, false) AS reverse_order, coalesce(h = 0 AND s = 0 AND p = 0, false) AS all_zero FROM w4",
}
VARS = ["v1", "v2", "v3", "v4", "v5"]


def _h(v):
    a = A.aggregate_runs(v.run_registry)
    return A.hypothesis_h1(a, "v3", "v2", "v1"), A.hypothesis_h2(a, "v3", "v5", VARS), A.hypothesis_h3(a, "v3", "v2", "v1"), A.hypothesis_h4(a, "v3", "v2", "v1")


def _diag(v):
    reg = v.run_registry.where("final_stage >= 0")
    return A.diagnose_support(reg.select("variant_slug", "system_id", (F.col("final_stage") == F.col("expected_stage")).alias("raw"), (F.col("final_stage") >= F.col("expected_stage")).alias("pruned")))


def _gen(v):
    return A.generalization_summary(v.run_registry.select("system_id", "variant_slug", "seed", F.col("loss").alias("refit_loss"), (F.col("elapsed_s") / 100).alias("fresh_loss"), F.when(F.col("r2").isNotNull(), F.col("loss") / (F.col("final_stage") + 2) / 4).alias("train_loss")))


GEN = "SELECT system_id, variant_slug, seed, count(*) AS n, avg(loss) AS mr, min(loss) AS mn, max(loss) AS mx, avg(elapsed_s / 100) AS mf, count(*) FILTER (loss IS NOT NULL AND r2 IS NOT NULL AND loss < 10 * (loss / (final_stage + 2) / 4)) AS ok FROM run_registry GROUP BY ALL"
CELLS = "SELECT cell, max(level) AS levels, min(best_loss) AS best, any_value(dim) AS dim, any_value(representability) AS rep, any_value(pretune) AS pretune FROM level_events GROUP BY cell"
COST = "SELECT stage, level, best_loss / 97 AS cost, level % 7 AS solves FROM level_events"


def _levels(v):
    return v.level_events.select("stage", "level", (F.col("best_loss") / 97).alias("cost"), (F.col("level") % 7).alias("solves"))


def _cost_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS n, round(avg(cost), 9) AS mean_cost, round(quantile_cont(cost, 0.5), 9) AS median_cost, round(sum(cost), 9) AS total_cost, round(sum(cost) / (SELECT sum(cost) FROM c WHERE level > 1), 9) AS share, round(CASE WHEN sum(solves) > 0 THEN 1000 * sum(cost) / sum(solves) END, 7) AS ms_per_solve FROM c WHERE level > 1 GROUP BY {key}"


def _costs(v, key):
    return A.level_costs(_levels(v), [key]).select(key, "n", *[F.round(c, n).alias(c) for c, n in (("mean_cost", 9), ("median_cost", 9), ("total_cost", 9), ("share", 9), ("ms_per_solve", 7))])


SUPPORTS = {
    "st": "SELECT variant_slug, system_id, seed, run_id % 97 AS ic, eq, term, coef FROM structure_terms JOIN run_registry USING (run_id)",
    "sm": "SELECT *, max(abs(coef)) OVER (PARTITION BY variant_slug, system_id, seed, ic, eq) AS top FROM st",
    "sk": "SELECT variant_slug, system_id, seed, ic, list_sort(list(DISTINCT eq * 100 + term)) AS s FROM sm WHERE abs(coef) >= greatest(1e-6, 0.9e0 * top) GROUP BY ALL",
}


def _supports(v: Views) -> DataFrame:
    """Terms of the runs by variant and cell."""
    return v.structure_terms.join(v.run_registry.select("run_id", "variant_slug", "system_id", "seed", (F.col("run_id") % 97).alias("ic")), "run_id")


QUERIES = {
    "g01_aggregate_runs": (lambda v: r(A.aggregate_runs(v.run_registry)), oracle(rounded("variant_slug, system_id"), "run_registry", **AG)),
    "g01_aggregate_runs_ic": (lambda v: r(A.aggregate_runs(v.run_registry, True)), oracle(rounded("variant_slug, system_id, initial_condition_set"), "run_registry", ag=agg_sql("variant_slug, system_id, initial_condition_set"))),
    "g02_aggregate_benchmark": (
        lambda v: r(A.aggregate_benchmark(v.run_registry, "run_id"), n=9),
        oracle("SELECT variant_slug, system_id, min_by(system_name, run_id) AS system_name, min_by(expected_stage, run_id) AS expected_stage, count(*) AS n, round(avg(loss), 9) AS mean_loss, round(min(loss), 9) AS min_loss, round(max(loss), 9) AS max_loss FROM run_registry GROUP BY 1, 2", "run_registry"),
    ),
    "g03_recovery_label": (
        lambda v: v.run_registry.select("run_id", A.recovery_label(A.as_bool(F.col("exact_support_match")), F.col("loss"), F.col("final_stage") == F.col("expected_stage"), 0.8, 2.0).alias("label")),
        oracle("SELECT run_id, CASE WHEN lower(exact_support_match) = 'true' THEN 'exact_recovery' WHEN loss <= 0.8 THEN 'surrogate_fit' WHEN loss <= 2.0 AND final_stage = expected_stage THEN 'meaningful_surrogate' ELSE 'weak_surrogate' END AS label FROM run_registry", "run_registry"),
    ),
    "g04_diagnose_support": (
        lambda v: A.diagnosis_summary(_diag(v), ["system_id", "variant_slug"]),
        oracle("SELECT system_id, variant_slug, count(*) FILTER (a AND b) AS correct, count(*) FILTER (NOT a AND b) AS metric_artifact, count(*) FILTER (NOT a AND NOT b) AS genuine_failure, count(*) FILTER (a AND NOT b) AS unexpected FROM (SELECT *, final_stage = expected_stage AS a, final_stage >= expected_stage AS b FROM run_registry WHERE final_stage >= 0) q GROUP BY 1, 2", "run_registry"),
    ),
    "g05_hypothesis_h1": (lambda v: _h(v)[0], oracle("SELECT * FROM h1", "run_registry", **H)),
    "g06_hypothesis_h2": (lambda v: _h(v)[1], oracle("SELECT * FROM h2", "run_registry", **H)),
    "g07_hypothesis_h3": (lambda v: _h(v)[2], oracle("SELECT * FROM h3", "run_registry", **H)),
    "g08_hypothesis_h4": (lambda v: _h(v)[3], oracle("SELECT * FROM h4", "run_registry", **H)),
    "g08_verdicts": (
        lambda v: A.verdicts(*_h(v)),
        oracle("SELECT 'H1' AS hypothesis, n, CASE WHEN n >= 4 THEN 'SUPPORTED' WHEN n >= 1 THEN 'PARTIAL' ELSE 'FALSIFIED' END AS verdict FROM (SELECT count(*) FILTER (direction = 'correct') AS n FROM h1) a UNION ALL SELECT 'H2', n, CASE WHEN n >= 5 THEN 'SUPPORTED' WHEN n >= 2 THEN 'PARTIAL' ELSE 'FALSIFIED' END FROM (SELECT count(*) FILTER (competitive) AS n FROM h2) b UNION ALL SELECT 'H3', n, CASE WHEN n >= 4 THEN 'SUPPORTED' WHEN n >= 1 THEN 'PARTIAL' ELSE 'FALSIFIED' END FROM (SELECT count(*) FILTER (direction = 'correct') AS n FROM h3) c UNION ALL SELECT 'H4', n, CASE WHEN z THEN 'VACUOUS' WHEN n >= 3 THEN 'SUPPORTED' WHEN rv >= 3 THEN 'FALSIFIED' ELSE 'AMBIGUOUS' END FROM (SELECT count(*) FILTER (expected_order) AS n, count(*) FILTER (reverse_order) AS rv, bool_and(all_zero) AS z FROM h4) d", "run_registry", **H),
    ),
    "g09_generalization_verdict": (
        lambda v: A.generalization_verdict(A.generalization_summary(v.run_registry.select("system_id", "variant_slug", "seed", F.col("loss").alias("refit_loss"), (F.col("elapsed_s") / 100).alias("fresh_loss"), F.lit(1.0).alias("train_loss"))).withColumnRenamed("n", "n_exact_runs"), 40),
        oracle("SELECT eligible, refit_better, CASE WHEN eligible = 0 THEN 'OMIT' WHEN refit_better >= ceil(eligible / 2) THEN 'INCLUDE_SUPPLEMENTARY' ELSE 'INCLUDE_WITH_CAUTION' END AS verdict FROM (SELECT count(*) AS eligible, count(*) FILTER (mr <= mf) AS refit_better FROM ge WHERE n >= 40) q", "run_registry", ge=GEN),
    ),
    "g10_generalization_summary": (lambda v: r(_gen(v), n=9), oracle("SELECT system_id, variant_slug, seed, n, round(mr, 9) AS mean_refit_loss, round(mn, 9) AS min_refit_loss, round(mx, 9) AS max_refit_loss, round(mf, 9) AS mean_fresh_loss, ok AS refit_success FROM ge", "run_registry", ge=GEN)),
    "g11_distribution": (
        lambda v: r(A.distribution(v.run_registry, "r2", ["system_id"]), n=10),
        oracle("SELECT system_id, count(r2) AS n, round(min(r2), 10) AS min, round(quantile_cont(r2, 0.25), 10) AS q25, round(quantile_cont(r2, 0.5), 10) AS median, round(avg(r2), 10) AS mean, round(quantile_cont(r2, 0.75), 10) AS q75, round(max(r2), 10) AS max FROM run_registry GROUP BY 1", "run_registry"),
    ),
    "g12_quantiles_nearest": (
        lambda v: A.quantiles_nearest(v.run_registry, "elapsed_s", ["variant_slug"]),
        oracle("SELECT variant_slug, quantile_disc(elapsed_s, 0.5) AS p50, quantile_disc(elapsed_s, 0.9) AS p90, quantile_disc(elapsed_s, 0.99) AS p99 FROM run_registry GROUP BY 1", "run_registry"),
    ),
    # the same through passes, as for groups that no task may hold
    "g11_distribution_selected": (
        lambda v: r(A.distribution(v.run_registry, "r2", ["system_id"], hot=100), n=10),
        oracle("SELECT system_id, count(r2) AS n, round(min(r2), 10) AS min, round(quantile_cont(r2, 0.25), 10) AS q25, round(quantile_cont(r2, 0.5), 10) AS median, round(avg(r2), 10) AS mean, round(quantile_cont(r2, 0.75), 10) AS q75, round(max(r2), 10) AS max FROM run_registry GROUP BY 1", "run_registry"),
    ),
    "g12_quantiles_selected": (
        lambda v: A.quantiles_nearest(v.run_registry, "elapsed_s", ["variant_slug"], hot=100),
        oracle("SELECT variant_slug, quantile_disc(elapsed_s, 0.5) AS p50, quantile_disc(elapsed_s, 0.9) AS p90, quantile_disc(elapsed_s, 0.99) AS p99 FROM run_registry GROUP BY 1", "run_registry"),
    ),
    "g13_suspicious_cells": (
        lambda v: A.suspicious_cells(v.run_registry, A.as_bool(F.col("exact_support_match")), 0.8).select("run_id", "variant_slug", "system_id", "r2"),
        oracle("SELECT run_id, variant_slug, system_id, r2 FROM run_registry WHERE exact_support_match = 'True' AND (r2 IS NULL OR r2 < 0.8)", "run_registry"),
    ),
    "g14_breakdowns": (
        lambda v: r(A.breakdowns(v.level_events.groupBy("cell").agg(F.max("level").alias("levels"), F.min("best_loss").alias("best"), F.first("dim").alias("dim"), F.first("representability").alias("rep"), F.first("pretune").alias("pretune")), ["dim", "rep", "pretune"], ["levels", "best"])),
        oracle("SELECT CASE WHEN dim IS NOT NULL THEN 'dim' WHEN rep IS NOT NULL THEN 'rep' ELSE 'pretune' END AS split, coalesce(CAST(dim AS VARCHAR), rep, pretune) AS value, count(*) AS n_cells, round(avg(levels), 6) AS mean_levels, round(avg(best), 6) AS mean_best FROM c GROUP BY GROUPING SETS ((dim), (rep), (pretune))", "level_events", c=CELLS),
    ),
    "g15_level_costs": (lambda v: _costs(v, "level"), oracle(_cost_sql("level"), "level_events", c=COST)),
    "g15_stage_costs": (lambda v: _costs(v, "stage"), oracle(_cost_sql("stage"), "level_events", c=COST)),
    "g16_compare_variants": (
        lambda v: r(A.compare_variants(v.run_registry, "v1", "v2")),
        oracle("SELECT a.system_id, round(CASE WHEN b.t > 0 THEN a.t / b.t END, 6) AS runtime_ratio, a.s = b.s AS same_support FROM (SELECT system_id, sum(elapsed_s) AS t, list_sort(list(DISTINCT final_stage)) AS s FROM run_registry WHERE variant_slug = 'v1' GROUP BY 1) a JOIN (SELECT system_id, sum(elapsed_s) AS t, list_sort(list(DISTINCT final_stage)) AS s FROM run_registry WHERE variant_slug = 'v2' GROUP BY 1) b USING (system_id)", "run_registry"),
    ),
    "g16_same_pruned_support": (
        lambda v: A.same_pruned_support(_supports(v), "v1", "v2", ["system_id", "seed", "ic"], relative=0.9),
        oracle(
            "SELECT system_id, count(*) AS cells, count(*) FILTER (a.s = b.s) AS same_cells, bool_and(a.s = b.s) AS same_support FROM (SELECT * FROM sk WHERE variant_slug = 'v1') a JOIN (SELECT * FROM sk WHERE variant_slug = 'v2') b USING (system_id, seed, ic) GROUP BY 1",
            "run_registry", "structure_terms", **SUPPORTS),
    ),
}
