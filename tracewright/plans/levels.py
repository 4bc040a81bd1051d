"""Queries over level histories and evaluation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import levels as L

from .derivatives import r
from .views import oracle

MARK = {
    "m0": "SELECT *, min(best_loss) OVER (PARTITION BY cell ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM level_events",
    "m1": "SELECT *, prev IS NULL OR best_loss < prev AS improved FROM m0",
    "m2": "SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY level) AS island FROM m1",
    "m": "SELECT *, row_number() OVER (PARTITION BY cell, island ORDER BY level) - 1 AS silent FROM m2",
    "b": "SELECT *, lag(silent) OVER (PARTITION BY cell ORDER BY level) AS sb FROM m",
}
REPLAY = MARK | {
    "x": "SELECT m.*, k FROM m, (VALUES (3), (5), (8)) v(k)", "st": "SELECT cell, k, min(level) AS lv FROM x WHERE silent >= k GROUP BY cell, k",
    "en": "SELECT cell, max(level) AS el, max_by(us, level) AS eu FROM m GROUP BY cell",
    "rp": "SELECT en.cell, k.k, coalesce(lv, el) AS abort_level, el - coalesce(lv, el) AS saved_levels, (eu - coalesce((SELECT us FROM m WHERE m.cell = en.cell AND m.level = lv), eu)) / 1e6 AS saved_s, (SELECT count(*) FROM m WHERE m.cell = en.cell AND improved AND level > lv) AS n_missed FROM en CROSS JOIN (VALUES (3), (5), (8)) k(k) LEFT JOIN st ON st.cell = en.cell AND st.k = k.k",
}
BUDGETS = [50, 200, 1000]
FIN = "isfinite(loss)"


def _files(v):
    g = v.level_events.groupBy("cell").agg(F.count_if(F.col("best_loss") > 150).alias("malformed"))
    return g.select((F.col("cell") % 6).alias("source"), "cell", "malformed"), v.level_events.where("best_loss < 2").select("cell")


def _identity(v):
    lv = v.level_events.select("cell", "level", F.concat(F.lit("v"), (F.col("cell") % 3).cast("string"), F.when(F.col("cell") % 2 == 0, "_pretune").otherwise("_nopretune")).alias("variant"), "pretune")
    rec = v.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cell"), F.when(F.col("c_custkey") % 2 == 0, "rec").alias("variant"), F.when(F.col("c_custkey") % 9 == 0, "on").alias("condition"), F.when(F.col("c_custkey") % 6 == 0, F.col("c_custkey") % 4 == 0).alias("flag"))
    return L.cell_identity(lv, rec)


QUERIES = {
    "w01_improvements": (
        lambda v: r(L.improvements(v.level_events), "old_best", "new_best"),
        oracle("SELECT cell, level, stage, prev AS old_best, best_loss AS new_best, round(prev - best_loss, 6) + 0e0 AS abs_drop, round(CASE WHEN prev <> 0 THEN (prev - best_loss) / abs(prev) END, 6) + 0e0 AS rel_drop, sb AS silent_before FROM b WHERE improved AND prev IS NOT NULL", "level_events", **MARK),
    ),
    "w02_tail_metrics": (
        lambda v: L.tail_metrics(v.level_events),
        oracle("SELECT cell, max(level) AS total_levels, max(level) FILTER (improved) AS last_improvement, max(level) FILTER (improved AND (prev IS NULL OR (prev <> 0 AND (prev - best_loss) / abs(prev) >= 0.001e0))) AS last_promille, coalesce(max(sb) FILTER (improved AND prev IS NOT NULL), 0) AS longest_pause FROM b GROUP BY cell", "level_events", **MARK),
    ),
    "w03_silent_tail": (
        lambda v: r(L.silent_tail(v.level_events)),
        oracle("SELECT cell, tl AS total_levels, tl - last AS silent_tail_levels, round(greatest((eu - au) / 1e6, 0), 6) AS silent_tail_s, round(greatest((eu - fu) / 1e6, 0), 6) AS total_s, round(CASE WHEN eu > fu THEN greatest((eu - au) / 1e6, 0) / ((eu - fu) / 1e6) END, 6) AS silent_tail_share FROM (SELECT cell, max(level) AS tl, max(level) FILTER (improved) AS last, max_by(us, level) FILTER (improved) AS au, max_by(us, level) AS eu, min_by(us, level) AS fu FROM m GROUP BY cell) q", "level_events", **MARK),
    ),
    "w04_early_stop_replay": (
        lambda v: r(L.early_stop_replay(v.level_events)),
        oracle("SELECT cell, k, abort_level, saved_levels, round(saved_s, 6) AS saved_s, n_missed > 0 AS missed, n_missed FROM rp", "level_events", **REPLAY),
    ),
    "w05_savings_summary": (
        lambda v: r(L.savings_summary(L.early_stop_replay(v.level_events))),
        oracle("SELECT k, sum(saved_levels) AS saved_levels, round(sum(saved_s), 6) AS saved_s, count(*) FILTER (n_missed > 0) AS missed_cells FROM rp GROUP BY k", "level_events", **REPLAY),
    ),
    "w06_source_coverage": (
        lambda v: L.source_coverage(*_files(v)),
        oracle("SELECT cell % 6 AS source, count(*) AS files, count(*) FILTER (h) AS records_read, count(*) FILTER (NOT h) AS records_missing, sum(mal) AS malformed FROM (SELECT cell, bool_or(best_loss < 2) AS h, count(*) FILTER (best_loss > 150) AS mal FROM level_events GROUP BY cell) q GROUP BY 1", "level_events"),
    ),
    "w07_cell_identity": (
        _identity,
        oracle("SELECT cell, vr AS variant, CASE WHEN c_custkey IS NOT NULL AND cell % 9 = 0 THEN 'on' WHEN c_custkey IS NOT NULL AND cell % 6 = 0 THEN CASE WHEN cell % 4 = 0 THEN 'on' ELSE 'off' END WHEN vr LIKE '%nopretune%' THEN 'off' WHEN vr LIKE '%pretune%' THEN 'on' ELSE pt END AS pretune FROM (SELECT cell, c_custkey, CASE WHEN c_custkey IS NOT NULL AND cell % 2 = 0 THEN 'rec' ELSE 'v' || cell % 3 || CASE WHEN cell % 2 = 0 THEN '_pretune' ELSE '_nopretune' END END AS vr, pt FROM (SELECT cell, min(pretune) AS pt FROM level_events GROUP BY cell) g LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON c_custkey = cell) q", "level_events"),
    ),
    "w08_budget_replay": (
        lambda v: r(L.budget_replay(v.evaluations, BUDGETS)),
        oracle("SELECT fit_id, budget, total, would_stop, round(final, 6) AS final_loss, round(rep, 6) AS replay_loss, round(CASE WHEN isfinite(final) AND final > 0 THEN rep / final ELSE 'Infinity'::DOUBLE END, 6) AS factor, rep = final AS identical FROM (SELECT *, CASE WHEN would_stop THEN upto ELSE final END AS rep FROM (SELECT fit_id, budget, count(*) AS total, count(*) > budget AS would_stop, min(loss) AS final, coalesce(min(loss) FILTER (i <= budget), 'Infinity'::DOUBLE) AS upto FROM evaluations, (VALUES (50), (200), (1000)) b(budget) GROUP BY fit_id, budget) q) z", "evaluations"),
    ),
    "w09_evaluation_summary": (
        lambda v: L.evaluation_summary(v.evaluations),
        oracle("SELECT a.fit_id, total, sentinels, finite_losses, nonfinite, distinct_losses, coalesce(sentinel_runs, 0) AS sentinel_runs, coalesce(longest_run, 0) AS longest_run, run_p50, run_p90 FROM a LEFT JOIN q ON a.fit_id = q.fit_id", "evaluations",
               e="SELECT *, loss >= 1e6 AS s FROM evaluations", i="SELECT *, row_number() OVER (PARTITION BY fit_id ORDER BY i) - row_number() OVER (PARTITION BY fit_id, s ORDER BY i) AS island FROM e",
               rn="SELECT fit_id, island, count(*) AS len FROM i WHERE s GROUP BY fit_id, island", q="SELECT fit_id, count(*) AS sentinel_runs, max(len) AS longest_run, quantile_disc(len, 0.5) AS run_p50, quantile_disc(len, 0.9) AS run_p90 FROM rn GROUP BY fit_id",
               a="SELECT fit_id, count(*) AS total, count(*) FILTER (s) AS sentinels, count(*) FILTER (NOT s) AS finite_losses, 0 AS nonfinite, count(DISTINCT loss) AS distinct_losses FROM e GROUP BY fit_id"),
    ),
    "w09_ends_of_log": (
        lambda v: L.ends_of_log(v.evaluations),
        oracle("SELECT a.fit_id, a.rn AS pos, a.loss AS loss_first, b.loss AS loss_last FROM x a JOIN x b ON a.fit_id = b.fit_id AND a.rn = b.rd WHERE a.rn <= 10", "evaluations", x="SELECT *, row_number() OVER (PARTITION BY fit_id ORDER BY i) AS rn, row_number() OVER (PARTITION BY fit_id ORDER BY i DESC) AS rd FROM evaluations"),
    ),
    "w10_budget_curve": (
        lambda v: r(L.budget_curve(v.evaluations, BUDGETS)),
        oracle("SELECT fit_id, round(best, 6) AS best_loss, first_index, round(first_index / n, 6) AS first_fraction, " + ", ".join(f"round(loss_{b}, 6) AS loss_{b}, round(CASE WHEN best > 0 THEN loss_{b} / best ELSE 'Infinity'::DOUBLE END, 6) AS factor_{b}" for b in BUDGETS) + " FROM g", "evaluations",
               e="SELECT *, min(loss) OVER (PARTITION BY fit_id) AS best FROM evaluations", g="SELECT fit_id, count(*) AS n, min(best) AS best, min(i) FILTER (loss = best) AS first_index, " + ", ".join(f"coalesce(min(loss) FILTER (i <= {b}), 'Infinity'::DOUBLE) AS loss_{b}" for b in BUDGETS) + " FROM e GROUP BY fit_id"),
    ),
    "t04_stuck_cells": (
        lambda v: L.stuck_cells(v.level_events, F.lit(1706745600000000), v.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("cell"))),
        oracle("SELECT cell, age_s, age_s > 7200 AS stuck, age_s <= 5400 AS active FROM (SELECT cell, (1706745600000000 - max(us)) / 1e6 AS age_s FROM level_events WHERE cell NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY cell) q", "level_events"),
    ),
    "t05_progress_eta": (
        lambda v: r(L.progress_eta(v.level_events.select(F.col("dim").alias("grp"), "us", F.concat_ws("-", F.col("cell").cast("string"), F.col("level").cast("string")).alias("id")), 50000)),
        oracle("SELECT grp, done, greatest(50000 - done, 0) AS remaining, round(CASE WHEN m >= 2 THEN (hi - lo) / 1e6 / (m - 1) END, 6) AS mean_gap_s, round(CASE WHEN m >= 2 THEN (hi - lo) / 1e6 / (m - 1) END * greatest(50000 - done, 0), 6) AS eta_s FROM (SELECT dim AS grp, max(n) AS done, count(*) AS m, max(us) AS hi, min(us) AS lo FROM (SELECT *, count(*) OVER (PARTITION BY dim) AS n, row_number() OVER (PARTITION BY dim ORDER BY us DESC, cell || '-' || level DESC) AS rn FROM level_events) x WHERE rn <= 20 GROUP BY dim) q", "level_events"),
    ),
    "t05_progress_eta_flat": (
        lambda v: r(L.progress_eta_flat(v.run_registry.select(F.col("variant_slug").alias("grp"), F.col("run_id").alias("id"), "elapsed_s"), 50000), n=8),
        oracle("SELECT grp, done, greatest(50000 - done, 0) AS remaining, round(m, 8) AS mean_s, round(m * greatest(50000 - done, 0), 8) AS eta_s FROM (SELECT variant_slug AS grp, max(n) AS done, avg(elapsed_s) AS m FROM (SELECT *, count(*) OVER (PARTITION BY variant_slug) AS n, row_number() OVER (PARTITION BY variant_slug ORDER BY run_id DESC) AS rn FROM run_registry) x WHERE rn <= 20 GROUP BY 1) q", "run_registry"),
    ),
    "t06_level_rate": (
        lambda v: v.level_events.groupBy(F.floor(F.col("us") / 3600000000).alias("hour"), "dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("cells")),
        oracle("SELECT CAST(floor(us / 3600000000) AS BIGINT) AS hour, dim, count(*) AS n, count(DISTINCT cell) AS cells FROM level_events GROUP BY 1, 2", "level_events"),
    ),
}
