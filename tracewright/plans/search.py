"""Queries of the batched structure search."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import search as S
from tracewright.operators import stagecaps as C
from tracewright.operators import terms as T
from tracewright.operators.discover import discover, evolutionary

from .derivatives import EV, r
from .regression import B2, SCREEN, P, factors, prepared, structures
from .views import Views, oracle

POL = S.SearchPolicy(window=2, min_levels=4, max_levels=60, loss_tol=1.0, plateau_tol=0.5, min_per_stage=2)
#: The search ends when every series has stopped in the last stage; the bound on levels is far above that.
GROW = S.SearchPolicy(max_levels=60)
ROWS = "SELECT *, cand_id = parent_id AS incumbent, cand_id % 13 <> 0 AS valid, CASE WHEN cand_id % 13 <> 0 THEN residual + 1e-12 * n_params ELSE 'Infinity'::DOUBLE END AS score FROM candidates"
RANKED = {"a": ROWS, "k": "SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY incumbent DESC, valid DESC, score, cand_id) AS rn FROM (SELECT * EXCLUDE (incumbent), cand_id % 50 = 0 AS incumbent FROM a) q"}
HIST = "SELECT cell AS traj_id, level, stage, min(best_loss) OVER (PARTITION BY cell ORDER BY level) AS best, best_loss AS loss FROM level_events"


def rows(v: Views) -> DataFrame:
    ok = F.col("cand_id") % 13 != 0
    return v.candidates.select("*", (F.col("cand_id") % 50 == 0).alias("incumbent"), ok.alias("valid"), S.score(F.col("residual"), F.lit(100), F.col("n_params"), ok).alias("score"))


def history(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("cell").orderBy("level")
    return v.level_events.select(F.col("cell").alias("traj_id"), "level", "stage", F.min("best_loss").over(w).alias("best"), F.col("best_loss").alias("loss"))


def eq_history(v: Views) -> DataFrame:
    """Per equation residuals made from the level events."""
    e = F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")
    return v.level_events.select(F.col("cell").alias("traj_id"), e, "level", F.least("stage", F.lit(5)).alias("stage"), F.when(F.col("cell") % 3 == 0, 2).alias("cap"), F.round(F.col("best_loss") / 40).alias("residual"), F.col("best_loss").alias("loss"))


EQH = "SELECT cell AS traj_id, eq, level, least(stage, 5) AS stage, CASE WHEN cell % 3 = 0 THEN 2 END AS cap, round(best_loss / 40) AS residual, best_loss AS loss FROM level_events, (VALUES (1), (2)) x(eq)"
LIM = "CASE WHEN cap IS NULL THEN 5 ELSE greatest(cap, stage) END"
PROMO = {
    "h": EQH,
    "f": "SELECT *, count(residual) OVER f >= 2 AND max(residual) OVER f - min(residual) OVER f < 0.5e0 AS plateaued, row_number() OVER (PARTITION BY traj_id, eq, stage ORDER BY level) AS n FROM h WINDOW f AS (PARTITION BY traj_id, eq, stage ORDER BY level ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    "pm": f"SELECT *, plateaued AND n >= 3 AND residual > 1.0e0 AND stage < {LIM} AS promote FROM f",
}


def population(v: Views) -> DataFrame:
    """Structures over the series of events with objectives."""
    st = F.array(F.array((F.col("cand_id") % 11 + 1).cast("int")), F.array_sort(F.array_distinct(F.array((F.col("cand_id") % 5 + 1).cast("int"), (F.col("cand_id") % 7 + 1).cast("int")))))
    return v.candidates.select("traj_id", F.col("cand_id").cast("long").alias("cand_id"), st.alias("structure"), F.col("loss").alias("objective"), "loss", "n_params")


def lists(v: Views, stage: int, exact: bool = False) -> DataFrame:
    own = F.array(*[F.lit(t.idx) for t in B2 if (t.stage == stage if exact else t.stage <= stage)])
    return v.candidates.select("traj_id").distinct().select("traj_id", F.array(own, own).alias("terms"))


def text(df: DataFrame) -> DataFrame:
    return df.withColumn("structure", F.concat_ws("|", F.transform("structure", lambda s: F.concat_ws(",", F.transform(s, lambda t: t.cast("string"))))))


def gate_pairs(v: Views) -> DataFrame:
    c = v.candidates
    par = c.select("traj_id", F.col("cand_id").alias("parent_id"), F.col("n_params").alias("p_parent"), F.col("residual").alias("r_parent"))
    return c.where("cand_id <> parent_id").join(par, ["traj_id", "parent_id"]).select("traj_id", "cand_id", F.lit(97).alias("n"), F.col("n_params").alias("p_child"), "p_parent", F.col("residual").alias("r_child"), "r_parent", (F.col("cand_id") % 13 != 0).alias("valid"))


def searched(v: Views, caps: bool, policy: S.SearchPolicy = GROW) -> tuple[DataFrame, DataFrame]:
    c = C.estimate_stage_caps(v.traj_events, B2, EV) if caps else None
    return S.grow(prepared(v), B2, 2, policy, S.cut(c, "caps") if caps else None)


def callback(v: Views) -> DataFrame:
    """What a level callback sees of three levels: the series that run and the last of them."""
    seen = []
    S.grow(prepared(v), B2, 2, dataclasses.replace(GROW, max_levels=3, min_levels=4), on_level=lambda pop, level: seen.append(pop.where("rn = 1").agg(F.count(F.lit(1)).alias("series"), F.max("traj_id").alias("last")).withColumn("level", F.lit(level))))
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).select("level", "series", "last")


def found(best: DataFrame) -> DataFrame:
    return text(best).select("traj_id", "structure", "n_params", F.round("loss", 4).alias("loss"), F.concat_ws(",", F.transform("stages", lambda x: x.cast("string"))).alias("stages"), "levels", "reason")


def hashed(n: str, *keys: str) -> str:
    """A draw from 0 to n - 1."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8) AS BIGINT) % {n}"


def ids(stage: int, exact: bool = False) -> str:
    return str([t.idx for t in B2 if (t.stage == stage if exact else t.stage <= stage)])


def growth(mode: str, allowed: str, current: str) -> dict[str, str]:
    """Steps of expand over the population of hashed structures; both equations have the same lists."""
    key = ("0", "1", "traj_id", "cand_id", "child")
    at = lambda a, n: f"{a}[1 + {n}]"
    eq = {"passive": "any_eq", "hard": f"CASE WHEN is_hard THEN {at('hard', hashed('len(hard)', *key, repr('hard')))} ELSE any_eq END"}
    calm = f"CASE WHEN len({current}) > 0 AND len(growable) > 0 THEN {at('growable', hashed('greatest(len(growable), 1)', *key, repr('eq')))} ELSE any_eq END"
    eq["soft"] = f"CASE WHEN is_hard THEN {at('hard', hashed('greatest(len(hard), 1)', *key, repr('hard')))} ELSE {calm} END"
    eq["hard"] = eq["hard"].replace("% len(hard)", "% greatest(len(hard), 1)")
    forced = {"passive": "false", "hard": "true", "soft": f"({hashed(str(1 << 30), *key, repr('mode'))}) / {float(1 << 30)!r}::DOUBLE < 0.75e0"}[mode]
    free = lambda a, s: f"[t FOR t IN {a}::INT[] IF NOT list_contains({s}, t)]"
    return {
        "po": "SELECT traj_id, cand_id, [[cand_id % 11 + 1], list_sort(list_distinct([cand_id % 5 + 1, cand_id % 7 + 1]))] AS s FROM candidates",
        "ki": f"SELECT *, unnest([1, 2, 3]) AS child, [e FOR e IN [1, 2] IF len({free(current, 's[e]')}) > 0] AS hard, [e FOR e IN [1, 2] IF len({free(allowed, 's[e]')}) > 0] AS growable FROM po",
        "kh": f"SELECT *, {forced} AND len(hard) > 0 AS is_hard, 1 + {hashed('2', *key, repr('eq'))} AS any_eq FROM ki",
        "ke": f"SELECT *, {eq[mode]} AS e FROM kh",
        "kf": f"SELECT *, CASE WHEN is_hard THEN {free(current, 's[e]')} ELSE {free(allowed, 's[e]')} END AS options FROM ke",
        "kt": f"SELECT *, CASE WHEN len(options) > 0 THEN {at('options', hashed('greatest(len(options), 1)', *key, repr('term')))} END AS term FROM kf",
        "kg": "SELECT *, [CASE WHEN i = e AND term IS NOT NULL THEN list_sort(list_distinct(list_append(s[i], term))) ELSE s[i] END FOR i IN [1, 2]] AS g FROM kt",
    }


GROWN = "SELECT traj_id, cand_id AS parent_id, child, array_to_string(g[1], ',') || '|' || array_to_string(g[2], ',') AS structure FROM kg"
#: Quantiles of F by bisection on the regularised incomplete beta, integrated over s = sqrt(t) by Simpson's rule.
QUANTILE = {
    "dp": "SELECT DISTINCT c.n_params - p.n_params AS df1, 97 - c.n_params AS df2 FROM candidates c JOIN candidates p ON p.traj_id = c.traj_id AND p.cand_id = c.parent_id WHERE c.cand_id <> c.parent_id AND c.n_params > p.n_params",
    "bs": "SELECT df1, df2, 0 AS k, 0e0 AS lo, 1e0 AS hi FROM dp UNION ALL SELECT df1, df2, k + 1, CASE WHEN b < 0.95e0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN b < 0.95e0 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, "
    "2 * exp(lgamma((df1 + df2) / 2e0) - lgamma(df1 / 2e0) - lgamma(df2 / 2e0)) * sqrt((lo + hi) / 2) / 1200 * list_sum([CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(i * sqrt((lo + hi) / 2) / 400, df1 - 1) * pow(1 - i * i * (lo + hi) / 2 / 160000, df2 / 2e0 - 1) FOR i IN range(401)]) AS b FROM bs WHERE k < 50) q",
    "fq": "SELECT df1, df2, df2 * lo / (df1 * (1 - lo)) AS threshold FROM bs WHERE k = 50",
}
GATE = {
    **QUANTILE,
    "gp": "SELECT c.traj_id, c.cand_id, 97 AS n, c.n_params AS p_child, p.n_params AS p_parent, c.residual AS r_child, p.residual AS r_parent, c.cand_id % 13 <> 0 AS valid FROM candidates c JOIN candidates p ON p.traj_id = c.traj_id AND p.cand_id = c.parent_id WHERE c.cand_id <> c.parent_id",
    "gs": "SELECT gp.*, p_child - p_parent AS d1, n - p_child AS d2, ((r_parent - r_child) * n / (p_child - p_parent)) / greatest(r_child * n / (n - p_child), 2.220446049250313e-16) AS f, CASE WHEN valid THEN threshold END AS threshold FROM gp LEFT JOIN fq ON df1 = p_child - p_parent AND df2 = n - p_child",
}

def shrunk(r, cols, y, n):
    """A solver of one's own: ridge with a penalty of 10."""
    import numpy as np

    a, b = r[:, cols].transpose(1, 0, 2), r[:, y].T
    gram = np.einsum("mki,mkj->mij", a, a) + 10.0 * np.eye(cols.shape[1])
    c = np.linalg.solve(gram, np.einsum("mki,mk->mi", a, b)[..., None])[..., 0]
    e = np.einsum("mik,mk->mi", a, c) - b
    return c, (e * e).sum(1) / n


def chosen(v: Views, scoring: S.Scoring, name: str) -> DataFrame:
    """The best candidate of each series under a scoring; ties go to the smaller id."""
    return S.scored(structures(v), factors(v), P, 2, scoring=scoring).groupBy("traj_id").agg(F.min(F.struct("loss", "cand_id")).alias("b")).select("traj_id", F.col("b.cand_id").alias(name), F.round("b.loss", 5).alias(f"{name}_loss"))


#: The candidates' ridge residuals, of one or two terms.
SHRUNK = SCREEN | {
    "sc": "SELECT cand_id, traj_id, eq, n, (yy - 2 * (c1 * p + coalesce(c2 * q, 0)) + c1 * c1 * a + coalesce(2 * c1 * c2 * b + c2 * c2 * c, 0)) / n AS residual FROM "
    "(SELECT *, CASE WHEN c IS NULL THEN p / (a + 10) ELSE ((c + 10) * p - b * q) / ((a + 10) * (c + 10) - b * b) END AS c1, CASE WHEN c IS NOT NULL THEN ((a + 10) * q - b * p) / ((a + 10) * (c + 10) - b * b) END AS c2 FROM "
    "(SELECT t.cand_id, t.traj_id, t.eq, x.n, x.yy, x.s AS p, y.s AS q, g.s AS a, k.s AS b, h.s AS c FROM te t JOIN gm g ON g.traj_id = t.traj_id AND g.i = t.i AND g.j = t.i JOIN bm x ON x.traj_id = t.traj_id AND x.i = t.i AND x.e = t.eq "
    "LEFT JOIN gm h ON h.traj_id = t.traj_id AND h.i = t.j AND h.j = t.j LEFT JOIN gm k ON k.traj_id = t.traj_id AND k.i = t.i AND k.j = t.j LEFT JOIN bm y ON y.traj_id = t.traj_id AND y.i = t.j AND y.e = t.eq) u) w",
}
WORST = "SELECT traj_id, arg_min(cand_id, (l, cand_id)) AS {name}, round(min(l), 5) + 0e0 AS {name}_loss FROM (SELECT traj_id, cand_id, {agg}(residual) AS l FROM sc GROUP BY ALL) q GROUP BY 1"


QUERIES = {
    "u01_custom_loss": (
        lambda v: chosen(v, S.Scoring(), "by_mean").join(chosen(v, S.Scoring(loss=S.worst_loss), "by_worst"), "traj_id"),
        oracle(f"SELECT * FROM ({WORST.format(name='by_mean', agg='avg')}) a JOIN ({WORST.format(name='by_worst', agg='max')}) b USING (traj_id)", "traj_events", **SCREEN),
    ),
    "u01_custom_solver": (lambda v: chosen(v, S.Scoring(solver=shrunk), "by_ridge"), oracle(WORST.format(name="by_ridge", agg="avg"), "traj_events", **SHRUNK)),
    "u01_custom_search": (
        # the evolutionary search under a loss of one's own, through the same entry as the staged one
        lambda v: r(discover(v.traj_events, B2, EV, dataclasses.replace(GROW, max_levels=4), scoring=S.Scoring(loss=S.information_loss), search=evolutionary)[0].select("traj_id", "n_params", "loss", "levels", "termination", "evaluations", F.concat_ws("|", F.transform("support_terms", lambda x: F.concat_ws(",", x))).alias("support")), n=4),
        None,
    ),
    "d25_scoring_costs": (
        lambda v: S.costs(S.scored(structures(v), factors(v), P, 2), "traj_id").select("traj_id", *S.COUNTERS, F.concat_ws(",", "codes").alias("codes")),
        oracle("SELECT traj_id, count(DISTINCT cand_id) AS evaluations, count(DISTINCT (eq, least(i, coalesce(j, i)), greatest(i, coalesce(j, i)), i)) AS fits, 2 * count(DISTINCT cand_id) - count(DISTINCT (eq, least(i, coalesce(j, i)), greatest(i, coalesce(j, i)), i)) AS shared, 0 AS invalid, '' AS codes FROM te GROUP BY 1", "traj_events", **{k: SCREEN[k] for k in ("ca", "te")}),
    ),
    "d25_search_costs": (lambda v: S.run_costs(searched(v, False, dataclasses.replace(GROW, max_levels=4))[1]).select("traj_id", "levels", *S.COUNTERS, F.concat_ws(",", "codes").alias("codes")), None),
    "d01_init_population": (
        lambda v: text(S.init_population(lists(v, 3), 8)),
        oracle(f"SELECT traj_id, cand_id, ({ids(3)})[1 + {hashed('5', '0', 'traj_id', 'cand_id', '0', repr('init'))}] || '|' || ({ids(3)})[1 + {hashed('5', '0', 'traj_id', 'cand_id', '1', repr('init'))}] AS structure FROM (SELECT DISTINCT traj_id FROM candidates) t, range(8) r(cand_id)", "candidates"),
    ),
    **{f"d0{i}_expand_{m}": ((lambda v, m=m: text(S.expand(population(v).drop("objective", "loss", "n_params"), lists(v, 3), lists(v, 3, True), S.SearchPolicy(), 1, m))), oracle(GROWN, "candidates", **growth(m, ids(3), ids(3, True)))) for i, m in ((2, "passive"), (3, "hard"), (4, "soft"))},
    "d05_expand_policy": (lambda v: text(S.expand(population(v).drop("objective", "loss", "n_params"), lists(v, 1), None, S.SearchPolicy(), 1)), oracle(GROWN, "candidates", **growth("soft", ids(1), "[]::INT[]"))),
    "d06_score": (
        lambda v: rows(v).select("cand_id", F.when(F.col("valid"), F.round("score", 9)).alias("score"), F.round(S.score(F.col("residual"), F.lit(100), F.col("n_params"), F.lit(True), "aic"), 6).alias("aic")),
        oracle("SELECT cand_id, CASE WHEN valid THEN round(score, 9) END AS score, round(100 * ln(greatest(residual, 2.220446049250313e-16)) + 2 * n_params, 6) AS aic FROM a", "candidates", a=ROWS),
    ),
    "d07_nested_f_gate": (
        lambda v: r(S.nested_f_gate(gate_pairs(v)), n=6),
        oracle(
            "SELECT traj_id, cand_id, n, p_child, p_parent, round(r_child, 6) + 0e0 AS r_child, round(r_parent, 6) + 0e0 AS r_parent, valid, CASE WHEN NOT valid THEN false WHEN d1 <= 0 THEN true WHEN d2 <= 0 OR r_parent <= r_child THEN false ELSE f > threshold END AS passes, "
            "round(CASE WHEN NOT valid OR d1 <= 0 OR d2 <= 0 THEN NULL WHEN r_parent <= r_child THEN 0 ELSE f END, 6) + 0e0 AS f_stat, round(threshold, 6) AS threshold FROM gs", "candidates", **GATE),
    ),
    "d08_f_quantiles": (lambda v: r(S.f_quantiles(gate_pairs(v).select((F.col("p_child") - F.col("p_parent")).alias("df1"), (F.col("n") - F.col("p_child")).alias("df2")).where("df1 > 0"), 0.05)), oracle("SELECT df1, df2, round(threshold, 6) AS threshold FROM fq", "candidates", **QUANTILE)),
    "d09_select_topk": (lambda v: S.select_topk(rows(v), 10).select("traj_id", "cand_id"), oracle("SELECT traj_id, cand_id FROM k WHERE rn <= 10 AND (valid OR incumbent)", "candidates", **RANKED)),
    "d10_selection_diff": (
        lambda v: S.selection_diff(S.select_topk(rows(v), 10), S.select_topk(rows(v).withColumn("incumbent", F.lit(False)), 10)),
        oracle("SELECT coalesce(x.traj_id, y.traj_id) AS traj_id, count(*) FILTER (x.cand_id IS NULL OR y.cand_id IS NULL) AS n_diff FROM (SELECT traj_id, cand_id FROM k WHERE rn <= 10 AND (valid OR incumbent)) x FULL JOIN (SELECT traj_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY valid DESC, score, cand_id) AS r2 FROM a) z WHERE r2 <= 10 AND valid) y ON x.traj_id = y.traj_id AND x.cand_id = y.cand_id GROUP BY 1", "candidates", **RANKED),
    ),
    "d11_spearman": (
        lambda v: r(S.spearman(v.candidates, ["traj_id"], "residual", "loss")),
        oracle("SELECT traj_id, count(*) AS n, round(corr(rx, ry), 6) + 0e0 AS rho FROM (SELECT traj_id, rank() OVER (PARTITION BY traj_id ORDER BY residual) + (count(*) OVER (PARTITION BY traj_id, residual) - 1) / 2 AS rx, rank() OVER (PARTITION BY traj_id ORDER BY loss) + (count(*) OVER (PARTITION BY traj_id, loss) - 1) / 2 AS ry FROM candidates) q GROUP BY 1", "candidates"),
    ),
    "d12_rank_summary": (
        lambda v: r(S.rank_summary(S.spearman(v.candidates, ["traj_id"], "residual", "loss"))),
        oracle("SELECT round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.5), 6) AS median, round(min(rho), 6) AS min, round(max(rho), 6) AS max, count(rho) AS n_finite, count(*) AS n FROM (SELECT traj_id, corr(rx, ry) AS rho FROM (SELECT traj_id, rank() OVER (PARTITION BY traj_id ORDER BY residual) + (count(*) OVER (PARTITION BY traj_id, residual) - 1) / 2 AS rx, rank() OVER (PARTITION BY traj_id ORDER BY loss) + (count(*) OVER (PARTITION BY traj_id, loss) - 1) / 2 AS ry FROM candidates) q GROUP BY 1) z", "candidates"),
    ),
    "d13_rejected_check": (
        lambda v: S.rejected_check(rows(v), 10, 20),
        oracle("SELECT traj_id, count(*) FILTER (rn > 10) AS checked, count(*) FILTER (rn > 10 AND loss < best) AS better FROM (SELECT *, min(loss) FILTER (rn <= 10) OVER (PARTITION BY traj_id) AS best FROM k WHERE rn <= 30) q GROUP BY 1", "candidates", **RANKED),
    ),
    "d14_select_population": (
        lambda v: S.select_population(v.candidates.where("cand_id % 2 = 0"), v.candidates.where("cand_id % 2 = 1"), 12, 1e-3).select("traj_id", "cand_id", "is_child", "rn", F.round("objective", 9).alias("objective")),
        oracle("SELECT traj_id, cand_id, is_child, rn, round(objective, 9) AS objective FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY objective, is_child, cand_id) AS rn FROM (SELECT *, cand_id % 2 AS is_child, loss + 1e-3 * n_params AS objective FROM candidates) a) b WHERE rn <= 12", "candidates"),
    ),
    "d15_should_stop": (
        lambda v: S.should_stop(history(v), POL).select("traj_id", "level", "reason", "stop"),
        oracle("SELECT traj_id, level, reason, reason NOT IN ('min_levels', 'continue') AS stop FROM (SELECT *, CASE WHEN level >= 60 THEN 'max_levels' WHEN level < 4 THEN 'min_levels' WHEN loss < 1.0e0 THEN 'loss_tol' WHEN old - best < 0.5e0 THEN 'plateau_absolute' ELSE 'continue' END AS reason FROM (SELECT *, lag(best, 2) OVER (PARTITION BY traj_id ORDER BY level) AS old FROM h) a) b", "level_events", h=HIST),
    ),
    "d16_stage_progression": (
        lambda v: S.stage_progression(history(v), POL, 4).select("traj_id", "level", "reason", "action"),
        oracle("SELECT traj_id, level, reason, CASE WHEN reason IN ('max_levels', 'loss_tol') THEN 'stop' WHEN reason = 'plateau_absolute' THEN CASE WHEN stage < 4 THEN 'promote' ELSE 'stop' END ELSE 'stay' END AS action FROM (SELECT *, CASE WHEN level >= 60 THEN 'max_levels' WHEN loss < 1.0e0 THEN 'loss_tol' WHEN n < 2 THEN 'stage_budget' WHEN old IS NULL THEN 'insufficient_history' WHEN old - best < 0.5e0 THEN 'plateau_absolute' ELSE 'continue' END AS reason FROM (SELECT *, lag(best, 2) OVER w AS old, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY traj_id, stage ORDER BY level)) a) b", "level_events", h=HIST),
    ),
    "d17_promote_equations": (lambda v: S.promote_equations(eq_history(v), POL, 5).select("traj_id", "eq", "level", "plateaued", "promote"), oracle("SELECT traj_id, eq, level, plateaued, promote FROM pm", "level_events", **PROMO)),
    "d18_apply_promotion": (
        lambda v: S.apply_promotion(S.promote_equations(eq_history(v), POL, 5).select("traj_id", "eq", "level", "promote")).select("traj_id", "eq", "level", "stage", "in_stage", "promoted_at"),
        oracle("SELECT traj_id, eq, level, stage, row_number() OVER (PARTITION BY traj_id, eq, stage ORDER BY level) AS in_stage, promoted_at FROM (SELECT traj_id, eq, level, CASE WHEN promote THEN level END AS promoted_at, 1 + coalesce(sum(CAST(promote AS INT)) OVER (PARTITION BY traj_id, eq ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stage FROM pm) q", "level_events", **PROMO),
    ),
    "d19_terminate": (
        lambda v: S.terminate_v3(S.promote_equations(eq_history(v), POL, 5), POL, 5),
        oracle(f"SELECT traj_id, level, reason, reason NOT IN ('min_levels', 'continue') AS stop FROM (SELECT traj_id, level, CASE WHEN level >= 60 THEN 'max_levels' WHEN level < 4 THEN 'min_levels' WHEN max(loss) < 1.0e0 THEN 'loss_tol' WHEN bool_and(stage >= {LIM} AND plateaued) THEN 'all_equations_max_stage_plateau' ELSE 'continue' END AS reason FROM f GROUP BY 1, 2) q", "level_events", **PROMO),
    ),
    "d20_wasted_levels": (
        lambda v: S.wasted_levels(eq_history(v), v.level_events.select(F.col("cell").alias("traj_id")).distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).withColumn("expected", (F.col("traj_id") % 4 + F.col("eq")).cast("int"))),
        oracle("SELECT traj_id, eq, count(*) FILTER (stage > traj_id % 4 + eq) AS wasted, max(greatest(0, stage - (traj_id % 4 + eq))) AS overshoot FROM h GROUP BY 1, 2", "level_events", h=EQH),
    ),
    "d20_signed_overshoot": (
        lambda v: v.run_registry.select("run_id", S.signed_overshoot(F.col("final_stage"), F.col("expected_stage")).alias("signed"), S.overshoot(F.col("final_stage"), F.col("expected_stage")).alias("clamped")),
        oracle("SELECT run_id, CASE WHEN final_stage < 0 THEN -999 ELSE final_stage - expected_stage END AS signed, greatest(0, final_stage - expected_stage) AS clamped FROM run_registry", "run_registry"),
    ),
    "d21_stage_first_use": (
        lambda v: S.stage_first_use(history(v).withColumn("uses", F.col("loss") < 30)),
        oracle("SELECT traj_id, stage, count(*) AS levels, min(level) FILTER (loss < 30) AS first_use FROM h GROUP BY 1, 2", "level_events", h=HIST),
    ),
    "d22_grow": (lambda v: found(searched(v, False)[0]), None),
    "d22_grow_by_series": (lambda v: found(searched(v, False, dataclasses.replace(GROW, progress="series", screen_k=6))[0]), None),
    "d23_grow_capped": (lambda v: found(searched(v, True)[0]), None),
    "d22_discover": (
        # the truth is that every equation is linear in its own state: what the records say about it
        lambda v: r(discover(v.traj_events, B2, EV, dataclasses.replace(GROW, max_levels=8), caps=C.CapPolicy(), truth=v.traj_events.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).withColumn("term", F.col("eq")))[0].select(
            "traj_id", "dim", "n_params", "loss", "r2", "final_stage", "levels", "promotions", "termination", F.concat_ws("|", F.transform("support_terms", lambda x: F.concat_ws(",", x))).alias("support"), "raw_match", "pruned_match"), n=4),
        None,
    ),
    "d24_gp_search": (lambda v: text(S.gp_search(prepared(v), B2, 2, dataclasses.replace(GROW, max_levels=10))[0]).select("traj_id", "structure", "n_params", F.round("loss", 4).alias("loss"), "levels", "reason"), None),
    "u02_level_callback": (callback, oracle("SELECT level, count(DISTINCT traj_id) AS series, max(traj_id) AS last FROM traj_events, range(1, 4) l(level) GROUP BY level", "traj_events")),
    "d24_gp_generation": (lambda v: text(S.gp_generation(population(v), 11, 0, 1)), None),
    "d25_cost_totals": (
        lambda v: S.cost_totals(v.lineitem.select(F.col("l_suppkey").alias("traj_id"), F.col("l_linenumber").alias("level"), F.col("l_partkey").alias("fits"), F.col("l_orderkey").alias("solves"), F.col("l_returnflag").alias("retcode")), ["traj_id", "level"], ["fits", "solves"], "retcode"),
        oracle("SELECT l_suppkey AS traj_id, l_linenumber AS level, sum(l_partkey) AS fits, sum(l_orderkey) AS solves, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS retcode FROM lineitem GROUP BY 1, 2"),
    ),
    "d26_level_snapshots": (
        lambda v: S.level_snapshots(v.level_events.select(F.col("cell").alias("traj_id"), "level", F.col("best_loss").alias("best"))),
        oracle("SELECT traj_id, level, best, prev IS NULL OR best < prev AS accepted FROM (SELECT cell AS traj_id, level, best_loss AS best, min(best_loss) OVER (PARTITION BY cell ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM level_events) q", "level_events"),
    ),
}
