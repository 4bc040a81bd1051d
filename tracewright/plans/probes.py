"""Queries of reference rows: densities, known supports and derivatives, estimators side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import derivatives as D
from tracewright.operators import probes as P
from tracewright.operators import stagecaps as C
from tracewright.operators import terms as T

from .derivatives import EV, REPORT, RICH, W, _central_sql, _fd4_sql, _interp_sql, r
from .regression import B2, linear
from .stagecaps import INF, POL, SENSE, walk
from .views import Views, oracle

#: A library of a state and its square, whose fits have a closed form.
TWO = T.custom_basis([("u1", 1, (1,), lambda u: u[0]), ("u1^2", 2, (1,), lambda u: u[0] * u[0])])
EPS = "2.220446049250313e-16"
KS = (1, 2, 4)


def _dense(view: str, ks: tuple[int, ...], cols: str) -> str:
    """Series at several densities under one key, traj_id * 10 + k."""
    return f"SELECT traj_id * 10 + k AS traj_id, CAST(floor((seq - 1) / k) AS INT) + 1 AS seq, t, {cols} FROM {view}, (VALUES {', '.join(f'({k})' for k in ks)}) x(k) WHERE (seq - 1) % k = 0"


#: Which rows of a series each split holds out; n is the series' length.
HELD = (
    "[{'split': 'A', 'h': seq > n - floor(n * 0.3e0)}, {'split': 'B', 'h': seq <= floor(n * 0.3e0)}, {'split': 'C', 'h': seq > floor(n * 0.35e0) AND seq <= n - floor(n * 0.35e0)}, "
    "{'split': 'D', 'h': (seq > floor(n * 0.25e0) AND seq <= floor(n * 0.5e0)) OR seq > floor(n * 0.75e0)}]"
)


def _two_term(rows: str) -> dict[str, str]:
    """Weighted fits of x and of x, x^2 on each split, tested on its holdout. rows: traj_id, seq, n, x, d, rr, w."""
    return {
        "rw": rows,
        "sp": f"SELECT *, unnest({HELD}) AS y FROM rw",
        "ss": "SELECT *, y.split AS split, y.h AS h FROM sp",
        "su": "SELECT traj_id, split, sum(w * x * x) FILTER (NOT h) AS a, sum(w * x * x * x) FILTER (NOT h) AS b, sum(w * x * x * x * x) FILTER (NOT h) AS c, sum(w * x * d) FILTER (NOT h) AS p, sum(w * x * x * d) FILTER (NOT h) AS q, "
        "var_pop(d) FILTER (NOT h) AS spread, count(DISTINCT x) FILTER (NOT h AND x <> 0) AS kinds FROM ss GROUP BY ALL",
        "co": "SELECT *, 1 AS stage, p / a AS k1, 0e0 AS k2 FROM su UNION ALL SELECT *, 2, (c * p - b * q) / (a * c - b * b), (a * q - b * p) / (a * c - b * b) FROM su",
        "tb": "SELECT traj_id, split, stage, avg((k1 * x + k2 * x * x - d) * (k1 * x + k2 * x * x - d)) AS residual, avg(rr) AS floor_ms, CAST(least(kinds, stage) AS INT) AS rank, kinds >= stage AND spread >= 1e-10 AS usable "
        "FROM ss JOIN co USING (traj_id, split) WHERE h GROUP BY traj_id, split, stage, kinds, spread",
    }


DENSE = {"dz": _dense("traj_supplier", KS, "u1, u1 AS u2")} | {k: q.replace("traj_events", "dz") for k, q in RICH.items()}
SWEEP = {
    **DENSE,
    "me": "SELECT traj_id, quantile_cont(r_u1 * r_u1, 0.5) AS m, count(*) AS n FROM rich GROUP BY 1",
    **_two_term(f"SELECT traj_id, seq, n, u1 AS x, d_u1 AS d, r_u1 * r_u1 AS rr, 1 / (r_u1 * r_u1 + m + {EPS}) AS w FROM rich JOIN full_d USING (traj_id, seq) JOIN dz USING (traj_id, seq) JOIN me USING (traj_id)"),
}
CLIFF = {
    **SWEEP,
    "ex": "SELECT DISTINCT traj_id, CAST(1 + traj_id // 10 % 2 AS INT) AS expected FROM tb",
    "cl": "SELECT tb.traj_id, split, expected, max(CASE WHEN stage = greatest(expected - 1, 1) THEN residual END) AS before, max(CASE WHEN stage = expected THEN residual END) AS res, max(CASE WHEN stage = expected THEN floor_ms END) AS fl, "
    "bool_or(rank < stage) FILTER (stage = expected) AS poor, bool_or(rank < stage) FILTER (stage = 2) AS poor2 FROM tb JOIN ex USING (traj_id) GROUP BY 1, 2, 3",
}
KNOWN = {"nn": REPORT["nn"], "f4": f"SELECT traj_id, seq, {_fd4_sql('u1')} AS e1, {_fd4_sql('u2')} AS e2 FROM nn {W}"}


def sweep(v: Views) -> DataFrame:
    return P.density_sweep(v.traj_supplier, TWO, ["u1"], KS)


def fd4_known(v: Views) -> DataFrame:
    """Trajectories with the fourth-order difference as a derivative that is taken as known."""
    return D.deriv_fd4(v.traj_events, EV).withColumnsRenamed({"d_u1": "e_u1", "d_u2": "e_u2"})


def own_support(v: Views) -> DataFrame:
    """One linear term an equation, which one differs by series."""
    return v.traj_events.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).withColumn("term", 1 + (F.col("traj_id") + F.col("eq")) % 2)


#: Residuals of the known derivative, and of a one-term fit, by split and over all rows. dv: traj_id, seq, eq, x, d, e, n.
REFERENCE = {
    "ds": f"SELECT *, unnest({HELD} || [{{'split': 'all', 'h': true}}]) AS y FROM dv",
    "dt": "SELECT *, y.split AS split, y.h AS held, NOT y.h OR y.split = 'all' AS fits FROM ds",
    "kf": "SELECT {keys}, eq, split, sum(x * d) FILTER (fits) / sum(x * x) FILTER (fits) AS k, count(*) FILTER (fits) AS n_fit, count(*) FILTER (held) AS n_holdout, var_pop(d) FILTER (held) AS var FROM dt GROUP BY ALL",
    "rf": "SELECT {keys}, eq, split, kind, n_fit, n_holdout, avg(z * z) FILTER (fits) AS train, avg(z * z) FILTER (held) AS hold, var, CASE WHEN kind = 'support' THEN k END AS coef FROM "
    "(SELECT dt.*, n_fit, n_holdout, var, k, kind, CASE WHEN kind = 'exact' THEN e - d ELSE k * x - d END AS z FROM dt JOIN kf USING ({keys}, eq, split), (VALUES ('exact'), ('support')) q(kind)) u GROUP BY ALL",
}


def _reference(keys: str, dv: str) -> dict[str, str]:
    return {"dv": dv} | {k: q.replace("{keys}", keys) for k, q in REFERENCE.items()}


def reference(v: Views) -> DataFrame:
    rows = P.reference_rows(fd4_known(v), linear(v), EV, ["e_u1", "e_u2"], own_support(v))
    return r(rows.select("traj_id", "split", "eq", "kind", "terms", "n_fit", "n_holdout", "train_residual", "holdout_residual", "normalised", "rank", "valid", F.get("coefs", F.lit(0)).alias("coef")), n=4)


def contamination(v: Views) -> DataFrame:
    """A stated model's right-hand side against two estimators at two densities, beside fits of its support."""
    a = 1.0 + F.col("traj_id") % 3
    t = v.traj_events.withColumns({"e_u1": a * F.col("u1"), "e_u2": a * F.col("u2")})
    own = v.traj_events.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).withColumn("term", F.col("eq"))
    rows = P.reference_rows(t, linear(v), EV, ["e_u1", "e_u2"], own, ("central", "fd4"), (1, 2))
    return r(rows.select("traj_id", "k", "estimator", "split", "eq", "kind", F.col("holdout_residual").alias("r_k")), n=4)


CONTAMINATED = {
    "dz": _dense("traj_events", (1, 2), "u1, u2"), "cd": _central_sql("dz", EV), "nn": REPORT["nn"].replace("traj_events", "dz"), "f4": KNOWN["f4"],
    "es": "SELECT traj_id, seq, 'central' AS estimator, d_u1 AS d1, d_u2 AS d2 FROM cd UNION ALL SELECT traj_id, seq, 'fd4', e1, e2 FROM f4",
} | _reference(
    "traj_id, estimator",
    "SELECT traj_id, seq, estimator, count(*) OVER (PARTITION BY traj_id, estimator) // 2 AS n, x.eq AS eq, x.x AS x, x.d AS d, x.x * (1 + traj_id // 10 % 3) AS e FROM (SELECT traj_id, seq, estimator, unnest([{'eq': 1, 'x': u1, 'd': d1}, {'eq': 2, 'x': u2, 'd': d2}]) AS x FROM es JOIN dz USING (traj_id, seq)) o",
)


def _error_report(v: Views) -> DataFrame:
    t = v.traj_events
    d = D.with_errors(t, ["u1"], "central").select("traj_id", "seq", F.col("d_u1").alias("d"), F.col("r_u1").alias("r"))
    return D.estimator_error(d, D.deriv_fd4(t, ["u1"]).select("traj_id", "seq", F.col("d_u1").alias("d_true")), "u1", fits=True).drop("col")


FIT_BLOCKS = REPORT | {
    "bl": REPORT["bl"].replace(
        "CASE WHEN seq > n0 - floor(n0 * 0.3e0) THEN 'last' END]",
        "CASE WHEN seq > n0 - floor(n0 * 0.3e0) THEN 'last' END, CASE WHEN seq <= n0 - floor(n0 * 0.3e0) THEN 'fit_a' END, CASE WHEN seq > floor(n0 * 0.3e0) THEN 'fit_b' END, CASE WHEN seq <= floor(n0 * 0.35e0) OR seq > n0 - floor(n0 * 0.35e0) THEN 'fit_c' END]")
}


def both_sources(v: Views) -> DataFrame:
    """Caps from estimated derivatives and from known ones, with thresholds scaled, of a two-term library."""
    t = fd4_known(v)
    table = C.stage_table(t, TWO, ["u1"], POL).select("*", F.lit("estimated").alias("source")).unionByName(C.stage_table_given(t, TWO, ["e_u1"], POL).select("*", F.lit("known").alias("source")))
    return C.sensitivity(table, (1.0, 100.0), (1.0,), POL, ("source", "traj_id", "eq"))


#: Both tables under one key, series * 2 + source.
SOURCES = {
    **RICH, **KNOWN,
    "me": "SELECT traj_id, quantile_cont(r_u1 * r_u1, 0.5) AS m, count(*) AS n FROM rich GROUP BY 1",
    **_two_term(
        f"SELECT traj_id * 2 AS traj_id, seq, n, u1 AS x, d_u1 AS d, r_u1 * r_u1 AS rr, 1 / (r_u1 * r_u1 + m + {EPS}) AS w FROM rich JOIN full_d USING (traj_id, seq) JOIN traj_events USING (traj_id, seq) JOIN me USING (traj_id) "
        "UNION ALL SELECT traj_id * 2 + 1, seq, me.n, u1, e1, 0e0, 1e0 FROM f4 JOIN traj_events USING (traj_id, seq) JOIN me USING (traj_id)"),
    "stage_residuals": "SELECT traj_id, split, stage, residual, floor_ms, usable FROM tb",
    **walk(pairs=[(1.0, 1.0), (100.0, 1.0)]), **SENSE,
    "br": "SELECT traj_id, policy, branch FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, policy ORDER BY n DESC, branch) AS rn FROM (SELECT traj_id, policy, branch, count(*) AS n FROM dc GROUP BY ALL) q) z WHERE rn = 1",
}

QUERIES = {
    "a09_estimator_error_fits": (
        lambda v: r(_error_report(v), n=5),
        oracle("SELECT traj_id, block, n, round(rms, 5) AS rms, round(max_abs, 5) AS max_abs, round(bound_rms, 5) AS bound_rms, round(CASE WHEN bound_rms > 0 THEN rms / bound_rms ELSE 'Infinity'::DOUBLE END, 5) AS ratio, round(corr, 5) AS corr, round(covered, 5) AS covered FROM rep", "traj_events", **FIT_BLOCKS),
    ),
    "a13_density_stages": (
        lambda v: r(sweep(v).drop("cond"), n=3),
        oracle("SELECT traj_id // 10 AS traj_id, traj_id % 10 AS k, 1 AS eq, split, stage, round(residual, 3) AS residual, round(floor_ms, 3) AS floor_ms, usable, rank, rank < stage AS rank_deficient FROM tb", "traj_supplier", **SWEEP),
    ),
    "a13_true_stage_cliff": (
        lambda v: r(P.true_stage_cliff(sweep(v), v.traj_supplier.select("traj_id").distinct().select("traj_id", F.lit(1).alias("eq"), (1 + F.col("traj_id") % 2).cast("int").alias("expected")), watch=2), n=3),
        oracle("SELECT traj_id // 10 AS traj_id, traj_id % 10 AS k, 1 AS eq, split, expected, round(before - res, 3) + 0e0 AS cliff, round(res, 3) AS true_residual, round(fl, 3) AS true_floor, poor AS true_rank_deficient, poor2 AS watch_rank_deficient, before - res > fl AS cliff_visible FROM cl", "traj_supplier", **CLIFF),
    ),
    "a13_derivative_error": (
        lambda v: r(P.derivative_error(fd4_known(v), EV, ["e_u1", "e_u2"], (1, 2), ("central", "fd4")), n=5),
        oracle(
            "SELECT traj_id // 10 AS traj_id, traj_id % 10 AS k, estimator, eq, count(*) AS n, round(sqrt(avg(x * x)), 5) + 0e0 AS rms_error FROM (SELECT e.traj_id, estimator, unnest([1, 2]) AS eq, unnest([d1 - e1, d2 - e2]) AS x FROM es e JOIN kn ON e.traj_id = kn.traj_id AND e.seq = kn.seq) q GROUP BY ALL",
            "traj_events", **{k: CONTAMINATED[k] for k in ("dz", "cd", "nn", "f4", "es")}, n1=REPORT["nn"], k1=KNOWN["f4"].replace("FROM nn", "FROM n1"), kn="SELECT traj_id * 10 + k AS traj_id, CAST(floor((seq - 1) / k) AS INT) + 1 AS seq, e1, e2 FROM k1, (VALUES (1), (2)) x(k) WHERE (seq - 1) % k = 0"),
    ),
    "b16_reference_rows": (
        reference,
        oracle(
            "SELECT traj_id, split, eq, kind, CASE WHEN kind = 'support' THEN CAST(1 + (traj_id + eq) % 2 AS VARCHAR) ELSE '' END AS terms, n_fit, n_holdout, round(train, 4) + 0e0 AS train_residual, round(hold, 4) + 0e0 AS holdout_residual, round(CASE WHEN var > 2.220446049250313e-16 THEN hold / var ELSE 'Infinity'::DOUBLE END, 4) + 0e0 AS normalised, "
            "CASE WHEN kind = 'support' THEN 1 ELSE 0 END AS rank, true AS valid, round(coef, 4) + 0e0 AS coef FROM rf", "traj_events", dd=_central_sql("traj_events", EV), **KNOWN, **_reference(
                "traj_id", "SELECT traj_id, seq, n, x.eq AS eq, x.x AS x, x.d AS d, x.e AS e FROM (SELECT traj_id, seq, nn.n AS n, unnest([{'eq': 1, 'x': CASE WHEN traj_id % 2 = 1 THEN nn.u1 ELSE nn.u2 END, 'd': d_u1, 'e': e1}, {'eq': 2, 'x': CASE WHEN traj_id % 2 = 0 THEN nn.u1 ELSE nn.u2 END, 'd': d_u2, 'e': e2}]) AS x FROM nn JOIN dd USING (traj_id, seq) JOIN f4 USING (traj_id, seq)) o")),
    ),
    "b17_contamination_rows": (contamination, oracle("SELECT traj_id // 10 AS traj_id, traj_id % 10 AS k, estimator, split, eq, kind, round(hold, 4) + 0e0 AS r_k FROM rf", "traj_events", **CONTAMINATED)),
    "c25_known_derivative": (
        both_sources,
        oracle("SELECT CASE WHEN traj_id % 2 = 0 THEN 'estimated' ELSE 'known' END AS source, traj_id // 2 AS traj_id, 1 AS eq, CASE WHEN policy = 0 THEN 1e0 ELSE 100e0 END AS rel_factor, 1e0 AS abs_factor, cap, branch FROM vs JOIN br USING (traj_id, policy)", "traj_events", **SOURCES),
    ),
}
