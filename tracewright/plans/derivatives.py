"""Queries over trajectories: derivatives, error bounds, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import derivatives as D

from .views import Views, oracle

EV, SU = ["u1", "u2"], ["u1", "u2", "u3"]


def r(df: DataFrame, *keep: str, n: int = 6) -> DataFrame:
    """df with all double columns but `keep` rounded to n places."""
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _central(c: str) -> str:
    up, dn = f"coalesce(lead({c}) OVER w, {c})", f"coalesce(lag({c}) OVER w, {c})"
    h = "(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t))"
    return f"CASE WHEN {h} <> 0 THEN ({up} - {dn}) / {h} ELSE 0 END"


W = "WINDOW w AS (PARTITION BY traj_id ORDER BY seq)"


def _central_sql(view: str, cols: list[str]) -> str:
    return f"SELECT traj_id, seq, t, {', '.join(f'{_central(c)} AS d_{c}' for c in cols)} FROM {view} {W}"


def _fd4_sql(c: str) -> str:
    g = lambda k: c if k == 0 else f"lead({c}, {k}) OVER w" if k > 0 else f"lag({c}, {-k}) OVER w"
    return (
        f"CASE WHEN n < 5 THEN {_central(c)} WHEN seq = 1 THEN ({g(1)} - {g(0)}) / h WHEN seq = n THEN ({g(0)} - {g(-1)}) / h "
        f"WHEN seq = 2 OR seq = n - 1 THEN ({g(1)} - {g(-1)}) / (h * 2) ELSE ({g(-2)} - {g(-1)} * 8 + {g(1)} * 8 - {g(2)}) / (h * 12) END"
    )


def fit_slope(v: Views) -> DataFrame:
    """Slope of du1/dt = a * u1 per series by least squares on central differences, and its RMSE."""
    d = D.deriv_central(v.traj_events, ["u1"])
    u, y = F.col("u1"), F.col("d_u1")
    s = d.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.sum(u * y).alias("sxy"), F.sum(u * u).alias("sxx"), F.sum(y * y).alias("syy"))
    a = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    rmse = F.sqrt(F.greatest((F.col("syy") - 2 * a * F.col("sxy") + a * a * F.col("sxx")) / F.col("n"), F.lit(0.0)))
    return s.select("traj_id", "n", F.round(a, 6).alias("slope"), F.round(rmse, 6).alias("rmse"))


FIT_SQL = oracle(
    "SELECT traj_id, n, round(a, 6) AS slope, round(sqrt(greatest((syy - 2 * a * sxy + a * a * sxx) / n, 0)), 6) AS rmse FROM f",
    "traj_events", d=_central_sql("traj_events", ["u1"]), s="SELECT d.traj_id, count(*) AS n, sum(u1 * d_u1) AS sxy, sum(u1 * u1) AS sxx, sum(d_u1 * d_u1) AS syy FROM d JOIN traj_events USING (traj_id, seq) GROUP BY d.traj_id",
    f="SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS a FROM s",
)


def _interp_sql(c: str) -> str:
    a, b = "(SELECT max(t) FROM k WHERE k.traj_id = f.traj_id AND k.t <= f.t)", "(SELECT min(t) FROM k WHERE k.traj_id = f.traj_id AND k.t >= f.t)"
    return f"SELECT f.traj_id, f.seq, f.t, {a} AS ta, {b} AS tb FROM {c} f"


LERP = "CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL THEN a.{c} ELSE a.{c} + (CASE WHEN tb > ta THEN (i.t - ta) / (tb - ta) ELSE 0 END) * (b.{c} - a.{c}) END"
COARSE = "SELECT traj_id, CAST(floor((seq - 1) / 2) AS INT) + 1 AS seq, t, u1, u2 FROM traj_events WHERE (seq - 1) % 2 = 0"
JOINS = "FROM i LEFT JOIN k a ON a.traj_id = i.traj_id AND a.t = ta LEFT JOIN k b ON b.traj_id = i.traj_id AND b.t = tb"
RICH = {
    "c": COARSE, "k": _central_sql("c", EV), "i": _interp_sql("traj_events"), "h": f"SELECT i.traj_id, i.seq, {', '.join(LERP.format(c=f'd_{c}') + f' AS d_{c}' for c in EV)} {JOINS}",
    "full_d": _central_sql("traj_events", EV), "rich": f"SELECT f.traj_id, f.seq, f.t, {', '.join(f'abs(f.d_{c} - h.d_{c}) AS r_{c}' for c in EV)} FROM full_d f JOIN h USING (traj_id, seq)",
}


def _report(v: Views, est: str) -> DataFrame:
    """Errors of an estimator against the fourth-order difference, which stands in for a known derivative."""
    t = v.traj_events
    d = D.derivatives(t, ["u1"], est).select("traj_id", "seq", F.col("d_u1").alias("d"))
    rich = D.richardson_error(t, ["u1"], est).select("traj_id", "seq", F.col("r_u1").alias("r"))
    truth = D.deriv_fd4(t, ["u1"]).select("traj_id", "seq", F.col("d_u1").alias("d_true"))
    return D.estimator_error(d.join(rich, ["traj_id", "seq"]), truth, "u1").withColumn("estimator", F.lit(est))


BLOCK_SQL = (
    "SELECT *, unnest(['all', CASE WHEN seq <= floor(n0 * 0.3e0) THEN 'first' END, CASE WHEN seq > floor(n0 * 0.35e0) AND seq <= n0 - floor(n0 * 0.35e0) THEN 'middle' END, "
    "CASE WHEN seq > n0 - floor(n0 * 0.3e0) THEN 'last' END]) AS block FROM er"
)
REPORT = RICH | {
    "nn": "SELECT *, count(*) OVER (PARTITION BY traj_id) AS n, (max(t) OVER (PARTITION BY traj_id) - min(t) OVER (PARTITION BY traj_id)) / (count(*) OVER (PARTITION BY traj_id) - 1) AS h FROM traj_events",
    "truth": f"SELECT traj_id, seq, {_fd4_sql('u1')} AS d_true FROM nn {W}",
    "er": "SELECT traj_id, seq, abs(d_u1 - d_true) AS e, r_u1 AS r, count(*) OVER (PARTITION BY traj_id) AS n0 FROM full_d JOIN truth USING (traj_id, seq) JOIN rich USING (traj_id, seq)",
    "bl": BLOCK_SQL,
    "rep": "SELECT traj_id, block, count(*) AS n, sqrt(avg(e * e)) AS rms, max(e) AS max_abs, sqrt(avg(r * r)) AS bound_rms, corr(e, r) AS corr, avg(CASE WHEN e <= r THEN 1.0 ELSE 0 END) AS covered FROM bl WHERE block IS NOT NULL GROUP BY traj_id, block",
}


#: The error bounds of decimated series, which are series of their own here: traj_id * 10 + k.
SWEEP = {"dz": "SELECT traj_id * 10 + k AS traj_id, CAST(floor((seq - 1) / k) AS INT) + 1 AS seq, t, u1, u1 AS u2 FROM traj_supplier, (VALUES (1), (2), (4)) x(k) WHERE (seq - 1) % k = 0"} | {k: q.replace("traj_events", "dz") for k, q in RICH.items()}


def _declared(v: Views, view: str, cols: list[str]) -> DataFrame:
    t = getattr(v, view)
    return t.where("seq = 1").select("traj_id", *[F.when(F.col("traj_id") % 5 != 0, F.col(c)).alias(f"i_{c}") for c in cols])


QUERIES = {
    "fit_slope": (fit_slope, FIT_SQL),
    "s02_to_trajectories": (
        lambda v: D.to_trajectories(v.events, "user_id", "ts", ["value"], ["event_id"]),
        oracle("SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value FROM events"),
    ),
    "a01_deriv_central": (lambda v: D.deriv_central(v.traj_events, EV).select("traj_id", "seq", "t", "d_u1", "d_u2"), oracle(_central_sql("traj_events", EV), "traj_events")),
    "a02_deriv_fd4": (
        lambda v: r(D.deriv_fd4(v.traj_supplier, SU).select("traj_id", "seq", "d_u1", "d_u3"), n=5),
        oracle(f"SELECT traj_id, seq, round({_fd4_sql('u1')}, 5) + 0e0 AS d_u1, round({_fd4_sql('u3')}, 5) + 0e0 AS d_u3 FROM nn {W}", "traj_supplier", nn=REPORT["nn"].replace("traj_events", "traj_supplier")),
    ),
    "a03_deriv_local_poly": (lambda v: r(D.deriv_local_poly(v.traj_events, EV).select("traj_id", "seq", "d_u1", "d_u2")), None),
    "a04_estimators": (lambda v: r(D.derivatives(v.traj_events, ["u1"], "fd4").join(D.derivatives(v.traj_events, ["u1"], "local_poly").select("traj_id", "seq", F.col("d_u1").alias("d_poly")), ["traj_id", "seq"]).select("traj_id", "seq", "d_u1", "d_poly")), None),
    "a05_coarsen": (lambda v: D.coarsen(v.traj_events), oracle(COARSE, "traj_events")),
    "a06_interp": (
        lambda v: r(D.interp_to_full(v.traj_events, D.coarsen(v.traj_events), EV), "t"),
        oracle(f"SELECT i.traj_id, i.seq, i.t, {', '.join('round(' + LERP.format(c=c) + f', 6) AS {c}' for c in EV)} {JOINS}", "traj_events", k=COARSE, i=_interp_sql("traj_events")),
    ),
    "a07_richardson": (lambda v: r(D.richardson_error(v.traj_events, EV, "central"), "t"), oracle("SELECT traj_id, seq, t, round(r_u1, 6) AS r_u1, round(r_u2, 6) AS r_u2 FROM rich", "traj_events", **RICH)),
    "a08_richardson_weights": (
        lambda v: r(D.richardson_weights(D.richardson_error(v.traj_events, EV, "central"), EV), n=8),
        oracle("SELECT traj_id, seq, round(1 / (r_u1 * r_u1 + m1 + 2.220446049250313e-16), 8) AS w_u1, round(1 / (r_u2 * r_u2 + m2 + 2.220446049250313e-16), 8) AS w_u2 FROM rich JOIN (SELECT traj_id, quantile_cont(r_u1 * r_u1, 0.5) AS m1, quantile_cont(r_u2 * r_u2, 0.5) AS m2 FROM rich GROUP BY traj_id) USING (traj_id)", "traj_events", **RICH),
    ),
    "a09_estimator_error": (
        lambda v: r(_report(v, "central").drop("col", "estimator"), n=5),
        oracle("SELECT traj_id, block, n, round(rms, 5) AS rms, round(max_abs, 5) AS max_abs, round(bound_rms, 5) AS bound_rms, round(CASE WHEN bound_rms > 0 THEN rms / bound_rms ELSE 'Infinity'::DOUBLE END, 5) AS ratio, round(corr, 5) AS corr, round(covered, 5) AS covered FROM rep", "traj_events", **REPORT),
    ),
    "a10_best_estimator": (lambda v: D.best_estimator(_report(v, "central").unionByName(_report(v, "local_poly"))).select("estimator", F.round("median_rms", 6).alias("median_rms")), None),
    "a11_active_fraction": (
        lambda v: r(D.active_fraction(D.deriv_central(v.traj_events, EV), EV)),
        oracle("SELECT traj_id, " + ", ".join(f"round(avg(CASE WHEN m_{c} > 0 AND abs(d_{c}) > 0.01e0 * m_{c} THEN 1.0e0 ELSE 0e0 END), 6) AS active_{c}" for c in EV) + " FROM m GROUP BY traj_id", "traj_events", d=_central_sql("traj_events", EV), m="SELECT *, " + ", ".join(f"max(abs(d_{c})) OVER (PARTITION BY traj_id) AS m_{c}" for c in EV) + " FROM d"),
    ),
    "a12_settle_time": (
        lambda v: D.settle_time(v.traj_events, EV),
        oracle("SELECT traj_id, " + ", ".join(f"min(CASE WHEN hi_{c} > lo_{c} AND {c} <= lo_{c} + 0.01e0 * (hi_{c} - lo_{c}) THEN t END) AS settle_{c}" for c in EV) + " FROM m GROUP BY traj_id", "traj_events", m="SELECT *, " + ", ".join(f"min({c}) OVER (PARTITION BY traj_id) AS lo_{c}, max({c}) OVER (PARTITION BY traj_id) AS hi_{c}" for c in EV) + " FROM traj_events"),
    ),
    "a13_density_sweep": (lambda v: r(D.density_bounds(v.traj_supplier, ["u1"]), n=4), oracle("SELECT traj_id // 10 AS traj_id, traj_id % 10 AS k, count(*) AS n, round(sqrt(avg(r_u1 * r_u1)), 4) AS bound_u1 FROM rich GROUP BY 1, 2", "traj_supplier", **SWEEP)),
    "a14_audit": (
        lambda v: D.audit_trajectories(v.traj_events, _declared(v, "traj_events", EV), EV),
        oracle("SELECT traj_id, count(*) AS n, min(t) AS t_min, max(t) AS t_max, traj_id % 5 <> 0 AS starts_as_declared FROM traj_events GROUP BY traj_id", "traj_events"),
    ),
    "a14_max_difference": (
        lambda v: D.max_difference(v.traj_events, v.traj_events.withColumn("seq", F.col("seq") + 1), EV),
        oracle("SELECT a.traj_id, max(abs(a.u1 - b.u1)) AS max_u1, max(abs(a.u2 - b.u2)) AS max_u2 FROM traj_events a JOIN traj_events b ON a.traj_id = b.traj_id AND a.seq = b.seq + 1 GROUP BY a.traj_id", "traj_events"),
    ),
}
