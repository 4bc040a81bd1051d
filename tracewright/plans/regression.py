"""Queries that fit models in derivative space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import derivatives as D
from tracewright.operators import regression as R
from tracewright.operators import terms as T

from .derivatives import EV, REPORT, W, _central_sql, _fd4_sql, r
from .terms import SPLIT_SQL
from .views import Views, oracle

B2 = T.staged_basis(2)
P = len(B2)
LONG = "SELECT traj_id, seq, unnest([1, 2]) AS eq, unnest([d_u1, d_u2]) AS d FROM dd"
OBS = "SELECT traj_id, seq, unnest([1, 2]) AS eq, unnest([u1, u2]) AS obs, unnest([u2, u1]) AS pred FROM traj_events"
ONE = {"dd": _central_sql("traj_events", EV), "xy": "SELECT traj_id, seq, u1, u2, d_u1, d_u2 FROM dd JOIN traj_events USING (traj_id, seq)", "s1": "SELECT traj_id, sum(u1 * d_u1) / sum(u1 * u1) AS a1, sum(u2 * d_u2) / sum(u2 * u2) AS a2 FROM xy GROUP BY traj_id"}


def factors(v: Views) -> DataFrame:
    return R.block_factors(R.prepare(v.traj_events, B2, EV), P, 2)


def prepared(v: Views) -> DataFrame:
    """The rows behind them: fits of whole series factor and solve them in one go."""
    return R.prepare(v.traj_events, B2, EV)


def linear(v: Views) -> list[T.Term]:
    return [t for t in B2 if t.stage == 1]


def one_term(v: Views) -> DataFrame:
    """Least squares of du_i on u_i alone, from block factors."""
    f = R.block_factors(R.prepare(v.traj_events, linear(v), EV), 2, 2)
    a, b = (R.fit_ols(f, 2, 2, [i]).where(F.col("eq") == i + 1) for i in (0, 1))
    return r(a.unionByName(b).select("traj_id", "eq", "term", "coef"))


def deriv_long(v: Views) -> DataFrame:
    return D.to_long(D.deriv_central(v.traj_events, EV).select("traj_id", "seq", "t", "d_u1", "d_u2"), ["d_u1", "d_u2"]).select("traj_id", "seq", "eq", F.col("value").alias("d"))


def pairs(v: Views) -> DataFrame:
    """Observed states against each other: eq, obs, pred."""
    t = v.traj_events
    return t.select("traj_id", "seq", F.explode(F.array(F.struct(F.lit(1).alias("eq"), F.col("u1").alias("obs"), F.col("u2").alias("pred")), F.struct(F.lit(2).alias("eq"), F.col("u2").alias("obs"), F.col("u1").alias("pred")))).alias("x")).select("traj_id", "seq", "x.*")


def rhs_linear(v: Views) -> DataFrame:
    """Right-hand sides of du_i = a_i u_i with a_i = 1 + traj_id mod 3."""
    coefs = v.traj_events.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq"), (1.0 + F.col("traj_id") % 3).alias("coef")).withColumn("term", F.col("eq"))
    return T.eval_rhs(v.traj_events, B2, coefs)


RHS = {"dd": ONE["dd"], "rh": "SELECT traj_id, seq, eq, d, CASE WHEN eq = 1 THEN u1 ELSE u2 END * (1 + traj_id % 3) AS rhs FROM (" + LONG + ") q JOIN traj_events USING (traj_id, seq)"}


def structures(v: Views) -> DataFrame:
    """cand_id, traj_id, structure: hashed two-equation structures over all series of events."""
    n = v.events.agg(F.countDistinct("user_id")).first()[0]
    t = v.part.select(F.col("p_partkey").alias("cand_id"), (F.col("p_partkey") % n).alias("traj_id"), "p_size")
    return t.select("cand_id", "traj_id", F.array(F.array_distinct(F.array((F.col("p_size") % 11 + 1).cast("int"), (F.col("cand_id") % 11 + 1).cast("int"))), F.array((F.col("cand_id") % 5 + 1).cast("int"))).alias("structure"))


#: Sums of products of the library's terms and derivatives by series, and the candidates' fits by elimination.
SCREEN = {
    **ONE,
    "ph": "SELECT traj_id, [u1, u2, u1 * u1, u2 * u2, u1 * u2, u1 * u1 * u1, u2 * u2 * u2, sin(u1), cos(u1), sin(u2), cos(u2)] AS p, [d_u1, d_u2] AS d FROM xy",
    "gm": "SELECT traj_id, i, j, sum(p[i] * p[j]) AS s FROM ph, range(1, 12) a(i), range(1, 12) b(j) GROUP BY ALL",
    "bm": "SELECT traj_id, i, e, sum(p[i] * d[e]) AS s, sum(d[e] * d[e]) AS yy, count(*) AS n FROM ph, range(1, 12) a(i), range(1, 3) b(e) GROUP BY ALL",
    "ca": "SELECT p_partkey AS cand_id, p_partkey % (SELECT count(DISTINCT user_id) FROM events) AS traj_id, p_size % 11 + 1 AS a, p_partkey % 11 + 1 AS b, p_partkey % 5 + 1 AS c FROM part",
    "te": "SELECT cand_id, traj_id, 1 AS eq, a AS i, CASE WHEN a <> b THEN b END AS j FROM ca UNION ALL SELECT cand_id, traj_id, 2, c, NULL FROM ca",
    "sc": "SELECT t.cand_id, t.traj_id, t.eq, x.n, CASE WHEN t.j IS NULL THEN 1 ELSE 2 END AS n_params, "
    "(x.yy - CASE WHEN t.j IS NULL THEN x.s * x.s / g.s ELSE (h.s * x.s * x.s - 2 * k.s * x.s * y.s + g.s * y.s * y.s) / (g.s * h.s - k.s * k.s) END) / x.n AS residual FROM te t "
    "JOIN gm g ON g.traj_id = t.traj_id AND g.i = t.i AND g.j = t.i JOIN bm x ON x.traj_id = t.traj_id AND x.i = t.i AND x.e = t.eq "
    "LEFT JOIN gm h ON h.traj_id = t.traj_id AND h.i = t.j AND h.j = t.j LEFT JOIN gm k ON k.traj_id = t.traj_id AND k.i = t.i AND k.j = t.j LEFT JOIN bm y ON y.traj_id = t.traj_id AND y.i = t.j AND y.e = t.eq",
}
RIDGE = {
    **ONE,
    "sm": "SELECT traj_id, sum(u1 * u1) + 1e-8 AS a, sum(u1 * u2) AS b, sum(u2 * u2) + 1e-8 AS c, [sum(u1 * d_u1), sum(u1 * d_u2)] AS x, [sum(u2 * d_u1), sum(u2 * d_u2)] AS y FROM xy GROUP BY 1",
}


def fit_eval(v: Views) -> DataFrame:
    from tracewright.operators import stagecaps as C

    return r(C.stage_table(v.traj_events, B2, EV, C.CapPolicy()).select("traj_id", "eq", "split", "stage", F.when(F.col("usable"), F.col("residual")).alias("residual"), "usable", "rank"), n=4)


QUERIES = {
    "b01_fit_one_term": (one_term, oracle("SELECT traj_id, 1 AS eq, 1 AS term, round(a1, 6) + 0e0 AS coef FROM s1 UNION ALL SELECT traj_id, 2, 2, round(a2, 6) + 0e0 FROM s1", "traj_events", **ONE)),
    "b01_fit_ols": (lambda v: r(R.fit_ols(prepared(v), P, 2), n=4), None),
    "u01_custom_basis": (
        # du1/dt on one term of one's own
        lambda v: r(R.fit_ols(R.block_factors(R.prepare(v.traj_events, T.custom_basis([("u1-u2", 1, (1, 2), lambda u: u[0] - u[1])]), EV), 1, 2), 1, 2).where("eq = 1").select("traj_id", "coef")),
        oracle("SELECT traj_id, round(sum((u1 - u2) * d_u1) / sum((u1 - u2) * (u1 - u2)), 6) + 0e0 AS coef FROM xy GROUP BY 1", "traj_events", **ONE),
    ),
    "b02_warm_start": (lambda v: r(R.warm_start(R.fit_ols(prepared(v), P, 2).select("traj_id", "eq", "term", "coef"), 1e3), n=4), None),
    "b02_warm_start_linear": (
        # two terms an equation, so that the norm limit and the fit have a closed form
        lambda v: r(R.warm_start(R.fit_ols(R.block_factors(R.prepare(v.traj_events, linear(v), EV), 2, 2), 2, 2).select("traj_id", "eq", "term", "coef"), 0.5), n=5),
        oracle("SELECT traj_id, eq, term, round(CASE WHEN sqrt(k1 * k1 + k2 * k2) <= 0.5e0 THEN CASE WHEN term = 1 THEN k1 ELSE k2 END ELSE 0 END, 5) + 0e0 AS coef FROM (SELECT traj_id, eq, (c * x[eq] - b * y[eq]) / (a * c - b * b) AS k1, (a * y[eq] - b * x[eq]) / (a * c - b * b) AS k2 FROM (SELECT * REPLACE (a - 1e-8 AS a, c - 1e-8 AS c) FROM sm), (VALUES (1), (2)) e(eq)) q, (VALUES (1), (2)) t(term)", "traj_events", **RIDGE),
    ),
    "b03_screen": (lambda v: r(R.screen(structures(v), factors(v), P, 2), n=6), oracle("SELECT cand_id, traj_id, eq, n, n_params, round(residual, 6) + 0e0 AS residual, true AS valid, '' AS reasons FROM sc", "traj_events", **SCREEN)),
    "b03_pool": (lambda v: r(R.pool(R.screen(structures(v), factors(v), P, 2)), n=6), oracle("SELECT traj_id, cand_id, max(n) AS n, sum(n_params) AS n_params, round(avg(residual), 6) + 0e0 AS residual, true AS valid, '' AS reasons FROM sc GROUP BY 1, 2", "traj_events", **SCREEN)),
    "b04_fit_eval": (fit_eval, None),
    "b05_fit_ridge": (lambda v: r(R.fit_ridge(R.block_factors(R.prepare(v.traj_events, linear(v), EV), 2, 2), 2, 2), n=5), oracle("SELECT traj_id, eq, term, round(CASE WHEN term = 1 THEN (c * x[eq] - b * y[eq]) ELSE (a * y[eq] - b * x[eq]) END / (a * c - b * b), 5) + 0e0 AS coef FROM sm, (VALUES (1), (2)) e(eq), (VALUES (1), (2)) t(term)", "traj_events", **RIDGE)),
    "b06_nmse": (
        lambda v: r(R.nmse(pairs(v), ["traj_id", "eq"], "obs", "pred")),
        oracle("SELECT traj_id, eq, round(CASE WHEN var_pop(obs) > 2.220446049250313e-16 THEN avg((obs - pred) * (obs - pred)) / var_pop(obs) ELSE 'Infinity'::DOUBLE END, 6) AS nmse FROM ob GROUP BY 1, 2", "traj_events", ob=OBS),
    ),
    "b07_fit_gate": (lambda v: fit_eval(v).groupBy("split", "stage").agg(F.count_if("usable").alias("usable"), F.count_if(~F.col("usable")).alias("rejected")), None),
    "b08_eq_residual": (
        lambda v: r(R.eq_residual(rhs_linear(v), deriv_long(v)), n=5),
        oracle("SELECT traj_id, eq, round(avg((d - rhs) * (d - rhs)), 5) AS residual, true AS ok FROM rh GROUP BY 1, 2", "traj_events", **RHS),
    ),
    "b09_derivative_metrics": (
        lambda v: r(R.derivative_metrics(rhs_linear(v).join(deriv_long(v), ["traj_id", "seq", "eq"])), n=5),
        oracle("SELECT traj_id, count(*) AS n, round(sqrt(avg((d - rhs) * (d - rhs))), 5) AS rmse, round(avg(abs(d - rhs)), 5) AS mae, round(avg((d - rhs) * (d - rhs)), 5) AS mse FROM (SELECT *, max(seq) OVER (PARTITION BY traj_id) AS n FROM rh) q WHERE n <= 4 OR (seq > 2 AND seq <= n - 2) GROUP BY 1", "traj_events", **RHS),
    ),
    "b10_mse_loss": (
        lambda v: r(R.mse_loss(pairs(v).withColumn("pred", F.when(F.col("pred") < 1.99, F.col("pred"))), ["traj_id", "eq"], "obs", "pred")),
        oracle("SELECT traj_id, eq, round(CASE WHEN bool_or(pred >= 1.99) THEN 1e6 ELSE avg((obs - pred) * (obs - pred)) END, 6) AS loss FROM ob GROUP BY 1, 2", "traj_events", ob=OBS),
    ),
    "b11_r2": (
        lambda v: r(R.r2(pairs(v), ["traj_id"], "obs", "pred")),
        oracle("SELECT traj_id, round(CASE WHEN bool_and(sst > 0) AND sum(sse) / sum(n) < 1e6 THEN avg(1 - sse / sst) END, 6) AS r2, round(sum(sse) / sum(n), 6) AS loss FROM (SELECT traj_id, eq, count(*) AS n, sum((obs - pred) * (obs - pred)) AS sse, sum((obs - m) * (obs - m)) AS sst FROM (SELECT *, avg(obs) OVER (PARTITION BY traj_id, eq) AS m FROM ob) a GROUP BY 1, 2) b GROUP BY 1", "traj_events", ob=OBS),
    ),
    "b12_null_baseline": (
        lambda v: r(R.null_baseline(v.traj_events, EV)),
        oracle("SELECT traj_id, round((sum((u1 - f1) * (u1 - f1)) + sum((u2 - f2) * (u2 - f2))) / (2 * count(*)), 6) AS loss FROM (SELECT *, first_value(u1) OVER w AS f1, first_value(u2) OVER w AS f2 FROM traj_events WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) q GROUP BY 1", "traj_events"),
    ),
    "b13_full_basis_reference": (
        lambda v: r(R.fit_ols(prepared(v), P, 2).groupBy("traj_id", "eq").agg(F.max("mse").alias("mse"), F.max("r2").alias("r2"), F.sqrt(F.sum(F.col("coef") * F.col("coef"))).alias("norm"), F.max("rank").alias("rank")), n=4),
        None,
    ),
    "b14_derive_support": (
        # a series whose derivative is an exact combination of terms: the state itself
        lambda v: R.derive_support(R.prepare_given(v.traj_events.withColumns({"e_u1": F.col("u1") * 2 - F.col("u2"), "e_u2": F.col("u2") * F.col("u2")}), B2, ["e_u1", "e_u2"]), P, 2).select("traj_id", "eq", "status", F.concat_ws(",", F.transform("support", lambda x: x.cast("string"))).alias("support")),
        oracle("SELECT DISTINCT traj_id, eq, 'ok' AS status, CASE WHEN eq = 1 THEN '1,2' ELSE '4' END AS support FROM traj_events, (VALUES (1), (2)) e(eq)", "traj_events"),
    ),
    "b15_support_countercheck": (
        lambda v: T.support_match(T.prune(R.fit_ols(prepared(v), P, 2).withColumnRenamed("traj_id", "run_id"), relative=0.05), T.prune(R.fit_ridge(prepared(v), P, 2).withColumnRenamed("traj_id", "run_id"), relative=0.05)),
        None,
    ),
    "b16_noise_floor": (
        lambda v: r(R.noise_floor(T.splits(v.traj_events), deriv_long(v).join(D.to_long(D.deriv_fd4(v.traj_events, EV).select("traj_id", "seq", "t", "d_u1", "d_u2"), ["d_u1", "d_u2"]).select("traj_id", "seq", "eq", F.col("value").alias("d_exact")), ["traj_id", "seq", "eq"])), n=5),
        oracle("SELECT traj_id, eq, x.split AS split, CASE WHEN x.h THEN 'holdout' ELSE 'fit' END AS role, round(avg(e * e), 5) AS floor FROM sp JOIN de USING (traj_id, seq) GROUP BY ALL", "traj_events", dd=ONE["dd"], nn=REPORT["nn"], f4=f"SELECT traj_id, seq, {_fd4_sql('u1')} AS e1, {_fd4_sql('u2')} AS e2 FROM nn {W}", de="SELECT traj_id, seq, unnest([1, 2]) AS eq, unnest([d_u1 - e1, d_u2 - e2]) AS e FROM dd JOIN f4 USING (traj_id, seq)", sp=SPLIT_SQL),
    ),
    "b17_contamination": (
        lambda v: r(R.eq_residual(rhs_linear(v), deriv_long(v)).join(v.traj_events.groupBy("traj_id").agg(F.max("seq").alias("n")), "traj_id").groupBy("eq").agg(F.count(F.lit(1)).alias("series"), F.avg("residual").alias("mean_residual")), n=4),
        oracle("SELECT eq, count(*) AS series, round(avg(m), 4) AS mean_residual FROM (SELECT traj_id, eq, avg((d - rhs) * (d - rhs)) AS m FROM rh GROUP BY 1, 2) q GROUP BY 1", "traj_events", **RHS),
    ),
}
