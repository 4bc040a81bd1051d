"""Cases of the third review: each failed before its finding was settled."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import regression as R
from tracewright.operators import search as S
from tracewright.operators import terms as T

B2 = T.staged_basis(2)
P = len(B2)


def drawn_factors(spark, series, pieces=1, seed=3):
    """Factor rows of random series, and the rows behind them."""
    rng = np.random.default_rng(seed)
    rows, whole = [], {}
    for i in range(series):
        a = rng.normal(size=(40 * pieces, P + 2))
        whole[i] = a
        for k in range(pieces):
            rows.append((i, k, 40 * k, 40 * (k + 1), 40, R.triangle(a[40 * k : 40 * (k + 1)]).ravel().tolist(), [0.0] * (2 * (P + 1) ** 2), [0.0] * 6))
    return spark.createDataFrame(rows, "traj_id long, block int, first int, last int, n int, plain array<double>, weighted array<double>, sums array<double>"), whole


def plan(df):
    return df._jdf.queryExecution().toString()


def test_term_sets_of_all_series_are_solved_without_a_group_a_series(spark):
    factors, whole = drawn_factors(spark, 30, pieces=2)
    sets = [(c, t, s) for t in range(31) for c, s in enumerate([[[1], [2, 7]], [[7, 2], [1]], [[], [3, 4, 5]], [[1], [2, 7]], [[6]]])]
    out = R.screen_sets(spark.createDataFrame(sets, "cand_id long, traj_id long, structure array<array<int>>"), factors, P, 2)
    assert "CoGroups" not in plan(out) and "FlatMapGroups" not in plan(out)
    rows = out.orderBy("traj_id", "cand_id").collect()
    assert len(rows) == 150  # the last series has no factors
    for r in rows:
        a = whole[r["traj_id"]]
        assert r["n"] == 80 and r["n_params"] == [len(r["structure"][e]) if e < len(r["structure"]) else 0 for e in range(2)] and r["reasons"] == ["", ""]
        for e in range(2):
            cols = [t - 1 for t in r["structure"][e]] if e < len(r["structure"]) else []
            y = a[:, P + e]
            v = a[:, cols] @ np.linalg.lstsq(a[:, cols], y, rcond=None)[0] - y if cols else -y
            assert abs(r["residuals"][e] - v @ v / 80) < 1e-10
    assert [(r["fits"], r["shared"]) for r in rows[:5]] == [(2, 0), (2, 0), (2, 0), (0, 2), (2, 0)]


def test_sets_of_the_same_terms_tie_exactly(spark):
    # the worst equation of both candidates holds the same two terms, so the smaller id wins
    factors, _ = drawn_factors(spark, 200)
    cands = spark.createDataFrame([(c, t, s) for t in range(200) for c, s in ((1, [[9, 2, 5], [1]]), (2, [[5, 9, 2], [1]]), (3, [[2, 5, 9], [1]]))], "cand_id long, traj_id long, structure array<array<int>>")
    for solver in (R.solve_many, own):
        assert S.scored(cands, factors, P, 2, scoring=S.Scoring(solver=solver)).groupBy("traj_id").agg(F.countDistinct("loss").alias("k")).where("k > 1").isEmpty()


def own(r, cols, y, n):
    a, b = r[:, cols].transpose(1, 0, 2), r[:, y].T
    c = np.linalg.solve(np.einsum("mki,mkj->mij", a, a) + 10.0 * np.eye(cols.shape[1]), np.einsum("mki,mk->mi", a, b)[..., None])[..., 0]
    e = np.einsum("mik,mk->mi", a, c) - b
    return c, (e * e).sum(1) / n


def test_fits_of_structures_need_no_group_a_series(spark):
    from tracewright.operators.discover import fit_structures

    factors, whole = drawn_factors(spark, 5)
    factors = factors.withColumn("sums", F.array(*[F.lit(float(x)) for x in (0, 0, 50, 60, 0, 0)]))
    out = fit_structures(spark.createDataFrame([(t, [[1, 3], [2]]) for t in range(5)], "traj_id long, structure array<array<int>>"), factors, P, 2)
    assert "CoGroups" not in plan(out)
    got = out.toPandas().set_index(["traj_id", "eq", "term"])
    for t, a in whole.items():
        c, *_ = np.linalg.lstsq(a[:, [0, 2]], a[:, P], rcond=None)
        assert np.allclose(got["coef"].loc[[(t, 1, 1), (t, 1, 3)]], c)
        v = a[:, [0, 2]] @ c - a[:, P]
        assert abs(got["r2"].loc[(t, 1, 1)] - (1 - v @ v / 50)) < 1e-10


def test_coupling_audit_and_equation_terms_broadcast_the_library_alone(spark):
    stages = spark.range(200).select(F.col("id").alias("traj_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("eq"), (F.col("id") % 5 + 1).cast("int").alias("stage"), F.when(F.col("id") % 3 == 0, 2).alias("cap"))
    for df in (T.coupling_audit(stages, T.terms_table(spark, B2), 5), T.equation_terms(stages, T.terms_table(spark, B2))):
        assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1


def test_comparison_rounds_ties_as_its_sql(spark, tmp_path):
    import duckdb

    from tracewright.plans import registry

    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_micros(F.when(F.col("id") == 0, 0).otherwise(F.col("id") * 360000 + 180000)).alias("ts"), F.lit(12.5).alias("value"), F.lit('{"k": 3}').alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["s08_write_comparison"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["s08_write_comparison"](spark, str(tmp_path)).select("t", "u1", "yhat1").collect()) == want


def test_running_progress_builds_no_frame_a_cell_and_has_no_limit_of_its_own(spark, tmp_path):
    import inspect

    from tracewright.plans import live
    from tracewright.streaming import heartbeats as H

    history = spark.createDataFrame([(1, 2, 5.0, 1), (2, 1, 9.0, 0)], "cell long, level int, best double, silent int")
    lines = [(1, "level", 4, 7.0), (1, "level", 3, 4.0), (1, "level", 2, 1.0), (2, "complete", None, None), (3, "level", 1, 2.5)]
    spark.createDataFrame(lines, "cell long, event string, level int, best_loss double").selectExpr("cell", "event", "level", "1 AS stage", "CAST(best_loss AS STRING) AS best_loss", "'2024-01-01T00:00:00.000000Z' AS timestamp").coalesce(1).write.json(f"{tmp_path}/in")
    out = H.run_to_table(H.running_progress(H.stream_heartbeats(spark, f"{tmp_path}/in")[0], history), f"{tmp_path}/t", "update", settings=H.STATE_STORE)
    got = {r["cell"]: (r["level"], r["best"], r["silent"], r["finished"]) for r in out.collect()}
    # level 2 is late: it lowers the best, and the levels after it stay silent
    assert got[1] == (4, 1.0, 3, False) and got[2] == (1, 9.0, 0, True) and got[3] == (1, 2.5, 0, False)
    assert not hasattr(inspect.signature(H.Progress.handleInputRows).parameters["rows"].annotation, "groupby") and "DataFrame" not in str(inspect.signature(H.Progress.handleInputRows))
    assert inspect.signature(H.run_to_table).parameters["seconds"].default is None and "seconds=" not in inspect.getsource(live)


def test_stream_merge_source_has_bounded_files(spark, monkeypatch):
    from tracewright.plans import live

    monkeypatch.setattr(live, "FILE_ROWS", 100)
    assert live._files(10) == 3 and live._files(300) == 3 and live._files(301) == 6 and live._files(10**6) == 10002


def walked(spark, series=40, n=60):
    """Series of two states; every fifth has three rows only."""
    t = spark.range(series * n).select((F.col("id") / n).cast("long").alias("traj_id"), (F.col("id") % n + 1).cast("int").alias("seq"))
    t = t.where((F.col("traj_id") % 5 > 0) | (F.col("seq") < 4)).withColumn("t", F.col("seq") * 0.1 + F.col("traj_id") * 0.01)
    return t.withColumns({"u1": F.sin(F.col("t") * 3), "u2": F.cos(F.col("t") * 2), "e_u1": F.cos(F.col("t") * 3) * 3, "e_u2": F.sin(F.col("t") * 2) * -2})


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_reference_rows_sort_once_an_estimator(spark):
    from tracewright.operators import probes as Q

    t = walked(spark)
    own = t.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).withColumn("term", F.col("eq"))
    out = Q.reference_rows(t, [x for x in B2 if x.stage == 1], ["u1", "u2"], ["e_u1", "e_u2"], own, ("central", "fd4"), (1, 2))
    assert sorts(out) == 2  # more before: the series' lengths had a sort of their own, and the join one on either side unless it was broadcast
    got = {(r["traj_id"], r["estimator"], r["eq"]): r for r in out.where("k = 2 AND split = 'all' AND kind = 'exact'").collect()}
    assert len(got) == 40 * 2 * 2
    p = t.where("traj_id = 7 AND seq % 2 = 1").orderBy("seq").toPandas()
    h = (p["t"].iloc[-1] - p["t"].iloc[0]) / (len(p) - 1)
    d = np.gradient(p["u1"].to_numpy(), h)
    u = p["u1"].to_numpy()
    d[2:-2] = (u[:-4] - 8 * u[1:-3] + 8 * u[3:-1] - u[4:]) / (12 * h)
    assert abs(got[7, "fd4", 1]["holdout_residual"] - ((p["e_u1"] - d) ** 2).mean()) < 1e-9 and got[5, "fd4", 1]["n_fit"] == 2


def test_series_are_solved_in_bounded_batches(spark):
    one = lambda x: F.array(F.lit(x))
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("traj_id"), F.lit(1).alias("seq"), one(1.0).alias("phi"), F.array(F.col("id").cast("double")).alias("d"), one(1.0).alias("w"), one(0.0).alias("rich"))
    for src in (rows, R.block_factors(rows, 1, 1)):
        got = R.in_batches(src, 1, 1, lambda m: {"together": np.full(len(m), len(m)), "total": m.sums[:, :, 0, 0].sum(1)}, "together int, total double").collect()
        assert sorted((r["traj_id"], r["total"]) for r in got) == [(i, float(i)) for i in range(3000)]
        assert max(r["together"] for r in got) <= 256


def test_derived_supports_are_solved_where_their_rows_lie(spark, sf):
    from tracewright.plans import registry

    out = registry.queries()["b14_derive_support"](spark, sf)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Join" not in text and sorts(out) == 2  # the view's sort and one of the series
    assert {(r["eq"], r["status"], r["support"]) for r in out.collect()} == {(1, "ok", "1,2"), (2, "ok", "4")}


def test_derivative_errors_of_all_estimators_share_a_sort_and_a_group(spark):
    from tracewright.operators import probes as Q

    t = walked(spark)
    out = Q.derivative_error(t, ["u1", "u2"], ["e_u1", "e_u2"], (1, 2), ("central", "fd4", "local_poly"))
    assert out.columns == ["traj_id", "k", "estimator", "eq", "n", "rms_error"]
    two = Q.derivative_error(t, ["u1", "u2"], ["e_u1", "e_u2"], (1, 2), ("central", "fd4"))
    text = two._jdf.queryExecution().executedPlan().toString()
    assert sorts(two) == 1 and text.count("Exchange hashpartitioning") == 1 and "Union" not in text
    got = {(r["traj_id"], r["k"], r["estimator"], r["eq"]): (r["n"], r["rms_error"]) for r in out.collect()}
    assert len(got) == 40 * 2 * 3 * 2 and got[5, 2, "fd4", 1][0] == 2
    for k in (1, 2):
        p = t.where(f"traj_id = 7 AND (seq - 1) % {k} = 0").orderBy("seq").toPandas()
        for e in (1, 2):
            u, h = p[f"u{e}"].to_numpy(), (p["t"].iloc[-1] - p["t"].iloc[0]) / (len(p) - 1)
            d = np.gradient(u, h)
            want = {"central": d.copy()}
            d[2:-2] = (u[:-4] - 8 * u[1:-3] + 8 * u[3:-1] - u[4:]) / (12 * h)
            want["fd4"] = d
            for estimator, x in want.items():
                n, error = got[7, k, estimator, e]
                assert n == len(p) and abs(error - np.sqrt(((x - p[f"e_u{e}"]) ** 2).mean())) < 1e-9
