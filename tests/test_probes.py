"""Factors by composite keys and ranges, densities, reference rows, scorings and costs against plain numpy and plain counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import derivatives as D
from tracewright.operators import probes as P
from tracewright.operators import regression as R
from tracewright.operators import search as S
from tracewright.operators import stagecaps as C
from tracewright.operators import terms as T
from tracewright.operators.discover import discover, evolutionary

COLS = ["u1", "u2"]
B2 = T.staged_basis(2)


@pytest.fixture(scope="module")
def frame():
    """Four noisy series of different lengths, one of them of a single row, with known derivatives e1, e2."""
    g, rows = np.random.default_rng(5), []
    for k, n in ((1, 61), (2, 40), (3, 7), (4, 1)):
        t = np.cumsum(g.uniform(0.05, 0.15, n))
        u1, u2 = np.exp(-0.3 * t) + 0.01 * g.standard_normal(n), np.cos(t) + 0.01 * g.standard_normal(n)
        rows += [(k, i + 1, float(t[i]), float(u1[i]), float(u2[i]), float(-0.3 * u1[i]), float(-np.sin(t[i]))) for i in range(n)]
    return pd.DataFrame(rows, columns=["traj_id", "seq", "t", "u1", "u2", "e1", "e2"])


@pytest.fixture(scope="module")
def traj(spark, frame):
    return spark.createDataFrame(frame).withColumn("seq", F.col("seq").cast("int"))


def held(n):
    seq = np.arange(1, n + 1)
    k, m, q = int(0.3 * n), int(0.35 * n), [int(x * n) for x in (0.25, 0.5, 0.75)]
    return {"A": seq > n - k, "B": seq <= k, "C": (seq > m) & (seq <= n - m), "D": ((seq > q[0]) & (seq <= q[1])) | (seq > q[2])}


def phi(g):
    u = [g["u1"].to_numpy(), g["u2"].to_numpy()]
    return np.column_stack([u[0], u[1], u[0] ** 2, u[1] ** 2, u[0] * u[1], u[0] ** 3, u[1] ** 3, np.sin(u[0]), np.cos(u[0]), np.sin(u[1]), np.cos(u[1])])


@pytest.mark.parametrize("estimator", ["central", "fd4", "local_poly"])
def test_ranges_equal_whole_series(traj, estimator):
    """Ranges with halos give bit for bit what one window over a series gives."""
    key = lambda df: sorted(tuple(r) for r in df.select("traj_id", "seq", "d_u1", "d_u2", "r_u1", "r_u2").collect())
    whole = key(D.with_errors(traj, COLS, estimator))
    for rows in (10, 16, 23):
        assert key(D.with_errors(traj, COLS, estimator, rows=rows)) == whole


def test_ranges_spread_a_series(traj):
    parts = D.ranged(traj, 3, rows=10).where("__core").groupBy("traj_id", "__range").count().collect()
    assert sorted((r["traj_id"], r["__range"]) for r in parts) == [(1, i) for i in range(7)] + [(2, i) for i in range(4)] + [(3, 0), (4, 0)] and max(r["count"] for r in parts) == 10
    with pytest.raises(ValueError):
        D.ranged(traj, 10, rows=10)


def test_half_grid_is_a_series_of_its_own(traj, frame):
    """The error bound against derivatives of the thinned-out series, interpolated by time."""
    got = {(r["traj_id"], r["seq"]): r["r_u2"] for r in D.with_errors(traj, COLS, "local_poly").collect()}
    full = {(r["traj_id"], r["seq"]): r["d_u2"] for r in D.deriv_local_poly(traj, COLS).collect()}
    half = D.deriv_local_poly(D.coarsen(traj), COLS).toPandas()
    for k, g in frame.groupby("traj_id"):
        h = half[half["traj_id"] == k].sort_values("t")
        for s, t in zip(g["seq"], g["t"], strict=True):
            assert got[k, s] == pytest.approx(abs(full[k, s] - np.interp(t, h["t"], h["d_u2"])), abs=1e-9)


@pytest.mark.parametrize("rows", [None, 8])
def test_stage_table_of_ranges_and_keys(spark, traj, rows):
    """Series spread over ranges, and series under a key of two columns, have the same stage table."""
    plain = {(r["traj_id"], r["eq"], r["split"], r["stage"]): r for r in C.stage_table(traj, B2, COLS, C.CapPolicy()).collect()}
    other = C.stage_table(traj.withColumn("name", F.concat(F.lit("x"), "traj_id")).withColumn("part", F.lit(None).cast("double")), B2, COLS, C.CapPolicy(), ["name", "part"], rows).collect()
    assert len(other) == len(plain) == 4 * 2 * 4 * 5
    for r in other:
        want = plain[int(r["name"][1:]), r["eq"], r["split"], r["stage"]]
        assert (r["usable"], r["rank"]) == (want["usable"], want["rank"])
        if want["usable"]:
            assert r["residual"] == pytest.approx(want["residual"], rel=1e-6) and r["floor_ms"] == pytest.approx(want["floor_ms"], rel=1e-9)


def test_density_sweep(traj, frame):
    """Weighted holdout residuals at two densities by direct least squares, rank flags, and cliffs."""
    sweep = P.density_sweep(traj, B2, COLS, (1, 3))
    rows = {(r["traj_id"], r["k"], r["eq"], r["split"], r["stage"]): r for r in sweep.collect()}
    assert len(rows) == 4 * 2 * 2 * 4 * 5
    for k in (1, 3):
        g = frame[(frame["traj_id"] == 1) & ((frame["seq"] - 1) % k == 0)].reset_index(drop=True)
        d = R.prepare(D.decimated(traj, (k,)).where("traj_id = 1"), B2, COLS).orderBy("seq").toPandas()
        x, n = phi(g), len(g)
        y, w, rich = (np.stack(d[c].to_numpy()) for c in ("d", "w", "rich"))
        for split, h in held(n).items():
            for stage, cols in ((1, 2), (2, 4), (3, 5)):
                root = np.sqrt(w[~h, 0])
                c = np.linalg.lstsq(x[~h, :cols] * root[:, None], y[~h, 0] * root, rcond=None)[0]
                r = rows[1, k, 1, split, stage]
                assert r["residual"] == pytest.approx(np.mean((x[h, :cols] @ c - y[h, 0]) ** 2), rel=1e-5) and r["floor_ms"] == pytest.approx(np.mean(rich[h, 0] ** 2))
                assert not r["rank_deficient"]
    # seven rows, every third: three are too few for the library's later stages
    assert rows[3, 3, 1, "A", 5]["rank_deficient"] and not rows[3, 3, 1, "A", 5]["usable"]
    expected = traj.select("traj_id").distinct().select("traj_id", F.lit(1).alias("eq"), F.lit(2).alias("expected"))
    for r in P.true_stage_cliff(sweep, expected).collect():
        a, b = rows[r["traj_id"], r["k"], 1, r["split"], 1], rows[r["traj_id"], r["k"], 1, r["split"], 2]
        assert r["true_residual"] == b["residual"] and r["true_rank_deficient"] == b["rank_deficient"] and r["watch_rank_deficient"] == rows[r["traj_id"], r["k"], 1, r["split"], 3]["rank_deficient"]
        if np.isfinite(a["residual"]) and np.isfinite(b["residual"]):
            assert r["cliff"] == a["residual"] - b["residual"] and r["cliff_visible"] == (r["cliff"] > b["floor_ms"])
    with pytest.raises(ValueError):
        P.density_sweep(traj, B2, COLS, (1, 1))


def test_reference_rows(spark, traj, frame):
    """Fits of supports that differ by series and equation, of stages, and residuals of known derivatives, split by split."""
    own = {(1, 1): [1, 3], (1, 2): [2], (2, 1): [5], (2, 2): [2, 4, 11], (3, 1): [1], (3, 2): []}
    supports = spark.createDataFrame([(k, e, t) for (k, e), ts in own.items() for t in ts], "traj_id long, eq int, term int")
    rows = P.reference_rows(traj, B2, COLS, ["e1", "e2"], supports, ("central", "fd4"), (1, 2), stages=True).collect()
    # the fourth series has no support and is left out
    assert len(rows) == 3 * 2 * 2 * 5 * 2 * (1 + 1 + 5)
    for r in rows:
        if r["n_holdout"] == 0:
            assert r["holdout_residual"] == float("inf") and not r["valid"]
            continue
        g = frame[(frame["traj_id"] == r["traj_id"]) & ((frame["seq"] - 1) % r["k"] == 0)].reset_index(drop=True)
        n, e = len(g), r["eq"] - 1
        h = held(n) | {"all": np.ones(n, bool)}
        h = h[r["split"]]
        f = ~h if r["split"] != "all" else h
        t, u = g["t"].to_numpy(), g[COLS[e]].to_numpy()
        if r["estimator"] == "central":
            d = np.array([(u[min(i + 1, n - 1)] - u[max(i - 1, 0)]) / (t[min(i + 1, n - 1)] - t[max(i - 1, 0)]) for i in range(n)])
        else:
            if n < 9:
                continue
            step = (t[-1] - t[0]) / (n - 1)
            d = np.gradient(u, step)
            d[2:-2] = (u[:-4] - 8 * u[1:-3] + 8 * u[3:-1] - u[4:]) / (12 * step)
        if r["kind"] == "exact":
            z = g[f"e{e + 1}"].to_numpy() - d
        else:
            cols = list(range({1: 2, 2: 4, 3: 5, 4: 7, 5: 11}[r["stage"]])) if r["kind"] == "stage" else [x - 1 for x in own[r["traj_id"], r["eq"]]]
            assert r["terms"] == ",".join(str(x + 1) for x in cols)
            x = phi(g)[:, cols]
            c = np.linalg.lstsq(x[f], d[f], rcond=None)[0] if cols else np.zeros(0)
            if len(cols) >= f.sum() or (cols and np.linalg.cond(x[f]) > 1e6):
                continue
            assert r["coefs"] == pytest.approx(c.tolist(), rel=1e-4, abs=1e-6) and r["rank"] == len(cols)
            z = x @ c - d
        assert r["train_residual"] == pytest.approx(np.mean(z[f] ** 2), rel=1e-6, abs=1e-12) and r["holdout_residual"] == pytest.approx(np.mean(z[h] ** 2), rel=1e-6, abs=1e-12)
        if np.var(d[h]) > 1e-12:
            assert r["normalised"] == pytest.approx(np.mean(z[h] ** 2) / np.var(d[h]), rel=1e-6)


def test_known_derivatives_have_no_floor(traj):
    """With exact derivatives of a linear equation every stage fits exactly, so that thresholds decide nothing."""
    table = C.stage_table_given(traj.where("traj_id < 3"), B2, ["e1", "e2"], C.CapPolicy())
    assert all(r["floor_ms"] == 0 for r in table.collect())
    assert all(r["residual"] < 1e-20 for r in table.where("eq = 1 and stage <= 3").collect())


@pytest.mark.parametrize("mode", ["majority"])
def test_sensitivity_is_a_decision_for_every_pair(traj, mode):
    """Caps and branches of the grid equal those of policies with the scaled thresholds, one at a time."""
    table = C.stage_table(traj.where("traj_id < 4"), B2, COLS, C.CapPolicy())
    got = {(r["traj_id"], r["eq"], r["rel_factor"], r["abs_factor"]): (r["cap"], r["branch"]) for r in C.sensitivity(table, (0.1, 1000.0), (1.0, 1e6)).collect()}
    assert len(got) == 3 * 2 * 4
    for a in (0.1, 1000.0):
        for b in (1.0, 1e6):
            d = C.decide(table.drop("rank", "cond"), C.policy_struct(C.CapPolicy(tau_rel=1e-4 * a, tau_abs=1e-8 * b)), branches=True)
            caps = {(r["traj_id"], r["eq"]): r["cap"] for r in C.vote(d, mode).collect()}
            by = {}
            for r in d.collect():
                by.setdefault((r["traj_id"], r["eq"]), []).append(r["branch"])
            for k, v in by.items():
                assert got[(*k, a, b)] == (caps[k], min(set(v), key=lambda x: (-v.count(x), x))) and set(v) <= set(C.BRANCHES)


def test_costs_equal_a_recount(traj):
    """Fits are distinct term sets, shared ones the rest; levels add up; invalid candidates are told with their reasons."""
    policy = S.SearchPolicy(max_levels=4, pop_size=6, children=3)
    factors = S.cut(R.block_factors(R.prepare(traj.where("traj_id < 3"), B2, COLS), 11, 2))
    _, log = S.grow(factors, B2, 2, policy)
    for r in log.collect():
        n = 6 * 3 + (6 if r["level"] == 1 else 0)
        assert r["evaluations"] == n and r["fits"] + r["shared"] == 2 * n and r["fits"] > 0 and r["invalid"] == 0 and r["codes"] == []
    total = {r["traj_id"]: r for r in S.run_costs(log).collect()}
    assert all(t["evaluations"] == 6 + t["levels"] * 18 for t in total.values())
    _, screened = S.grow(factors, B2, 2, S.SearchPolicy(max_levels=3, pop_size=6, children=3, screen_k=4))
    assert all(r["evaluations"] == 18 + (6 if r["level"] == 1 else 0) for r in screened.collect())
    _, gp = S.gp_search(factors, B2, 2, policy)
    assert all(r["evaluations"] == (12 if r["level"] == 1 else 6) for r in gp.collect())
    cands = traj.sparkSession.createDataFrame([(1, 1, [[1], [2]]), (1, 2, [[1], [2, 3]]), (1, 3, [[1, 2], [2]])], "traj_id long, cand_id long, structure array<array<int>>")
    broken = lambda r, cols, y, n: (np.full((len(y), cols.shape[1]), np.nan if cols.shape[1] > 1 else 1.0), np.ones(len(y)))
    c = S.costs(S.scored(cands, factors, 11, 2, scoring=S.Scoring(solver=broken)), "traj_id").first()
    assert (c["evaluations"], c["fits"], c["shared"], c["invalid"], c["codes"]) == (3, 4, 2, 2, ["non_finite_coefficients"])


def test_own_loss_in_searches(traj):
    """The loss that a search reports is one's own loss of its structure's residuals."""
    rows = R.prepare(traj.where("traj_id < 3"), B2, COLS)
    factors = S.cut(R.block_factors(rows, 11, 2))
    data = {k: (np.stack(g["phi"].to_numpy()), np.stack(g["d"].to_numpy())) for k, g in rows.toPandas().sort_values("seq").groupby("traj_id")}

    def residuals(r):
        x, d = data[r["traj_id"]]
        return [np.mean((x[:, [t - 1 for t in s]] @ np.linalg.lstsq(x[:, [t - 1 for t in s]], d[:, e], rcond=None)[0] - d[:, e]) ** 2) for e, s in enumerate(r["structure"])]

    for best, _ in (S.grow(factors, B2, 2, S.SearchPolicy(max_levels=3), scoring=S.Scoring(loss=S.worst_loss)), S.gp_search(factors, B2, 2, S.SearchPolicy(max_levels=3), scoring=S.Scoring(loss=S.worst_loss))):
        for r in best.collect():
            assert r["loss"] == pytest.approx(max(residuals(r)), rel=1e-6)
    records, log = discover(traj.where("traj_id < 3"), B2, COLS, S.SearchPolicy(max_levels=3), scoring=S.Scoring(loss=S.information_loss), search=evolutionary)
    spent = {r["traj_id"]: r["evaluations"] for r in S.run_costs(log).collect()}
    for r in records.collect():
        assert r["evaluations"] == spent[r["traj_id"]] and r["final_stages"] is None and r["promotions"] == 0 and len(r["support_terms"]) == 2


def test_cap_audit_counts(spark):
    caps = lambda rows: spark.createDataFrame(rows, "traj_id long, eq int, cap int")
    new, base = caps([(1, 1, 2), (2, 1, None), (3, 1, 4), (4, 1, None)]), caps([(1, 1, 2), (2, 1, 3), (3, 1, None), (4, 1, None)])
    targets = spark.createDataFrame([(3, 1, 4), (4, 1, None), (1, 1, 3), (9, 1, None)], "traj_id long, eq int, expected int")
    r = C.cap_audit(new, base, caps([(2, 1, None), (2, 1, None)]), targets).first()
    assert r.asDict() == {"rows": 4, "changed": 2, "violations": 1, "finite_before": 2, "finite_after": 2, "targets": 4, "targets_met": 2, "targets_missing": 1}
