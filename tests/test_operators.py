"""Golden cases and numpy references for what SQL can't express, and errors."""

import dataclasses
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import campaign as E
from tracewright.operators import derivatives as D
from tracewright.operators import regression as R
from tracewright.operators import search as S
from tracewright.operators import stagecaps as C
from tracewright.operators import terms as T
from tracewright.operators.discover import discover
from tracewright.plans.search import GROW
from tracewright.sources import records as SR

INF = float("inf")


def logistic(n=60):
    """x' = r x (1 - x / K), in closed form."""
    t = np.linspace(0, 4, n)
    r, k, x0 = 0.79, 74.3, 7.3
    return t, k / (1 + (k / x0 - 1) * np.exp(-r * t)), r, k


@pytest.fixture(scope="module")
def growth(spark):
    t, x, _, _ = logistic()
    return spark.createDataFrame([(1, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "traj_id long, seq int, t double, u1 double")


def decide(spark, res, ok, floors, stages, **k):
    rows = [(1, 1, "A", s, float(res[s - 1]), float(floors[s - 1]), ok[s - 1]) for s in stages]
    df = spark.createDataFrame(rows, "traj_id long, eq int, split string, stage int, residual double, floor_ms double, usable boolean")
    r = C.decide(df, C.policy_struct(C.CapPolicy(**k))).first()
    return r["kind"], r["cap"], r["stage"]


@pytest.mark.parametrize(
    "res, ok, floors, stages, want",
    [
        ([10, 11, 1e-12], [True] * 3, [1e-10] * 3, [1, 2, 3], ("positive", 3, 3)),
        ([1e-12, 1e-13], [True] * 2, [1e-10] * 2, [1, 2], ("undecidable", None, 1)),
        ([10, 11, 0.1], [True] * 3, [1e-3] * 3, [1, 2, 3], ("positive", 3, 3)),
        ([10, 0.1], [True, False], [1e-3] * 2, [1, 2], ("invalid", None, 2)),
        ([1e-12, 2e-12, 5e-13], [True] * 3, [1e-14] * 3, [1, 2, 3], ("undecidable", None, 1)),
    ],
)
def test_split_decision(spark, res, ok, floors, stages, want):
    assert decide(spark, res, ok, floors, stages, tau_abs=1e-6, horizon=2) == want


def test_empty_stage_is_not_counted(spark):
    assert decide(spark, [10, INF, 0.1], [True, False, True], [1e-3] * 3, [1, 3], tau_abs=1e-6, horizon=1) == ("positive", 3, 3)


@pytest.mark.parametrize("last, cap", [(0.2, 3), (0.8, 2), (0.5, 2)])
def test_after_the_floor(spark, last, cap):
    assert decide(spark, [10, 1, last], [True] * 3, [0.1, 2, 2], [1, 2, 3]) == ("positive", cap, cap)


def test_gain_rule(spark):
    one = spark.range(1)
    g = lambda *x: one.select(C.counts_gain(*[F.lit(float(v)) for v in x])).first()[0]
    assert g(1e-7, 1e-12, 1e-10, 1e-4, 1e-6)
    assert not g(1.0001e-10, 1e-10, 1e-12, 1e-2, 1e-12)


def test_policy_errors():
    for bad in ({"horizon": 0}, {"aggregation": "x"}, {"drop_ratio": -1.0}):
        with pytest.raises(ValueError):
            C.CapPolicy(**bad).check()


def test_logistic_cap(spark, growth):
    """The logistic law needs stage 2; a cap that the data supports is never below it."""
    rows = C.estimate_stage_caps(growth, T.staged_basis(1), ["u1"], C.CapPolicy(estimator="local_poly")).collect()
    assert len(rows) == 1 and (rows[0]["cap"] is None or rows[0]["cap"] >= 2)


def test_grow_passes_all_stages(spark, growth):
    """By the queries' policy (with a tolerance that makes every level flat) all stages open, and a cap of 1 keeps u^2 out."""
    basis, policy = T.staged_basis(1), dataclasses.replace(GROW, plateau_tol=1e9, pop_size=4)
    f = R.block_factors(R.prepare(growth, basis, ["u1"]), len(basis), 1).cache()
    caps = spark.createDataFrame([(1, 1, 1)], "traj_id long, eq int, cap int")
    stage = [t.stage for t in basis]
    free, log = S.grow(f, basis, 1, policy)
    assert {max(r["stages"]) for r in log.collect()} == set(range(1, max(stage) + 1))
    used = lambda best: max(stage[i - 1] for i in best.first()["structure"][0])
    # stage 2 is open from level 4 on
    capped, _ = S.grow(f, basis, 1, dataclasses.replace(policy, max_levels=5), caps)
    assert used(free) > 1 and used(capped) == 1


def test_local_polynomial(spark, growth):
    t, x, r, k = logistic()
    got = [y["d_u1"] for y in D.deriv_local_poly(growth, ["u1"]).orderBy("seq").collect()]
    want = []
    for i in range(len(t)):
        a, b = max(0, i - 4), min(len(t), i + 5)
        want.append(np.polyfit(t[a:b] - t[i], x[a:b], 3)[2])
    assert np.allclose(got, want, rtol=1e-8)
    exact = r * x * (1 - x / k)
    cen = [y["d_u1"] for y in D.deriv_central(growth, ["u1"]).orderBy("seq").collect()]
    fd4 = [y["d_u1"] for y in D.deriv_fd4(growth, ["u1"]).orderBy("seq").collect()]
    inner = slice(4, -4)
    assert np.abs(np.array(fd4) - exact)[inner].max() < np.abs(np.array(cen) - exact)[inner].max()
    assert np.abs(np.array(got) - exact)[inner].max() < np.abs(np.array(cen) - exact)[inner].max()


def test_one_point_and_bad_estimator(spark, growth):
    assert D.deriv_central(growth.where("seq = 1"), ["u1"]).first()["d_u1"] == 0
    with pytest.raises(ValueError):
        D.derivatives(growth, ["u1"], "spline")


@pytest.fixture(scope="module")
def wide(spark):
    """Two series of dimension 2, one longer than a piece of a block."""
    g = np.random.default_rng(3)
    rows = []
    for k, n in ((1, 97), (2, 9001)):
        x = np.cumsum(g.normal(size=(n, 2)), 0) / 10
        rows += [(k, i + 1, i * 0.05, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "traj_id long, seq int, t double, u1 double, u2 double")


def test_block_factors_equal_direct_fits(spark, wide):
    basis = T.staged_basis(2)
    rows = R.prepare(wide, basis, ["u1", "u2"])
    got = {(r["traj_id"], r["eq"], r["term"]): r["coef"] for r in R.fit_ols(R.block_factors(rows, 11, 2), 11, 2).collect()}
    want = {(r["traj_id"], r["eq"], r["term"]): r["coef"] for r in R.fit_ols_grouped(rows, 11, 2).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-7, atol=1e-9)


def test_stage_table_equals_direct_holdout(spark, wide):
    basis = T.staged_basis(2)
    one = wide.where("traj_id = 1")
    data = R.prepare(one, basis, ["u1", "u2"]).orderBy("seq").toPandas()
    x, d, w = (np.stack(data[c]) for c in ("phi", "d", "w"))
    got = {(r["eq"], r["split"], r["stage"]): r for r in C.stage_table(one, basis, ["u1", "u2"], C.CapPolicy()).collect()}
    n = len(x)
    for split, (fit, hold) in R.roles(n).items():
        f, h = (np.concatenate([np.arange(a, b) for a, b in part]) for part in (fit, hold))
        for stage, k in ((1, 2), (3, 5), (5, 11)):
            for e in range(2):
                s = np.sqrt(w[f, e])
                c = np.linalg.lstsq(x[f, :k] * s[:, None], d[f, e] * s, rcond=None)[0]
                assert math.isclose(got[e + 1, split, stage]["residual"], np.mean((x[h, :k] @ c - d[h, e]) ** 2), rel_tol=1e-6)
                assert got[e + 1, split, stage]["rank"] == np.linalg.matrix_rank(x[f, :k])


def test_rank_deficient_is_not_usable(spark):
    rows = [(1, i + 1, i * 0.1, 1.0 + i, 2.0 + 2 * i) for i in range(40)]
    t = spark.createDataFrame(rows, "traj_id long, seq int, t double, u1 double, u2 double")
    assert not any(r["usable"] for r in C.stage_table(t, T.staged_basis(2), ["u1", "u2"], C.CapPolicy()).collect())


def test_f_quantile():
    # fixed values of the F distribution's 0.95 quantile
    for (a, b), want in {(1, 1): 161.4476, (1, 10): 4.9646, (3, 20): 3.0984, (5, 100): 2.3053}.items():
        assert abs(S.f_quantile(0.95, a, b) - want) < 1e-3


def test_search_does_not_depend_on_partitions(spark, wide):
    basis = T.staged_basis(2)
    f = S.cut(R.block_factors(R.prepare(wide, basis, ["u1", "u2"]), 11, 2))
    policy = S.SearchPolicy(pop_size=4, children=2, max_levels=2)
    one, many = (S.grow(f.repartition(n), basis, 2, policy)[0].orderBy("traj_id").collect() for n in (1, 17))
    assert one == many


def plain_search(stack, basis, traj, policy, caps):
    """(best structure, rows of the log) of one series: the search's rules one candidate at a time."""
    dim, p, top = len(caps), len(basis), max(t.stage for t in basis)
    r = stack.plain_of(np.arange(len(stack.count)))
    draw = lambda n, *k: int(hashlib.md5(":".join(map(str, (policy.seed, *k))).encode()).hexdigest()[:8], 16) % max(n, 1)
    pick = lambda v, *k: v[draw(len(v), *k)]

    def allowed(stages):
        ok = lambda t, e: t.stage <= stages[e] and (len(t.vars) < 2 or all(v == e + 1 or stages[v - 1] >= t.stage or caps[v - 1] and caps[v - 1] < t.stage for v in t.vars))
        return [[t.idx for t in basis if ok(t, e)] for e in range(dim)]

    def scored(s, cid):
        res = [R.residual(r, [t - 1 for t in s[e]], p + e, R.solve(r[:, [t - 1 for t in s[e]]], r[:, p + e]), stack.n) for e in range(dim)]
        loss = sum(res) / dim
        return {"s": s, "id": cid, "res": res, "loss": loss, "obj": loss + policy.penalty * sum(map(len, s))}

    stages, in_stage, recent, stage, n_stage, bests = [1] * dim, [0] * dim, [[] for _ in range(dim)], 1, 0, []
    start = allowed(stages)
    pop = sorted((scored([[pick(start[e], traj, c, e, "init")] for e in range(dim)], c) for c in range(policy.pop_size)), key=lambda x: (x["obj"], x["id"]))
    log = []
    for level in range(1, policy.max_levels + 1):
        lists = allowed(stages)
        now = [[t for t in lists[e] if basis[t - 1].stage == stages[e]] for e in range(dim)]
        now = [[] if len(now[e]) == len(lists[e]) else now[e] for e in range(dim)]
        kids = []
        for parent in sorted(pop, key=lambda x: x["id"]):
            for child in range(1, policy.children + 1):
                s, k = parent["s"], (level, traj, parent["id"], child)
                room = [len(x) < policy.max_terms for x in s]
                hard = [e for e in range(dim) if room[e] and set(now[e]) - set(s[e])]
                free = [e for e in range(dim) if room[e] and set(lists[e]) - set(s[e])]
                if hard and draw(1 << 30, *k, "mode") / (1 << 30) < policy.hard_p:
                    e = pick(hard, *k, "hard")
                    options = [t for t in now[e] if t not in s[e]]
                else:
                    e = pick(free, *k, "eq") if free and any(now) else draw(dim, *k, "eq")
                    options = [t for t in lists[e] if t not in s[e]]
                grown = [list(x) for x in s]
                if options and room[e]:
                    grown[e] = sorted({*s[e], pick(options, *k, "term")})
                kids.append(scored(grown, level * 1_000_000 + len(kids) + 1))
        pop = sorted([(x["obj"], 0, x["id"], x) for x in pop] + [(x["obj"], 1, x["id"], x) for x in kids], key=lambda x: x[:3])[: policy.pop_size]
        pop = [x for *_, x in pop]
        best, during = pop[0], list(stages)
        if policy.progress == "equation":
            flat, limit = [], [top if c is None else max(c, s) for c, s in zip(caps, stages)]
            for e in range(dim):
                in_stage[e] += 1
                recent[e].append(best["res"][e])
                last = recent[e][-policy.window :]
                flat.append(len(last) == policy.window and max(last) - min(last) < policy.plateau_tol)
            why = "max_levels" if level >= policy.max_levels else "min_levels" if level < policy.min_levels else "loss_tol" if best["loss"] < policy.loss_tol else "all_equations_max_stage_plateau" if all(flat) and all(s >= m for s, m in zip(stages, limit)) else "continue"
            up = [flat[e] and in_stage[e] >= max(policy.min_per_stage, policy.window + 1) and best["res"][e] > policy.loss_tol and stages[e] < limit[e] and why in ("min_levels", "continue") for e in range(dim)]
            for e in range(dim):
                if up[e]:
                    stages[e], in_stage[e], recent[e] = stages[e] + 1, 0, []
        else:
            n_stage += 1
            bests.append(best["obj"])
            most = max(top if c is None else c for c in caps)
            level_off = len(bests) > policy.window and bests[-1 - policy.window] - bests[-1] < policy.plateau_tol
            why = "max_levels" if level >= policy.max_levels else "loss_tol" if best["loss"] < policy.loss_tol else "stage_budget" if n_stage < policy.min_per_stage else "insufficient_history" if len(bests) <= policy.window else "plateau_absolute" if level_off and stage >= most else "continue"
            up = [why == "continue" and level_off] * dim
            if up[0]:
                stage, n_stage, bests = stage + 1, 0, []
                stages = [min(stage, top if c is None else c) for c in caps]
        log.append((level, during, [e + 1 for e in range(dim) if up[e]], why, round(best["loss"], 9)))
        if why in ("max_levels", "loss_tol", "all_equations_max_stage_plateau", "plateau_absolute"):
            break
    return pop[0]["s"], log


@pytest.fixture(scope="module")
def three(spark):
    """Three short series of dimension 2."""
    g = np.random.default_rng(8)
    rows = []
    for k, n in ((1, 60), (2, 45), (3, 80)):
        x = np.cumsum(g.normal(size=(n, 2)), 0) / 10
        rows += [(k, i + 1, i * 0.05, float(a), float(b)) for i, (a, b) in enumerate(x)]
    traj = spark.createDataFrame(rows, "traj_id long, seq int, t double, u1 double, u2 double")
    basis = T.staged_basis(2)
    return S.cut(R.block_factors(R.prepare(traj, basis, ["u1", "u2"]), len(basis), 2)), basis


@pytest.mark.parametrize("progress", ["equation", "series"])
def test_search_equals_plain_rules(spark, three, progress):
    """Structures, stages, promotions and reasons of every series and level; a series' result doesn't depend on others."""
    f, basis = three
    policy = S.SearchPolicy(pop_size=4, children=2, max_levels=13, plateau_tol=0.3, progress=progress)
    caps = spark.createDataFrame([(1, 1, None), (1, 2, 2), (2, 1, 1), (2, 2, 1)], "traj_id long, eq int, cap int")
    best, log = S.grow(f, basis, 2, policy, caps)
    best, log = {r["traj_id"]: r for r in best.collect()}, log.collect()
    groups = {k: g for k, g in f.toPandas().groupby("traj_id")}
    for k, own in ((1, [None, 2]), (2, [1, 1]), (3, [None, None])):
        structure, rows = plain_search(R.Stack(groups[k], len(basis), 2), basis, k, policy, own)
        assert best[k]["structure"] == structure and best[k]["levels"] == len(rows)
        assert sorted((r["level"], r["stages"], r["promoted"], r["reason"], round(r["loss"], 9)) for r in log if r["traj_id"] == k) == rows
    assert {max(r["stages"]) for r in log} >= {1, 2, 3} and any(r["stages"][0] != r["stages"][1] for r in log)
    alone, _ = S.grow(f.where("traj_id = 3"), basis, 2, policy)
    assert alone.collect() == [best[3]]


def test_search_callback_and_errors(spark, three):
    f, basis = three
    seen = []
    S.grow(f, basis, 2, S.SearchPolicy(pop_size=3, children=1, max_levels=2), on_level=lambda pop, level: seen.append((level, pop.count())))
    assert seen == [(1, 9), (2, 9)]
    with pytest.raises(ValueError):
        S.grow(f, basis, 2, S.SearchPolicy(progress="other"))


def test_screening_keeps_the_best_children(spark, three):
    """Of each series' children those that pass the gate come first, then by score."""
    f, basis = three
    kids = spark.createDataFrame([(1, 10, 0, [[1, 2], [1]]), (1, 11, 0, [[1], [1]]), (1, 12, 0, [[1, 2, 3, 4], [1, 2, 3, 4]])], "traj_id long, cand_id long, parent_id long, structure array<array<int>>")
    parent = S.scored(spark.createDataFrame([(1, 0, [[1], [1]])], "traj_id long, cand_id long, structure array<array<int>>"), f, 11, 2)
    new = S.scored(kids, f, 11, 2).join(kids.drop("structure"), ["traj_id", "cand_id"])
    rows = {r["cand_id"]: r for r in new.collect()}
    p = parent.first()

    def passes(r):
        d1, d2 = r["n_params"] - p["n_params"], r["n"] - r["n_params"]
        return d1 <= 0 or p["loss"] > r["loss"] and (p["loss"] - r["loss"]) * r["n"] / d1 / (r["loss"] * r["n"] / d2) > S.f_quantile(0.95, d1, d2)

    order = sorted(rows, key=lambda i: (not passes(rows[i]), rows[i]["loss"] + 1e-12 * rows[i]["n_params"], i))
    for k in (1, 2):
        got = S.screened(new, parent, S.SearchPolicy(screen_k=k)).collect()
        assert sorted(r["cand_id"] for r in got) == sorted(order[:k])


def test_batched_solves_equal_single_ones():
    g = np.random.default_rng(1)
    r = np.triu(g.normal(size=(8, 8)))
    r[:, 3] = r[:, 1]  # two equal columns: the smallest coefficients
    cols, y = np.array([[0, 1, 3], [0, 2, 4], [1, 3, 5]]), np.array([6, 7, 6])
    c, mse = R.solve_many(r, cols, y, 20)
    for i in range(3):
        want = R.solve(r[:, cols[i]], r[:, y[i]])
        assert np.allclose(c[i], want) and math.isclose(mse[i], R.residual(r, cols[i].tolist(), y[i], want, 20), rel_tol=1e-9)
    assert R.solve_many(r, np.zeros((2, 0), int), np.array([6, 7]), 20)[0].shape == (2, 0)


def test_best_estimator_is_of_the_smallest_median(spark):
    rows = [("a", "all", 3.0), ("a", "all", 1.0), ("a", "all", 9.0), ("b", "all", 2.0), ("b", "all", 2.5), ("c", "first", 0.1), ("b", "first", 99.0)]
    assert tuple(D.best_estimator(spark.createDataFrame(rows, "estimator string, block string, rms double")).first()) == ("b", 2.25)


def test_full_library_fit(spark, three):
    """Coefficients, errors, R2 and rank of every equation against a direct fit on the series' factor."""
    f, basis = three
    got = {(r["traj_id"], r["eq"], r["term"]): r for r in R.fit_ols(f, len(basis), 2).collect()}
    for k, g in f.toPandas().groupby("traj_id"):
        s = R.Stack(g, len(basis), 2)
        r = s.plain_of(np.arange(len(s.count)))
        for e in range(2):
            c, _, rank, _ = np.linalg.lstsq(r[:, :11], r[:, 11 + e], rcond=None)
            mse = float(np.sum((r[:, :11] @ c - r[:, 11 + e]) ** 2)) / s.n
            y2, y1 = s.sums[:, 1, e].sum(), s.sums[:, 0, e].sum()
            for t in range(11):
                x = got[k, e + 1, t + 1]
                assert math.isclose(x["coef"], c[t], rel_tol=1e-9) and math.isclose(x["mse"], mse, rel_tol=1e-9) and x["rank"] == rank
                assert math.isclose(x["r2"], 1 - mse * s.n / (y2 - y1 * y1 / s.n), rel_tol=1e-9)


def test_generation_equals_plain_rules(spark):
    """Elite, tournaments, crossover by equation and the three mutations, slot by slot."""
    g = np.random.default_rng(4)
    pop = [(k, i, [sorted({int(x) for x in g.integers(1, 12, g.integers(1, 5))}) for _ in range(2)], float(g.integers(0, 50))) for k in (1, 2) for i in range(30)]
    got = S.gp_generation(spark.createDataFrame(pop, "traj_id long, cand_id long, structure array<array<int>>, objective double"), 11, 3, 7, elite=2, k=3, max_terms=4).collect()
    draw = lambda n, *k: int(hashlib.md5(":".join(map(str, (3, 7, *k))).encode()).hexdigest()[:8], 16) % n
    want, kinds = [], set()
    for k in (1, 2):
        order = [s for *_, s in sorted((o, i, s) for j, i, s, o in pop if j == k)]
        want += [(k, slot, order[slot], True) for slot in range(2)]
        for slot in range(2, 30):
            a, b = (order[min(draw(30, k, slot, side, i) for i in range(3))] for side in "ab")
            s = [list((a, b)[draw(2, k, slot, "cross", e)][e]) for e in range(2)]
            e, op = draw(2, k, slot, "eq"), draw(1 << 30, k, slot, "op") / (1 << 30)
            free, own = [t for t in range(1, 12) if t not in s[e]], s[e]
            new, gone = free[draw(len(free), k, slot, "term")], own[draw(len(own), k, slot, "drop")]
            less = [t for t in own if t != gone]
            s[e] = sorted(own + [new] if op < 0.34 and len(own) < 4 else own if op < 0.34 else (less if len(own) > 1 else own) if op < 0.67 else less + [new])
            kinds.add(op < 0.34 and 1 or op < 0.67 and 2 or 3)
            want.append((k, slot, s, False))
    assert kinds == {1, 2, 3} and sorted((r["traj_id"], r["cand_id"], r["structure"], r["is_elite"]) for r in got) == sorted(want)


def test_evolutionary_search(spark, three):
    f, basis = three
    best, log = S.gp_search(f, basis, 2, S.SearchPolicy(pop_size=6, max_levels=4, min_levels=4))
    rows = log.collect()
    assert sorted(r["traj_id"] for r in best.collect()) == [1, 2, 3] and len(rows) == 12
    for k in (1, 2, 3):  # the best survives
        objective = [r["best"] for r in sorted(rows, key=lambda r: r["level"]) if r["traj_id"] == k]
        assert objective == sorted(objective, reverse=True)


def test_discover_records(spark):
    """A linear system, whose own equations are the truth; another truth isn't matched."""
    a = np.array([[-0.5, 1.0], [-1.0, -0.5]])
    w, v = np.linalg.eig(a)
    rows = [(1, i + 1, i * 0.02, *(v @ np.diag(np.exp(w * i * 0.02)) @ np.linalg.inv(v) @ [1.0, 0.5]).real.tolist()) for i in range(200)]
    traj = spark.createDataFrame(rows, "traj_id long, seq int, t double, u1 double, u2 double")
    for terms, match in ([(1, 1), (1, 2), (2, 1), (2, 2)], True), ([(1, 1), (2, 2)], False):
        truth = spark.createDataFrame([(1, e, t) for e, t in terms] + [(9, 1, 1)], "traj_id long, eq int, term int")
        records, log = discover(traj, T.staged_basis(2), ["u1", "u2"], S.SearchPolicy(max_levels=6, children=4, loss_tol=1e-6), caps=C.CapPolicy(), truth=truth)
        x = records.collect()
        assert len(x) == 1
        x = x[0]
        assert x["pruned_match"] is match and x["r2"] > 0.999 and x["pruned_terms"] == [["u1", "u2"], ["u1", "u2"]] and len(x["stage_caps"]) == 2
        assert np.allclose([c for e in x["params"] for c in e[:2]], a.ravel(), atol=0.02)
    assert x["levels"] == log.count()


def test_growth_modes(spark):
    pop = spark.createDataFrame([(1, 0, [[1], [2]]), (1, 1, [[1, 2, 3, 4], [1, 2, 3, 4]])], "traj_id long, cand_id long, structure array<array<int>>")
    allowed = spark.createDataFrame([(1, [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5]])], "traj_id long, terms array<array<int>>")
    current = spark.createDataFrame([(1, [[], [5]])], "traj_id long, terms array<array<int>>")
    for r in S.expand(pop, allowed, current, S.SearchPolicy(children=5), 1, "hard").collect():
        if r["parent_id"] == 0:
            assert r["structure"] == [[1], [2, 5]]
        else:  # full: an unchanged copy
            assert r["structure"] == [[1, 2, 3, 4], [1, 2, 3, 4]]
    for mode in ("passive", "soft"):
        for r in S.expand(pop.where("cand_id = 0"), allowed, current, S.SearchPolicy(children=20), 1, mode).collect():
            assert sum(map(len, r["structure"])) == 3 and all(s == sorted(set(s)) for s in r["structure"])
    with pytest.raises(ValueError):
        S.expand(pop, allowed, current, S.SearchPolicy(), 1, "other")


def test_coherence(spark):
    terms = T.terms_table(spark, T.staged_basis(2))
    got = lambda cap: {(r["eq"], r["term"]) for r in T.equation_terms(spark.createDataFrame([(1, 1, 3, None), (1, 2, 1, cap)], "traj_id long, eq int, stage int, cap int"), terms).collect()}
    assert (1, 5) not in got(None)  # u1*u2 waits for equation 2
    assert (1, 5) in got(1)  # which its cap holds below
    assert (1, 5) not in got(4)


def test_bases():
    for d in (1, 2, 3, 4):
        assert len(T.staged_basis(d)) == 5 * d + d * (d - 1) // 2
    assert [t.name for t in T.flat_basis(0, ["a", "b"])] == ["u1", "u2", "u1^2", "u2^2", "u1*u2"]
    assert {t.stage for t in T.flat_basis(2)} == {1}


def test_records(spark, tmp_path):
    p = tmp_path / "h"
    p.mkdir()
    (p / "a.jsonl").write_text('{"variant":"v1","seed":1,"loss":"Inf"}\n\n{"variant":"v2","loss":0.5}\n')
    assert sorted(r["loss"] for r in SR.read_records(spark, str(p)).collect()) == [0.5, INF]
    (p / "b.jsonl").write_text('[1, 2]\n{"variant": \n')
    with pytest.raises(SR.MalformedInput):
        SR.read_records(spark, str(p))
    assert SR.read_records(spark, str(p), strict=False).where("corrupt is not null").count() == 2
    empty = tmp_path / "e"
    empty.mkdir()
    (empty / "a.jsonl").write_text("\n")
    with pytest.raises(SR.MalformedInput):
        SR.read_records(spark, str(empty))


def test_benchmark_array_file(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text('[{"id": 7, "dim": 1, "solutions": [[{"t": [0, 1], "y": [[2, 3]]}, {"t": [0], "y": [[9]]}]]}]')
    assert [tuple(r) for r in SR.read_systems(spark, str(f), 1).orderBy("seq").collect()] == [(7, 1, 0.0, [2.0]), (7, 2, 1.0, [3.0])]
    assert SR.read_systems(spark, str(f), 2).count() == 1 and SR.read_systems(spark, str(f), 3).count() == 0


def test_fingerprint():
    assert SR.config_fingerprint({"b": 1, "a": 2}) == SR.config_fingerprint({"a": 2, "b": 1}) and len(SR.config_fingerprint({})) == 16


def test_class_coverage_errors(spark):
    cells = spark.createDataFrame([("v1", 1), ("v1", 2)], "variant_slug string, system_id long")
    cls = lambda *x: spark.createDataFrame([(i, "exact") for i in x], "system_id long, representability string")
    for bad in (cls(9), cls(1)):
        with pytest.raises(ValueError):
            E.split_by_class(cells, bad)
    assert {r["problem"] for r in E.class_coverage(cells, cls(9)).collect()} == {"no_overlap", "unclassified"}
    assert E.split_by_class(cells, cls(1, 2)).count() == 2


def test_manifest_rejects_repeats(spark):
    one = lambda n, *x: spark.createDataFrame([(v,) for v in x], f"{n} int")
    with pytest.raises(ValueError):
        E.build_manifest(one("variant", 1, 1), one("system_id", 1), one("initial_condition_set", 1), one("seed", 1))


def test_normalize_needs_columns(spark):
    with pytest.raises(ValueError):
        E.normalize_registry(spark.createDataFrame([(1,)], "system_id int"))


def test_written_tables_are_cleaned_up(spark):
    import os
    from urllib.parse import urlparse

    from tracewright.sources import scratch

    path = urlparse(S.cut(spark.range(3)).inputFiles()[0]).path
    assert os.path.exists(path) and scratch.clean_up(spark) > 0 and not os.path.exists(path) and scratch.clean_up(spark) == 0
