"""Reference rows that a stage table is read against: fits of known supports, residuals of known derivatives, estimators
and sampling densities side by side. All come from the same block factors as the stage table.

A known derivative (of an exact model, say) stands beside the estimates as further right-hand columns of a factor; the
mean squared difference of any two combinations of columns is a norm of the factor times their difference.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regression as R
from .derivatives import EPS, decimated, derivatives
from .stagecaps import STAGES, CapPolicy, stage_table
from .terms import Term

ALL = "all"
FITS = "split string, eq int, kind string, stage int, terms string, n_fit int, n_holdout int, train_residual double, holdout_residual double, normalised double, rank int, cond double, valid boolean, coefs array<double>"


def density_sweep(traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], ks: Sequence[int] = (1, 2, 4), policy: CapPolicy = CapPolicy(), by: Sequence[str] = ("traj_id",), rows: int | None = None) -> DataFrame:
    """The stage table at several sampling densities: by, k, eq, split, stage, residual, floor_ms, usable, rank, cond and
    rank_deficient (the fit rows have fewer independent columns than the stage has terms).

    Density k takes every k-th row of a series; series and k are one key, so all densities are one job.
    """
    upto = F.create_map(*[F.lit(x) for s in range(1, STAGES + 1) for x in (s, sum(t.stage <= s for t in basis))])
    table = stage_table(decimated(traj, ks, by), basis, cols, policy, [*by, "k"], rows)
    return table.withColumn("rank_deficient", F.col("rank") < F.element_at(upto, F.col("stage")))


def derivative_error(traj: DataFrame, cols: Sequence[str], exact: Sequence[str], ks: Sequence[int] = (1,), estimators: Sequence[str] = ("central",), by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """by, k, estimator, eq, n, rms_error: root mean square of the estimate's difference from the known derivatives.

    All estimators look at the same sorted rows, and a group is a series and density with a mean for each of them and each
    equation, which become rows after it."""
    d = decimated(traj, ks, by)
    for i, estimator in enumerate(estimators):
        d = derivatives(d, cols, estimator, [*by, "k"]).withColumnsRenamed({f"d_{c}": f"__d{i}_{c}" for c in cols})
    square = lambda i, c, e: (F.col(f"__d{i}_{c}") - F.col(e)) * (F.col(f"__d{i}_{c}") - F.col(e))
    each = [(i, j, estimator, square(i, c, e)) for i, estimator in enumerate(estimators) for j, (c, e) in enumerate(zip(cols, exact, strict=True))]
    g = d.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), *[F.sqrt(F.avg(x)).alias(f"__m{i}_{j}") for i, j, _, x in each])
    rows = F.explode(F.array(*[F.struct(F.lit(estimator).alias("estimator"), F.lit(j + 1).alias("eq"), F.col(f"__m{i}_{j}").alias("rms_error")) for i, j, estimator, _ in each])).alias("x")
    return g.select(*by, "k", "n", rows).select(*by, "k", "x.estimator", "x.eq", "n", "x.rms_error")


def true_stage_cliff(sweep: DataFrame, expected: DataFrame, by: Sequence[str] = ("traj_id",), watch: int = 3) -> DataFrame:
    """by, k, eq, split, expected, cliff, true_residual, true_floor, true_rank_deficient, watch_rank_deficient, cliff_visible.

    cliff: how far the residual falls from the stage before the expected one (1: from itself, so 0) to it; visible, if that
    exceeds the floor. expected: by, eq, expected (a stage); series without one are left out. A stage that the table lacks
    gives null. watch: a stage whose rank is reported whatever is expected.
    """
    at = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c)))
    g = sweep.join(expected.select(*by, "eq", "expected"), [*by, "eq"]).groupBy(*by, "k", "eq", "split", "expected").agg(
        at("residual", F.greatest(F.col("expected") - 1, F.lit(1))).alias("__before"), at("residual", F.col("expected")).alias("true_residual"), at("floor_ms", F.col("expected")).alias("true_floor"),
        F.bool_or(F.when(F.col("stage") == F.col("expected"), F.col("rank_deficient"))).alias("true_rank_deficient"), F.bool_or(F.when(F.col("stage") == watch, F.col("rank_deficient"))).alias("watch_rank_deficient"),
    )
    cliff = F.col("__before") - F.col("true_residual")
    return g.withColumns({"cliff": cliff, "cliff_visible": cliff > F.col("true_floor")}).drop("__before")


def with_supports(traj: DataFrame, supports: DataFrame, dim: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """traj with supports: the term numbers of each equation of its series, as text (1,3|2). supports: by, eq, term.

    Equations without terms have none; series without any support are left out. The texts, one a series, are hashed in each
    partition, so that the rows need no sort for the join."""
    per = supports.groupBy(*by, "eq").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set(F.col("term").cast("int"))), lambda x: x.cast("string"))).alias("t"))
    m = F.map_from_entries(F.collect_list(F.struct(F.col("eq").cast("int").alias("eq"), "t")))
    text = per.groupBy(*by).agg(m.alias("m")).select(*by, F.concat_ws("|", *[F.coalesce(F.element_at("m", F.lit(e + 1)), F.lit("")) for e in range(dim)]).alias("supports"))
    return traj.join(text.hint("shuffle_hash"), list(by))


def reference_rows(
    traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], exact: Sequence[str] = (), supports: DataFrame | None = None, estimators: Sequence[str] = ("central",), ks: Sequence[int] = (1,), stages: bool = False,
    by: Sequence[str] = ("traj_id",), rows: int | None = None,
) -> DataFrame:
    """by, k, estimator and FITS: for each split A to D and for all rows (fitted and tested on all), by kind

    - exact: the mean squared difference of the known derivative (columns `exact`, one a state) from the estimate;
    - support: least squares on each series' own support (supports: by, eq, term);
    - stage: least squares on all terms up to each stage (stages).

    Fits are unweighted. normalised: holdout residual over the variance of the holdout's estimates (Infinity where that
    vanishes). terms: numbers of the columns used. A split without holdout rows has residual Infinity and is not valid.
    Everything is one pass over factors a series, density and estimator.
    """
    if exact and len(exact) != len(cols):
        raise ValueError("one known derivative for each state column")
    p, dim = len(basis), len(cols)
    keys = [*by, "k"] + (["supports"] if supports is not None else [])
    base = decimated(with_supports(traj, supports, dim, by) if supports is not None else traj, ks, by)
    upto = [(s, list(range(sum(t.stage <= s for t in basis)))) for s in sorted({t.stage for t in basis})] if stages else []
    wide, own_terms, known = dim * (2 if exact else 1), supports is not None, bool(exact)

    def fits(m: R.Many) -> dict:
        texts = [x.split("|") for x in m.keys["supports"].to_pylist()] if own_terms else []
        plans = ([("exact", None, None)] if known else []) + ([("support", None, None)] if own_terms else []) + [("stage", s, c) for s, c in upto]
        parts = {**m.roles(), ALL: (m.every(), m.every())}
        shape = (len(m), len(parts), dim, len(plans))
        real = {c: np.full(shape, np.inf) for c in ("train_residual", "holdout_residual", "normalised", "cond")}
        rank, ok, terms, coefs, n_fit, n_hold = np.zeros(shape, int), np.zeros(shape, bool), np.full(shape, "", object), np.empty(shape, object), np.zeros(shape, int), np.zeros(shape, int)
        for i, (fit, hold) in enumerate(parts.values()):
            na, nb, a, b = m.rows_of(fit), m.rows_of(hold), m.plain_of(fit), m.plain_of(hold)
            n_fit[:, i], n_hold[:, i] = na[:, None, None], nb[:, None, None]
            for e in range(dim):
                var = np.nan_to_num(m.mean_of(hold, 1, e) - m.mean_of(hold, 0, e) ** 2)
                for j, (kind, _, use) in enumerate(plans):
                    if kind == "exact":
                        sets = {(p + dim + e,): np.arange(len(m))}
                    elif kind == "stage":
                        sets = {tuple(use): np.arange(len(m))}
                    else:
                        own = [tuple(int(x) - 1 for x in t[e].split(",") if x) for t in texts]
                        sets = {s: np.array([k for k, x in enumerate(own) if x == s]) for s in set(own)}
                    for columns, at in sets.items():
                        c = np.ones((len(at), 1)) if kind == "exact" else R.least_squares(a[at][:, :, list(columns)], a[at][:, :, p + e])
                        train, held = R.residuals(a[at], columns, p + e, c, na[at]), R.residuals(b[at], columns, p + e, c, nb[at])
                        real["train_residual"][at, i, e, j], real["holdout_residual"][at, i, e, j] = train, held
                        real["normalised"][at, i, e, j] = np.where(var[at] > EPS, held / np.where(var[at] > EPS, var[at], 1), np.inf)
                        ok[at, i, e, j] = np.isfinite(train) & np.isfinite(held) & np.isfinite(c).all(1)
                        if kind != "exact":
                            rank[at, i, e, j], real["cond"][at, i, e, j] = R.ranks(a[at][:, :, list(columns)], na[at])
                            terms[at, i, e, j] = ",".join(str(x + 1) for x in columns)
                        for k, v in zip(at, c if kind != "exact" else np.zeros((len(at), 0)), strict=True):
                            coefs[k, i, e, j] = v.tolist()
        along = lambda values, axis: np.array(values, object).reshape([-1 if x == axis else 1 for x in range(4)])
        return {"split": along(list(parts), 1), "eq": along(range(1, dim + 1), 2), "kind": along([x[0] for x in plans], 3), "stage": along([x[1] for x in plans], 3), "terms": terms, "n_fit": n_fit, "n_holdout": n_hold, **real, "rank": rank, "valid": ok, "coefs": coefs}

    out = None
    for estimator in estimators:
        src = R.prepare(base, basis, cols, estimator, "none", keys, rows, exact)
        one = R.in_batches(src, p, wide, fits, FITS, keys).withColumn("estimator", F.lit(estimator)).drop("supports")
        out = one if out is None else out.unionByName(one)
    return out.select(*by, "k", "estimator", *[x.split()[0] for x in FITS.split(", ")])
