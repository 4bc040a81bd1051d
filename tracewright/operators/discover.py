"""From trajectories to records: caps, staged search, fit, pruning and support check of all series in one run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.scratch import cut

from . import regression as R
from . import search as S
from . import stagecaps as C
from .terms import Term, prune, support_match, terms_table


#: (factors, basis, dim, policy, scoring) -> (best, log): any search; best has traj_id, structure, loss, objective, n_params,
#: levels, reason, and log a row a series and level with what it cost (search.COUNTERS, codes).
Search = Callable[[DataFrame, Sequence[Term], int, S.SearchPolicy, S.Scoring], tuple[DataFrame, DataFrame]]


def evolutionary(factors: DataFrame, basis: Sequence[Term], dim: int, policy: S.SearchPolicy, scoring: S.Scoring) -> tuple[DataFrame, DataFrame]:
    """The evolutionary baseline as a Search."""
    return S.gp_search(factors, basis, dim, policy, scoring=scoring)


def fit_structures(best: DataFrame, factors: DataFrame, p: int, dim: int, solver: R.Solver = R.solve_many) -> DataFrame:
    """traj_id, eq, term, coef, mse, r2 of each series' structure: one small solve an equation on its factors."""
    names = ["traj_id", "eq", "term", "coef", "mse", "r2"]
    schema = "traj_id long, eq int, term int, coef double, mse double, r2 double"
    sums = factors.groupBy("traj_id").agg(*[F.sum(F.get("sums", F.lit(kind * dim + e))).alias(f"__{name}{e}") for kind, name in enumerate(("d", "dd")) for e in range(dim)])
    chosen = best.select(F.col("traj_id").cast("long").alias("traj_id"), "structure").join(sums, "traj_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, n, t, series in R._met(batches, ["traj_id"], p + dim):
            out, d, dd = [], *[[t[f"__{name}{e}"].to_numpy() for e in range(dim)] for name in ("d", "dd")]
            for i, (key, structure) in enumerate(zip(t["traj_id"].to_pylist(), t["structure"].to_pylist(), strict=True)):
                rows = int(n[series[i]])
                for e, terms in enumerate(structure):
                    found, errors = solver(r[series[i]], np.array([[x - 1 for x in terms]], int), np.array([p + e]), rows)
                    c, mse, total = found[0], float(errors[0]), d[e][i]
                    sst = dd[e][i] - total * total / rows
                    out += [(key, e + 1, int(x), float(v), mse, 1 - mse * rows / sst if sst > 0 else None) for x, v in zip(terms, c, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return R._meeting(chosen, factors.withColumn("traj_id", F.col("traj_id").cast("long")), ["traj_id"], []).mapInArrow(run, schema)


def discover(
    traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], policy: S.SearchPolicy = S.SearchPolicy(), *, caps: C.CapPolicy | None = None, estimator: str = "central",
    truth: DataFrame | None = None, on_level: Callable[[DataFrame, int], None] | None = None, scoring: S.Scoring = S.Scoring(), search: Search | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, log): one record per series, and the search's row per series and level.

    With caps, stage caps are estimated once from the data before the search. The found structure is fitted, its small
    terms pruned, and both supports are compared with truth (traj_id, eq, term), where given. scoring judges candidates by a
    loss or a solver of one's own; search replaces the staged search (evolutionary, or any Search). Parameters are those of
    scoring's solver.
    records: traj_id, dim, loss, objective, n_params, r2 (mean) and r2_by_dim (null without spread), final_stages,
    final_stage, stage_caps, levels, promotions, termination, support_terms and pruned_terms (names by equation), params,
    raw_match and pruned_match (null without truth), evaluations, fits, shared, invalid and codes (what the search cost). A
    search without stages has null final_stages, and promotions 0. A series without rows has no record; an equation that lost all its
    terms has an empty list.
    """
    p, dim = len(basis), len(cols)
    # a search over whole series needs one factor of each, made where its rows lie
    factors = cut(R.series_factors(R.prepare(traj, basis, cols, estimator), p, dim), "factors")
    limits = cut(C.estimate_stage_caps(traj, basis, cols, caps), "caps") if caps else None
    if search is None:
        best, log = S.grow(factors, basis, dim, policy, limits, on_level, scoring)
    else:
        best, log = search(factors, basis, dim, policy, scoring)
        best, log = best.withColumn("stages", F.lit(None).cast("array<int>")), log.withColumn("promoted", F.array().cast("array<int>"))
    best = cut(best, "best")
    fit = cut(fit_structures(best, factors, p, dim, scoring.solver), "fit").join(F.broadcast(terms_table(traj.sparkSession, basis).select("term", "name")), "term")
    kept = prune(fit.select("traj_id", "eq", "term", "name", "coef"), ("traj_id", "eq"))

    def by_equation(rows: DataFrame, value: str, name: str) -> DataFrame:
        """traj_id and an array with each equation's values in the order of its terms (a structure is small)."""
        per = rows.groupBy("traj_id", "eq").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", value))), lambda x: x[value]).alias("v"))
        m = F.map_from_entries(F.collect_list(F.struct("eq", "v")))
        none = F.array().cast(per.schema["v"].dataType)
        return per.groupBy("traj_id").agg(m.alias("m")).select("traj_id", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda e: F.coalesce(F.element_at("m", e), none)).alias(name))

    eqs = fit.groupBy("traj_id", "eq").agg(F.first("r2").alias("r2"))
    r2 = eqs.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("eq", "r2"))), lambda x: x["r2"]).alias("r2_by_dim"), F.when(F.every(F.col("r2").isNotNull()), F.avg("r2")).alias("r2"))
    moves = log.groupBy("traj_id").agg(F.sum(F.size("promoted")).alias("promotions"))
    records = best.join(r2, "traj_id", "left").join(moves, "traj_id", "left").join(S.run_costs(log).drop("levels"), "traj_id", "left")
    for rows, value, name in ((fit, "name", "support_terms"), (fit, "coef", "params"), (kept, "name", "pruned_terms")):
        records = records.join(by_equation(rows, value, name), "traj_id", "left")
    if limits is not None:
        records = records.join(limits.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("eq", "cap"))), lambda x: x["cap"]).alias("stage_caps")), "traj_id", "left")
    else:
        records = records.withColumn("stage_caps", F.lit(None).cast("array<int>"))
    for rows, name in ((fit, "raw_match"), (kept, "pruned_match")):
        if truth is None:
            records = records.withColumn(name, F.lit(None).cast("boolean"))
            continue
        # the series at hand alone: others of truth aren't misses
        known = truth.select("traj_id", "eq", "term").join(best.select("traj_id"), "traj_id", "left_semi")
        same = support_match(rows.withColumnRenamed("traj_id", "run_id"), known.withColumnRenamed("traj_id", "run_id"))
        records = records.join(same.select(F.col("run_id").alias("traj_id"), F.col("matched").alias(name)), "traj_id", "left")
    return records.select(
        "traj_id", F.lit(dim).alias("dim"), "loss", "objective", "n_params", "r2", "r2_by_dim", F.col("stages").alias("final_stages"), F.array_max("stages").alias("final_stage"), "stage_caps", "levels", "promotions",
        F.col("reason").alias("termination"), "support_terms", "pruned_terms", "params", "raw_match", "pruned_match", *S.COUNTERS, "codes",
    ), log
