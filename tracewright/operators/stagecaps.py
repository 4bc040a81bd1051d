"""Look-ahead stage caps: which complexity stage the data supports, per series and equation.

Everything after the stage table is a Column expression over arrays of at most five stages, so thresholds can be swept by
joining a small table of policies to the same stage table; fits are never repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import regression as R
from .terms import Term

INF = float("inf")
STAGES = 5


@dataclass(frozen=True)
class CapPolicy:
    estimator: str = "central"
    weighting: str = "richardson_wls"
    aggregation: str = "majority"
    horizon: int = 5
    tau_rel: float = 1e-4
    tau_abs: float = 1e-8
    cond_cap: float = 1e10
    excitation_floor: float = 1e-10
    drop_ratio: float = 0.35
    floor_ratio: float = 0.1

    def check(self) -> CapPolicy:
        if self.aggregation not in ("majority", "unanimous", "any_positive"):
            raise ValueError(f"unknown aggregation {self.aggregation!r}")
        if self.horizon < 1:
            raise ValueError("horizon must be at least 1")
        if self.drop_ratio < 0 or self.floor_ratio < 0:
            raise ValueError("ratios must not be negative")
        return self


def finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < INF, F.lit(False))


def counts_gain(cur: Column, nxt: Column, floor: Column, tau_rel: Column, tau_abs: Column) -> Column:
    """Does the next stage's residual gain on the current one? Below the floor the absolute threshold is waived."""
    delta = cur - nxt
    rel = F.when(cur == 0, F.lit(INF)).otherwise(delta / cur)
    gain = (delta > floor) & (rel > tau_rel) & ((nxt <= floor) | (delta > tau_abs))
    return finite(cur) & finite(nxt) & (cur > floor) & gain


def counts_gain_rule(rule: Column, cur: Column, nxt: Column, floor: Column, tau_rel: Column, tau_abs: Column) -> Column:
    """The older rules: threshold_only, and floor_gated, which also needs to start and to gain above the floor."""
    delta = cur - nxt
    over = (delta > tau_abs) & (F.when(cur == 0, F.lit(INF)).otherwise(delta / cur) > tau_rel)
    return F.when(~(finite(cur) & finite(nxt)), False).when(rule == "threshold_only", over).when(rule == "floor_gated", (cur > floor) & over & (delta > floor))


def _later(a: Column, p: Column) -> Column:
    return F.filter(F.slice(a, p + 1, F.lit(STAGES)), lambda x: finite(x))


def post_floor(res: Column, floors: Column, p: Column, drop: Column, ratio: Column) -> Column:
    """What follows a stage at or below its floor: not_applicable, undecidable, clear_drop or no_clear_drop."""
    cur, fl = F.element_at(res, p), F.element_at(floors, p)
    later = _later(res, p)
    return (
        F.when(~(finite(cur) & finite(fl)), "undecidable").when(cur > fl, "not_applicable").when((cur <= 0) | (fl <= 0), "no_clear_drop")
        .when(cur / fl < ratio, "no_clear_drop").when(p == F.size(res), "no_clear_drop").when(F.size(later) == 0, "undecidable")
        .when(F.array_min(later) / cur <= drop, "clear_drop").otherwise("no_clear_drop")
    )


def uninformative(res: Column, p: Column, tau_abs: Column) -> Column:
    """Are all finite residuals from position p on within tau_abs?"""
    return F.forall(F.filter(F.slice(res, p, F.lit(STAGES)), lambda x: finite(x)), lambda x: F.abs(x) <= tau_abs)


#: Names of the rules that end a walk. Reports are read by them.
BRANCHES = ("empty_applicable_stages", "usability", "floor_after_gain", "floor_doubt_band", "horizon_exhausted", "uninformative_without_gain", "gain_search_exhausted", "successor_usability")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed (and planned) once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moves(res: Column, fl: Column, us: Column, st: Column, pol: Column, p: Column) -> Column:
    """Where position p leads, before (fresh) and after (gained) a gain was seen: struct(to, kind, stage, branch) of each; to = 0
    ends with kind, by the rule that branch names (BRANCHES)."""
    m, at = F.size(st), lambda a, q: F.element_at(a, q)
    end = lambda kind, stage, why: F.struct(F.lit(0).alias("to"), F.lit(kind).alias("kind"), stage.cast("int").alias("stage"), F.lit(why).alias("branch"))
    go = lambda q: F.struct(q.cast("int").alias("to"), F.lit("").alias("kind"), F.lit(0).alias("stage"), F.lit("").alias("branch"))
    nxt = F.least(p + 1, m)
    ahead = F.filter(F.sequence(F.lit(1), m), lambda q: (q > p) & (q <= p + pol["horizon"]) & (~at(us, q) | counts_gain(at(res, p), at(res, q), at(fl, p), pol["tau_rel"], pol["tau_abs"])))
    known = F.struct(
        post_floor(res, fl, p, pol["drop_ratio"], pol["floor_ratio"]).alias("after"), F.array_min(ahead).alias("first"), ((p == m) | at(us, nxt)).alias("succ"), at(st, p).alias("here"), uninformative(res, p, pol["tau_abs"]).alias("faint"),
    )

    def both(x: Column) -> Column:
        here, first = x["here"], x["first"]

        def one(gained: bool) -> Column:
            stay = F.when(x["succ"], end("positive", here, "gain_search_exhausted")).otherwise(end("invalid", at(st, nxt), "successor_usability"))
            if not gained:
                stay = F.when(x["faint"], end("undecidable", here, "uninformative_without_gain")).otherwise(stay)
            low = end("undecidable", here, "floor_doubt_band")
            if gained:
                low = F.when(x["after"] == "clear_drop", go(p + 1)).when((x["after"] == "no_clear_drop") & x["succ"], end("positive", here, "floor_after_gain")).otherwise(low)
            above = F.when(p == m, end("positive" if gained else "undecidable", here, "horizon_exhausted")).when(first.isNull(), stay).when(~at(us, first), end("invalid", at(st, first), "usability")).otherwise(go(first))
            return F.when(~at(us, p), end("invalid", here, "usability")).when(at(res, p) <= at(fl, p), low).otherwise(above)

        return F.struct(one(False).alias("fresh"), one(True).alias("gained"))

    return _let(known, both)


def split_decision(res: Column, fl: Column, us: Column, st: Column, pol: Column) -> Column:
    """struct(kind, cap, stage, branch) of one split: positive with a cap, undecidable or invalid at a stage; branch names
    the rule that decided.

    res, fl, us, st: residuals, floors, usability and numbers of the applicable stages in order (no empty stage). The walk
    jumps to the first later stage within the horizon that gains; each position's exits are computed at once, and the
    walk is a fold that follows them.
    """
    table = F.transform(F.sequence(F.lit(1), F.size(st)), lambda p: _moves(res, fl, us, st, pol, p))

    def step(acc: Column, _: Column) -> Column:
        row = F.element_at(acc["table"], F.greatest(acc["pos"], F.lit(1)))

        def moved(x: Column) -> Column:
            jumped = x["to"] > 0
            return F.struct(
                F.when(jumped, x["to"]).otherwise(acc["pos"]).alias("pos"), (acc["gained"] | jumped).alias("gained"), F.when(jumped, acc["kind"]).otherwise(x["kind"]).alias("kind"),
                F.when(jumped, acc["stage"]).otherwise(x["stage"]).alias("stage"), F.when(jumped, acc["branch"]).otherwise(x["branch"]).alias("branch"), acc["table"].alias("table"),
            )

        return F.when(acc["kind"] != "", acc).otherwise(_let(F.when(acc["gained"], row["gained"]).otherwise(row["fresh"]), moved))

    whole = F.struct(F.lit(1).alias("pos"), F.lit(False).alias("gained"), F.lit("").alias("kind"), F.lit(0).alias("stage"), F.lit("").alias("branch"), table.alias("table"))
    result = lambda kind, cap, stage, branch: F.struct(kind.alias("kind"), cap.cast("int").alias("cap"), stage.alias("stage"), branch.alias("branch"))
    found = F.aggregate(F.sequence(F.lit(1), F.size(st) + 1), whole, step, lambda out: result(out["kind"], F.when(out["kind"] == "positive", out["stage"]), out["stage"], out["branch"]))
    return F.when(F.size(st) == 0, result(F.lit("invalid"), F.lit(None), F.lit(1), F.lit("empty_applicable_stages"))).otherwise(found)


def policy_struct(policy: CapPolicy | None = None, prefix: str = "") -> Column:
    """The thresholds as a struct: of a policy, or of columns of a joined policies table."""
    names = ("horizon", "tau_rel", "tau_abs", "drop_ratio", "floor_ratio")
    return F.struct(*[(F.lit(getattr(policy, n)) if policy else F.col(prefix + n)).alias(n) for n in names])


def decide(stages: DataFrame, pol: Column, keys: Sequence[str] = ("traj_id", "eq", "split"), branches: bool = False) -> DataFrame:
    """keys, kind, cap, stage (and branch) from a stage table (keys, stage, residual, floor_ms, usable; missing stages are
    empty)."""
    extra = [c for c in stages.columns if c not in (*keys, "stage", "residual", "floor_ms", "usable")]
    g = stages.groupBy(*keys, *extra).agg(F.array_sort(F.collect_list(F.struct("stage", "residual", "floor_ms", "usable"))).alias("s"))  # at most five
    d = split_decision(F.col("s.residual"), F.col("s.floor_ms"), F.col("s.usable"), F.col("s.stage"), pol)
    return g.select(*keys, *extra, F.inline(F.array(d))).drop(*([] if branches else ["branch"]))


def majority_branch(decisions: DataFrame, keys: Sequence[str] = ("traj_id", "eq")) -> DataFrame:
    """keys and branch: the one that decides most splits; ties by name. A series has as many decisions as splits."""
    n = decisions.groupBy(*keys, "branch").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "branch"))["branch"].alias("branch"))


def vote(decisions: DataFrame, mode: str = "majority", keys: Sequence[str] = ("traj_id", "eq")) -> DataFrame:
    """keys, cap (null: no cap) over the splits' decisions; an undecidable split at or below a cap blocks it."""
    ok = F.col("kind") != "invalid"
    g = decisions.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.min(F.when(F.col("kind") == "undecidable", F.col("stage"))).alias("block"), F.array_sort(F.collect_list("cap")).alias("caps"), F.count_if(F.col("kind") == "positive").alias("pos")
    )
    free = lambda c: F.coalesce(F.col("block") > c, F.lit(True))
    if mode == "any_positive":
        c = F.array_min("caps")
        cap = F.when(free(c), c)
    elif mode == "unanimous":
        c = F.when(F.size("caps") > 0, F.element_at("caps", F.ceil(F.size("caps") / 2).cast("int")))
        cap = F.when((F.col("pos") == F.col("n")) & free(c), c)
    elif mode == "majority":
        fits = F.filter(F.array_distinct("caps"), lambda c: (F.size(F.filter("caps", lambda x: x == c)) > F.col("n") / 2) & free(c))
        cap = F.array_min(fits)
    else:
        raise ValueError(f"unknown aggregation {mode!r}")
    return g.select(*keys, cap.alias("cap"))


STAGE_FITS = "eq int, split string, stage int, residual double, floor_ms double, usable boolean, rank int, cond double"


def stage_fits(src: DataFrame, basis: Sequence[Term], dim: int, policy: CapPolicy = CapPolicy(), by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """by, eq, split, stage, residual, floor_ms, usable, rank, cond: the cumulative fit of each non-empty stage.

    Weighted fit on a split's fit rows, unweighted residual on its holdout, from block factors (or rows for them) alone.
    """
    policy.check()
    p = len(basis)
    upto = {s: sum(t.stage <= s for t in basis) for s in range(1, STAGES + 1) if any(t.stage == s for t in basis)}

    def fits(m: R.Many) -> dict:
        shape = (len(m), 4, dim, len(upto))
        res, floor, cond, rank, good = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape, int), np.zeros(shape, bool)
        for i, (fit, hold) in enumerate(m.roles().values()):
            na, nb, plain, held = m.rows_of(fit), m.rows_of(hold), m.plain_of(fit), m.plain_of(hold)
            tested = [R.ranks(plain[:, :, :k], na) for k in upto.values()]
            for e in range(dim):
                w = m.weighted_of(fit, e)
                spread = np.nan_to_num(m.mean_of(fit, 1, e) - m.mean_of(fit, 0, e) ** 2)
                floor[:, i, e] = np.nan_to_num(m.mean_of(hold, 2, e), nan=np.inf)[:, None]
                for j, k in enumerate(upto.values()):
                    c = R.least_squares(w[:, :, :k], w[:, :, p])
                    res[:, i, e, j] = R.residuals(held, range(k), p + e, c, nb)
                    rank[:, i, e, j], cond[:, i, e, j] = tested[j]
                    good[:, i, e, j] = (rank[:, i, e, j] == k) & (cond[:, i, e, j] <= policy.cond_cap) & (spread >= policy.excitation_floor) & np.isfinite(c).all(1) & np.isfinite(res[:, i, e, j])
        at = lambda values, axis: np.array(values).reshape([-1 if k == axis else 1 for k in range(4)])
        return {"eq": at(range(1, dim + 1), 2), "split": at(list("ABCD"), 1), "stage": at(list(upto), 3), "residual": res, "floor_ms": floor, "usable": good, "rank": rank, "cond": cond}

    return R.in_batches(src, p, dim, fits, STAGE_FITS, by)


def stage_table(traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], policy: CapPolicy, by: Sequence[str] = ("traj_id",), rows: int | None = None) -> DataFrame:
    """The stage fits of trajectories. rows: spread series over tasks in ranges of so many rows."""
    return stage_fits(R.prepare(traj, basis, cols, policy.estimator, policy.weighting, by, rows), basis, len(cols), policy, by)


def stage_table_given(traj: DataFrame, basis: Sequence[Term], given: Sequence[str], policy: CapPolicy, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """The stage fits where the derivatives are known: columns `given` of traj, with floor 0 and equal weights."""
    return stage_fits(R.prepare_given(traj, basis, given, by), basis, len(given), policy, by)


def estimate_stage_caps(traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], policy: CapPolicy = CapPolicy()) -> DataFrame:
    """traj_id, eq, cap. A library with one stage only has nothing to cap: all null."""
    policy.check()
    if len({t.stage for t in basis}) == 1:
        eqs = F.explode(F.array(*[F.lit(i + 1) for i in range(len(cols))]))
        return traj.select("traj_id").distinct().select("traj_id", eqs.alias("eq"), F.lit(None).cast("int").alias("cap"))
    table = stage_table(traj, basis, cols, policy).drop("rank", "cond")
    return vote(decide(table, policy_struct(policy)), policy.aggregation)


def effective_stages(stages: DataFrame, top: int) -> DataFrame:
    """traj_id, eq, stage limited by cap (null: top), and the run's largest limit. stages: traj_id, eq, stage, cap."""
    if top < 1:
        raise ValueError("top must be at least 1")
    limit = F.least(F.coalesce("cap", F.lit(top)), F.lit(top))
    return stages.select("traj_id", "eq", F.least("stage", limit).alias("stage"), F.max(limit).over(Window.partitionBy("traj_id")).alias("run_limit"))


def stage_gains(table: DataFrame) -> DataFrame:
    """Gain from each stage to the next non-empty one, and the verdict on it."""
    w = Window.partitionBy("traj_id", "split").orderBy("stage")
    nxt, ok = F.lead("residual").over(w), F.lead("usable").over(w)
    t = table.select("traj_id", "split", "stage", "residual", "usable", nxt.alias("nr"), ok.alias("nu"))
    both = F.col("usable") & F.col("nu")
    gain = F.when(both, F.col("residual") - F.col("nr"))
    rel = F.when(both, F.when(F.col("residual") == 0, F.lit(INF)).otherwise((F.col("residual") - F.col("nr")) / F.col("residual")))
    verdict = F.when(F.col("usable") & F.col("nu").isNull(), "no_potential").when(both & (gain > 0), "potential_detected").when(both, "no_potential").otherwise("invalid_or_inconclusive")
    return t.select("traj_id", "split", "stage", gain.alias("gain_abs"), rel.alias("gain_rel"), verdict.alias("verdict"))


def threshold_grid(table: DataFrame, grid: DataFrame) -> DataFrame:
    """traj_id, split, tau_rel, tau_abs, useful: the largest stage that gains on the one before, for each threshold pair.

    The grid is a few dozen rows and is broadcast; rows multiply by its fixed size.
    """
    w = Window.partitionBy("traj_id", "split").orderBy("stage")
    t = table.select("traj_id", "split", "residual", "usable", F.lead("stage").over(w).alias("ns"), F.lead("residual").over(w).alias("nr"), F.lead("usable").over(w).alias("nu")).crossJoin(F.broadcast(grid))
    delta = F.col("residual") - F.col("nr")
    hit = F.col("usable") & F.col("nu") & (delta > F.col("tau_abs")) & (F.when(F.col("residual") == 0, F.lit(INF)).otherwise(delta / F.col("residual")) > F.col("tau_rel"))
    return t.groupBy("traj_id", "split", "tau_rel", "tau_abs").agg(F.coalesce(F.max(F.when(hit, F.col("ns"))), F.lit(1)).alias("useful"))


def grid_summary(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """tau_rel, tau_abs, under, exact, over: lower-median stage over splits against the expected one (traj_id, expected)."""
    med = grid.groupBy("traj_id", "tau_rel", "tau_abs").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY useful)").alias("m")).join(expected, "traj_id")
    n = lambda c: F.count_if(c)
    return med.groupBy("tau_rel", "tau_abs").agg(n(F.col("m") < F.col("expected")).alias("under"), n(F.col("m") == F.col("expected")).alias("exact"), n(F.col("m") > F.col("expected")).alias("over"))


def separation(grid: DataFrame, low: int, high: int, at: int) -> DataFrame:
    """Threshold pairs (and how many splits) under which series `low` stays under stage `at` and series `high` reaches it."""
    g = grid.groupBy("tau_rel", "tau_abs", "split").agg(F.max(F.when(F.col("traj_id") == low, F.col("useful"))).alias("lo"), F.max(F.when(F.col("traj_id") == high, F.col("useful"))).alias("hi"))
    return g.groupBy("tau_rel", "tau_abs").agg(F.count_if((F.col("lo") < at) & (F.col("hi") >= at)).alias("splits_apart")).where("splits_apart > 0")


def derived_stage(table: DataFrame, tau_rel: float, tau_abs: float, rule: str) -> DataFrame:
    """traj_id, predicted ('rank_deficient' or 'invalid_or_inconclusive' or a stage as text): per split the largest gain
    before the first stage that is not usable; then the lower median of the splits. table also has deficient (boolean)."""
    w = Window.partitionBy("traj_id", "split").orderBy("stage")
    good = F.col("usable") & ~F.col("deficient")
    t = table.withColumns({"good": good, "prefix": F.min(good.cast("int")).over(w), "n_stage": F.lead("stage").over(w), "nr": F.lead("residual").over(w), "ng": F.lead(good).over(w)})
    gain = counts_gain_rule(F.lit(rule), F.col("residual"), F.col("nr"), F.col("floor_ms"), F.lit(tau_rel), F.lit(tau_abs))
    s = t.groupBy("traj_id", "split").agg(
        F.max(F.when((F.col("prefix") == 1) & F.col("ng") & gain, F.col("n_stage"))).alias("m"), F.bool_or((F.col("stage") == 1) & F.col("good")).alias("starts"), F.bool_or((F.col("stage") == 1) & F.col("deficient")).alias("poor")
    )
    g = s.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.when(F.col("starts"), F.coalesce("m", F.lit(1))))).alias("ms"), F.bool_or("poor").alias("poor"))
    med = F.element_at("ms", F.greatest(F.ceil(F.size("ms") / 2), F.lit(1)).cast("int"))
    return g.select("traj_id", F.when(F.size("ms") > 0, med.cast("string")).when(F.col("poor"), "rank_deficient").otherwise("invalid_or_inconclusive").alias("predicted"))


def stage_confusion(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    p = F.expr("try_cast(predicted AS INT)")
    c = F.when(p.isNull(), F.col("predicted")).when(p < F.col("expected"), "under").when(p > F.col("expected"), "over").otherwise("exact")
    return predicted.join(expected, "traj_id").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def identifiability(table: DataFrame, expected: DataFrame) -> DataFrame:
    """traj_id, first stage and split below the expected stage that already reaches the floor; null if none does."""
    j = table.join(expected, "traj_id")
    hit = (F.col("stage") < F.col("expected")) & F.col("usable") & (F.col("residual") <= F.col("floor_ms"))
    g = j.groupBy("traj_id").agg(F.min(F.when(hit, F.struct("stage", "split"))).alias("f"), F.bool_or((F.col("stage") == F.col("expected")) & F.col("usable")).alias("usable_at_expected"))
    return g.select("traj_id", F.col("f.stage").alias("stage"), F.col("f.split").alias("split"), F.coalesce("usable_at_expected", F.lit(False)).alias("usable_at_expected"))


def split_exclusions(table: DataFrame) -> DataFrame:
    reason = F.when(~finite(F.col("residual")), "non_finite").when(~F.col("usable"), "unusable").when(F.col("residual") <= F.col("floor_ms"), "at_floor").otherwise("kept")
    return table.groupBy("split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def classify_cap(cap: Column, true_stage: Column, kind: str) -> Column:
    """Cap taxonomies; a missing cap comes first."""
    names = {"audit": ("uncapped", "truncated", "ok", "ok"), "grid": ("nothing", "violation", "correct", "conservative"), "commit": ("abstain", "wrong_commit", "correct_commit", "correct_commit")}[kind]
    return F.when(cap.isNull(), names[0]).when(cap < true_stage, names[1]).when(cap == true_stage, names[2]).otherwise(names[3])


def horizon_audit(caps: DataFrame, base: int = 2) -> DataFrame:
    """horizon, classes, truncated series, and caps changed, gained or lost against the base horizon.

    caps: horizon, traj_id, eq, cap, true_stage.
    """
    b = caps.where(F.col("horizon") == base).select("traj_id", "eq", F.col("cap").alias("bc"))
    k = classify_cap(F.col("cap"), F.col("true_stage"), "audit")
    j = caps.join(b, ["traj_id", "eq"]).withColumn("k", k)
    return j.groupBy("horizon").agg(
        *[F.count_if(F.col("k") == x).alias(x) for x in ("truncated", "ok", "uncapped")], F.countDistinct(F.when(F.col("k") == "truncated", F.col("traj_id"))).alias("truncated_series"),
        F.count_if(~F.col("cap").eqNullSafe(F.col("bc"))).alias("changed"), F.count_if(F.col("cap").isNull() & F.col("bc").isNotNull()).alias("lost"), F.count_if(F.col("cap").isNotNull() & F.col("bc").isNull()).alias("gained"),
    )


def first_acceptable_horizon(audit: DataFrame, most_truncated: int) -> DataFrame:
    return audit.agg(F.min(F.when(F.col("truncated") <= most_truncated, F.col("horizon"))).alias("horizon"))


def compare_caps(a: DataFrame, b: DataFrame) -> DataFrame:
    """traj_id, eq, same, ok: null-safe comparison of two sources; ok is false unless each has exactly one row."""
    side = lambda d, x: d.groupBy("traj_id", "eq").agg(F.count(F.lit(1)).alias(f"n{x}"), F.max("cap").alias(f"c{x}"))
    j = side(a, "a").join(side(b, "b"), ["traj_id", "eq"], "full")
    one = F.coalesce((F.col("na") == 1) & (F.col("nb") == 1), F.lit(False))
    return j.select("traj_id", "eq", (one & F.col("ca").eqNullSafe(F.col("cb"))).alias("same"), one.alias("ok"))


def low_signal_overlap(rows: DataFrame, most: float = 0.1) -> DataFrame:
    low = F.coalesce(F.col("active") <= most, F.lit(False))
    return rows.agg(F.count_if(low).alias("low_activity"), F.count_if("failing").alias("failing"), F.count_if(low & F.col("failing")).alias("both"))


def loso_thresholds(rows: DataFrame) -> DataFrame:
    """Leave one group out: grp, drop_ratio, floor_ratio, abstains, correct. rows: grp, drop_ratio, floor_ratio, verdict.

    For each held-out group, threshold pairs without a wrong commit on the other groups; of these the lexicographic least
    of (abstains, -correct, drop_ratio, floor_ratio). Totals minus the group's own counts stand for the others, so rows
    are aggregated once.
    """
    cnt = lambda v: F.count_if(F.col("verdict") == v)
    own = rows.groupBy("grp", "drop_ratio", "floor_ratio").agg(cnt("wrong_commit").alias("w"), cnt("abstain").alias("a"), cnt("correct_commit").alias("c"))
    w = Window.partitionBy("drop_ratio", "floor_ratio")
    rest = own.select("grp", "drop_ratio", "floor_ratio", *[(F.sum(x).over(w) - F.col(x)).alias(x) for x in ("w", "a", "c")])
    best = rest.where("w = 0").groupBy("grp").agg(F.min(F.struct("a", (-F.col("c")).alias("nc"), "drop_ratio", "floor_ratio")).alias("b"))
    return best.select("grp", "b.drop_ratio", "b.floor_ratio", F.col("b.a").alias("abstains"), (-F.col("b.nc")).alias("correct"))


def reliability_matrix(caps: DataFrame, other: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of commits and abstentions; an abstention is unnecessary where the other policy commits correctly."""
    j = caps.join(other.select("traj_id", "eq", F.col("cap").alias("oc")), ["traj_id", "eq"]).join(truth, ["traj_id", "eq"])
    c, o = classify_cap(F.col("cap"), F.col("true_stage"), "commit"), classify_cap(F.col("oc"), F.col("true_stage"), "commit")
    v = F.when(c != "abstain", c).when(o == "correct_commit", "unnecessary_abstain").otherwise("correct_abstain")
    return j.agg(*[F.count_if(v == x).alias(x) for x in ("correct_commit", "wrong_commit", "unnecessary_abstain", "correct_abstain")])


def trace_decisions(stages: DataFrame, pol: Column, keys: Sequence[str] = ("traj_id", "eq", "split")) -> DataFrame:
    """The decisions with the exits of every position as text, for reading."""
    g = stages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stage", "residual", "floor_ms", "usable"))).alias("s"))
    res, fl, us, st = (F.col(f"s.{c}") for c in ("residual", "floor_ms", "usable", "stage"))

    def text(p: Column) -> Column:
        word = lambda x: F.when(x["to"] > 0, F.concat(F.lit("to "), F.element_at(st, F.greatest(x["to"], F.lit(1))).cast("string"))).otherwise(F.concat(x["kind"], F.lit(" at "), x["stage"].cast("string")))
        return _let(_moves(res, fl, us, st, pol, p), lambda x: F.concat(F.lit("stage "), F.element_at(st, p).cast("string"), F.lit(": "), word(x["fresh"]), F.lit(", after a gain: "), word(x["gained"])))

    traced = g.withColumn("trace", F.concat_ws("; ", F.transform(F.sequence(F.lit(1), F.size(st)), text)))
    return traced.select(*keys, "trace", F.inline(F.array(split_decision(res, fl, us, st, pol)))).select(*keys, "kind", "cap", "stage", "trace")


def cap_changes(new: DataFrame, base: DataFrame, allowed: DataFrame) -> DataFrame:
    """traj_id, eq, old, new, allowed: caps that differ from a stored baseline, and whether the change is on the list."""
    j = new.select("traj_id", "eq", F.col("cap").alias("new")).join(base.select("traj_id", "eq", F.col("cap").alias("old")), ["traj_id", "eq"]).where(~F.col("new").eqNullSafe(F.col("old")))
    return j.join(allowed.select("traj_id", "eq", F.lit(True).alias("allowed")).distinct(), ["traj_id", "eq"], "left").select("traj_id", "eq", "old", "new", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def cap_sensitivity(stages: DataFrame, factors: Sequence[float], policy: CapPolicy = CapPolicy()) -> DataFrame:
    """traj_id, eq, caps (distinct, null as 0), n_caps over both thresholds scaled by each factor, on one stage table."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(factors)]))
    t = stages.withColumn("g", grid).select("*", F.col("g.i").alias("policy"), (F.lit(policy.tau_rel) * F.col("g.f")).alias("tau_rel"), (F.lit(policy.tau_abs) * F.col("g.f")).alias("tau_abs")).drop("g")
    p = F.struct(F.lit(policy.horizon).alias("horizon"), F.col("tau_rel").alias("tau_rel"), F.col("tau_abs").alias("tau_abs"), F.lit(policy.drop_ratio).alias("drop_ratio"), F.lit(policy.floor_ratio).alias("floor_ratio"))
    caps = vote(decide(t, p), policy.aggregation, ("traj_id", "eq", "policy"))
    return caps.groupBy("traj_id", "eq").agg(F.array_sort(F.collect_set(F.coalesce("cap", F.lit(0)))).alias("caps")).select("traj_id", "eq", "caps", F.size("caps").alias("n_caps"))


def sensitivity(stages: DataFrame, rel_factors: Sequence[float], abs_factors: Sequence[float], policy: CapPolicy = CapPolicy(), keys: Sequence[str] = ("traj_id", "eq")) -> DataFrame:
    """keys, rel_factor, abs_factor, cap, branch: caps and the branch of most splits with both thresholds scaled, each by
    every factor of its own list.

    Thresholds change no fit, so all pairs share one stage table; each split's rows are gathered once and decided for the
    grid's few pairs. keys may hold the source of the derivatives (stage_table, stage_table_given).
    """
    grid = [(x, y) for x in rel_factors for y in abs_factors]
    if not grid or len(set(grid)) != len(grid):
        raise ValueError("factors must be distinct, at least one for each threshold")
    pairs = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("rel_factor"), F.lit(float(y)).alias("abs_factor")) for x, y in grid]))
    g = stages.groupBy(*keys, "split").agg(F.array_sort(F.collect_list(F.struct("stage", "residual", "floor_ms", "usable"))).alias("s")).select("*", pairs.alias("g"))  # at most five stages
    p = F.struct(F.lit(policy.horizon).alias("horizon"), (F.lit(policy.tau_rel) * F.col("g.rel_factor")).alias("tau_rel"), (F.lit(policy.tau_abs) * F.col("g.abs_factor")).alias("tau_abs"), F.lit(policy.drop_ratio).alias("drop_ratio"), F.lit(policy.floor_ratio).alias("floor_ratio"))
    d = split_decision(F.col("s.residual"), F.col("s.floor_ms"), F.col("s.usable"), F.col("s.stage"), p)
    per = [*keys, "rel_factor", "abs_factor"]
    rows = g.select(*keys, "split", "g.rel_factor", "g.abs_factor", F.inline(F.array(d)))
    return vote(rows, policy.aggregation, per).join(majority_branch(rows, per), per)


def sensitivity_summary(rows: DataFrame, stage: int, keys: Sequence[str] = ("traj_id", "eq")) -> DataFrame:
    """keys, caps (distinct ones as text, none for null), n (pairs of factors) and at_stage (pairs whose cap is `stage`)."""
    text = F.concat_ws(", ", F.array_sort(F.collect_set(F.coalesce(F.col("cap").cast("string"), F.lit("none")))))
    return rows.groupBy(*keys).agg(text.alias("caps"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("cap") == stage).alias("at_stage"))


def cap_audit(new: DataFrame, base: DataFrame, allowed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: rows compared, changed, changed outside `allowed`, caps (not null) before and after, targets, targets met and
    targets without a row. allowed: traj_id, eq; targets: traj_id, eq, expected (null: no cap), one row each."""
    j = new.select("traj_id", "eq", F.col("cap").alias("new")).join(base.select("traj_id", "eq", F.col("cap").alias("old")), ["traj_id", "eq"])
    j = j.join(allowed.select("traj_id", "eq", F.lit(True).alias("allowed")).distinct(), ["traj_id", "eq"], "left").withColumn("changed", ~F.col("new").eqNullSafe(F.col("old")))
    t = targets.join(j.select("traj_id", "eq", "new", F.lit(True).alias("there")), ["traj_id", "eq"], "left")
    met = t.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("there") & F.col("new").eqNullSafe(F.col("expected"))).alias("targets_met"), F.count_if(F.col("there").isNull()).alias("targets_missing"))
    n = j.agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed"), F.count_if(F.col("changed") & F.col("allowed").isNull()).alias("violations"), F.count("old").alias("finite_before"), F.count("new").alias("finite_after"))
    return n.crossJoin(F.broadcast(met))  # one row each


def post_floor_events(stages: DataFrame, policy: CapPolicy = CapPolicy(), keys: Sequence[str] = ("traj_id", "eq", "split")) -> DataFrame:
    """The first stage of each split that lies at its floor: ratio of the best later residual, floor ratio and outcome."""
    g = stages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stage", "residual", "floor_ms", "usable"))).alias("s"))
    res, fl = F.col("s.residual"), F.col("s.floor_ms")
    p = F.array_min(F.filter(F.sequence(F.lit(1), F.size("s")), lambda q: F.element_at(res, q) <= F.element_at(fl, q)))
    t = g.withColumn("p", p).where("p is not null")
    cur = F.element_at(res, F.col("p"))
    ratio = F.when(cur > 0, F.array_min(_later(res, F.col("p"))) / cur)
    return t.select(*keys, F.element_at("s.stage", F.col("p")).alias("stage"), ratio.alias("later_ratio"), F.when(F.element_at(fl, F.col("p")) > 0, cur / F.element_at(fl, F.col("p"))).alias("floor_ratio"), post_floor(res, fl, F.col("p"), F.lit(policy.drop_ratio), F.lit(policy.floor_ratio)).alias("outcome"))


def nearest_event(events: DataFrame) -> DataFrame:
    """Per equation the event whose later ratio is nearest to one half; without finite ratios the first by split."""
    key = F.struct(F.when(F.col("later_ratio").isNull(), F.lit(INF)).otherwise(F.abs(F.col("later_ratio") - 0.5)).alias("d"), F.col("split").alias("split"))
    return events.groupBy("traj_id", "eq").agg(F.min_by(F.struct("split", "stage", "later_ratio", "outcome"), key).alias("e")).select("traj_id", "eq", "e.*")


