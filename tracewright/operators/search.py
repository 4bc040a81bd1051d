"""Batched structure search: one job per level over all series, scored in derivative space.

Losses here are derivative-space residuals; they are not comparable with losses of simulated trajectories. Every random
draw is a hash of (seed, series, level, parent, child, draw), so results do not depend on partitioning or retries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.scratch import cut

from . import regression as R
from .terms import Term, open_terms

INF = float("inf")


@dataclass(frozen=True)
class SearchPolicy:
    pop_size: int = 8
    children: int = 3
    max_terms: int = 4
    growth: str = "soft"
    hard_p: float = 0.75
    penalty: float = 1e-4
    max_levels: int = 6
    min_levels: int = 2
    loss_tol: float = 1e-10
    window: int = 2
    plateau_tol: float = 1e-8
    plateau_relative: bool = False
    min_per_stage: int = 1
    coherent: bool = True
    #: Stages belong to each equation of a series ("equation") or to the series as a whole ("series").
    progress: str = "equation"
    #: Children that enter selection per series and level, gated against their parents first (None: all of them).
    screen_k: int | None = None
    gate_alpha: float = 0.05
    seed: int = 0


#: (residuals by equation, parameters by equation, rows) -> loss of a structure.
Loss = Callable[[Column, Column, Column], Column]


def mean_loss(residuals: Column, n_params: Column, n: Column) -> Column:
    """Mean of the equations' residuals."""
    return F.aggregate(residuals, F.lit(0.0), lambda a, x: a + x) / F.size(residuals)


def worst_loss(residuals: Column, n_params: Column, n: Column) -> Column:
    """Residual of the worst equation."""
    return F.array_max(residuals)


def information_loss(residuals: Column, n_params: Column, n: Column) -> Column:
    """Mean over equations of log residual + 2 * parameters / rows."""
    each = F.zip_with(residuals, n_params, lambda r, k: F.log(F.greatest(r, F.lit(2.220446049250313e-16))) + 2 * k / n)
    return mean_loss(each, n_params, n)


@dataclass(frozen=True)
class Scoring:
    """How candidates are judged: by a loss (a Column of their equations' residuals) and by a solver that fits term sets on a
    series' factor (regression.Solver). Both can be one's own; every search takes them."""

    loss: Loss = mean_loss
    solver: R.Solver = R.solve_many


#: Counters of a search, summed over candidates: candidates judged, term sets solved, term sets shared with another
#: candidate of the level, invalid candidates.
COUNTERS = ("evaluations", "fits", "shared", "invalid")


def _counted() -> dict[str, Column]:
    """Aggregates of scored candidates (rows without fits don't count): COUNTERS, and the codes to flatten."""
    codes = F.filter(F.flatten(F.transform("reasons", lambda w: F.split(w, ";"))), lambda w: w != "")
    return {"evaluations": F.count("fits"), "fits": F.sum("fits"), "shared": F.sum("shared"), "invalid": F.count_if(~F.col("valid") & F.col("fits").isNotNull()), "codes": F.collect_set(codes)}


def _union(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(codes)))


def costs(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, COUNTERS and codes (sorted distinct reasons of invalid fits, a handful) of scored candidates."""
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in _counted().items()]).withColumn("codes", _union(F.col("codes")))


def run_costs(log: DataFrame) -> DataFrame:
    """traj_id, levels, COUNTERS and codes of whole searches, from the rows of their levels."""
    return log.groupBy("traj_id").agg(F.count(F.lit(1)).alias("levels"), *[F.sum(c).alias(c) for c in COUNTERS], _union(F.collect_set("codes")).alias("codes"))


def draw(n: Column, seed: int, *keys: Column | str) -> Column:
    """Whole number from 0 to n - 1, from the md5 of the keys' text: the same in any SQL engine."""
    cols = [F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long"))).cast("int")


def uniform(seed: int, *keys: Column | str) -> Column:
    return draw(F.lit(1 << 30), seed, *keys) / float(1 << 30)


def pick(values: Column, seed: int, *keys: Column | str) -> Column:
    """One element of an array, null if it is empty."""
    return F.when(F.size(values) > 0, F.element_at(values, draw(F.size(values), seed, *keys) + 1))


def init_population(allowed: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """traj_id, cand_id, structure: one random allowed term for each equation. allowed: traj_id, terms (array per equation)."""
    rows = allowed.withColumn("cand_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    one = F.transform("terms", lambda t, e: F.when(F.size(t) > 0, F.array(F.element_at(t, draw(F.size(t), seed, "traj_id", "cand_id", e, F.lit("init")) + 1))).otherwise(F.array().cast("array<int>")))
    return rows.select("traj_id", "cand_id", one.alias("structure"))


def _grow(structure: Column, terms: Column, eq: Column) -> Column:
    """Structure with one more term of the chosen list in equation eq (0-based); unchanged where there is none."""
    return F.transform(structure, lambda s, e: F.when((e == eq) & terms.isNotNull(), F.array_sort(F.array_union(s, F.array(terms)))).otherwise(s))


def expand(parents: DataFrame, allowed: DataFrame, current: DataFrame | None, policy: SearchPolicy, level: int, mode: str | None = None) -> DataFrame:
    """traj_id, parent_id, child, structure: `children` rows for each parent.

    passive: a random equation gets a random unused allowed term. hard: an equation that can take a term of the current
    stage comes first, else passive. soft: hard with probability hard_p. A full equation, or one without a free term,
    gives an unchanged copy. allowed and current: traj_id, terms (array of arrays by equation); without current: passive.
    """
    mode = mode or policy.growth
    if mode not in ("passive", "hard", "soft"):
        raise ValueError(f"unknown growth {mode!r}")
    rows = parents.join(allowed.withColumnRenamed("terms", "allowed"), "traj_id")
    rows = rows.join(current.withColumnRenamed("terms", "current"), "traj_id") if current is not None else rows.withColumn("current", F.transform("allowed", lambda x: F.array().cast("array<int>")))
    return _children(rows, policy, level, mode).select("traj_id", F.col("cand_id").alias("parent_id"), "child", F.col("grown").alias("structure"))


def _children(rows: DataFrame, policy: SearchPolicy, level: int, mode: str) -> DataFrame:
    """rows (traj_id, cand_id, structure, allowed, current) times children, with child (from 1) and grown."""
    rows = rows.withColumn("child", F.explode(F.sequence(F.lit(1), F.lit(policy.children))))
    key = (F.lit(level), "traj_id", "cand_id", "child")
    room = lambda s: F.size(s) < policy.max_terms
    eqs = F.sequence(F.lit(0), F.size("structure") - 1)
    free = lambda lists, e: F.array_except(F.element_at(lists, e + 1), F.element_at("structure", e + 1))
    can = lambda lists: F.filter(eqs, lambda e: room(F.element_at("structure", e + 1)) & (F.size(free(F.col(lists), e)) > 0))
    rows = rows.withColumns({"hard_eqs": can("current"), "growable": can("allowed")})
    forced = F.lit(mode == "hard") if mode != "soft" else uniform(policy.seed, *key, F.lit("mode")) < policy.hard_p
    rows = rows.withColumn("is_hard", forced & (F.size("hard_eqs") > 0))
    any_eq = draw(F.size("structure"), policy.seed, *key, F.lit("eq"))
    # without any term of a current stage growth is passive
    calm = F.when(F.exists("current", lambda t: F.size(t) > 0), F.coalesce(pick(F.col("growable"), policy.seed, *key, F.lit("eq")), any_eq)).otherwise(any_eq) if mode == "soft" else any_eq
    rows = rows.withColumn("eq", F.when(F.col("is_hard"), pick(F.col("hard_eqs"), policy.seed, *key, F.lit("hard"))).otherwise(calm))
    options = F.when(F.col("is_hard"), free(F.col("current"), F.col("eq"))).otherwise(free(F.col("allowed"), F.col("eq")))
    term = F.when(room(F.element_at("structure", F.col("eq") + 1)), pick(F.col("options"), policy.seed, *key, F.lit("term")))
    rows = rows.withColumn("options", options).withColumn("term", term)
    return rows.withColumn("grown", _grow(F.col("structure"), F.col("term"), F.col("eq")))


def score(residual: Column, n: Column, p: Column, valid: Column, mode: str = "residual", eps: float = 2.220446049250313e-16) -> Column:
    """Screening score: residual plus a tie-break on parameters, or AIC; Infinity for invalid candidates."""
    s = {"residual": residual + 1e-12 * p, "aic": n * F.log(F.greatest(residual, F.lit(eps))) + 2 * p}[mode]
    return F.when(F.coalesce(valid, F.lit(False)), s).otherwise(F.lit(INF))


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_quantile(q: float, d1: int, d2: int) -> float:
    """Quantile of the F distribution by bisection on x = d1 f / (d1 f + d2)."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_i(d1 / 2, d2 / 2, mid) < q else (lo, mid)
    x = (lo + hi) / 2
    return d2 * x / (d1 * (1 - x)) if x < 1 else INF


def f_quantiles(pairs: DataFrame, alpha: float) -> DataFrame:
    """df1, df2, threshold for each distinct pair: the join against it is the cache."""

    def run(batches):
        for b in batches:
            yield b.assign(threshold=[f_quantile(1 - alpha, int(a), int(c)) for a, c in zip(b["df1"], b["df2"], strict=True)])

    return pairs.select(F.col("df1").cast("int").alias("df1"), F.col("df2").cast("int").alias("df2")).distinct().mapInPandas(run, "df1 int, df2 int, threshold double")


def nested_f_gate(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """pairs (n, p_child, p_parent, r_child, r_parent, valid: child and parent) plus passes, f_stat, threshold.

    No more parameters than the parent passes; no degrees of freedom left, or no improvement, fails. The quantiles come
    from a join on the degrees of freedom, of which there are few.
    """
    rows = pairs.withColumns({"df1": (F.col("p_child") - F.col("p_parent")).cast("int"), "df2": (F.greatest(F.col("n"), F.lit(1)) - F.col("p_child")).cast("int")})
    q = f_quantiles(rows.where("df1 > 0 and df2 > 0 and valid"), alpha)
    j = rows.join(q, ["df1", "df2"], "left")
    worse = ~((F.col("r_parent") < INF) & (F.col("r_child") < INF)) | (F.col("r_parent") <= F.col("r_child"))
    n = F.greatest(F.col("n"), F.lit(1))
    stat = ((F.col("r_parent") - F.col("r_child")) * n / F.col("df1")) / F.greatest(F.col("r_child") * n / F.col("df2"), F.lit(2.220446049250313e-16))
    f = F.when(~F.col("valid") | (F.col("df1") <= 0) | (F.col("df2") <= 0), None).when(worse, 0.0).otherwise(stat)
    ok = F.when(~F.col("valid"), False).when(F.col("df1") <= 0, True).when(F.col("df2") <= 0, False).otherwise(~worse & (stat > F.col("threshold")))
    return j.select(*pairs.columns, F.coalesce(ok, F.lit(False)).alias("passes"), f.alias("f_stat"), F.when(F.col("valid"), F.col("threshold")).alias("threshold"))


def _ranked(rows: DataFrame, gate: bool) -> DataFrame:
    """Candidates of each series in order: incumbent, then gated ones, then by score; invalid ones last."""
    order = [F.col("incumbent").desc(), F.col("valid").desc(), *([F.col("passes").desc()] if gate else []), F.col("score"), F.col("cand_id")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("traj_id").orderBy(*order)))


def select_topk(rows: DataFrame, k: int, gate: bool = False) -> DataFrame:
    """The first k of each series; invalid candidates only where a series has no valid one. rows: traj_id, cand_id, score,
    valid, incumbent (and passes)."""
    r = _ranked(rows, gate).withColumn("any", F.bool_or("valid").over(Window.partitionBy("traj_id")))
    return r.where((F.col("rn") <= k) & (F.col("valid") | F.col("incumbent") | ~F.col("any"))).drop("rn", "any")


def selection_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """traj_id, n_diff: size of the symmetric difference of two selections."""
    j = a.select("traj_id", "cand_id", F.lit(1).alias("x")).join(b.select("traj_id", "cand_id", F.lit(1).alias("y")), ["traj_id", "cand_id"], "full")
    return j.groupBy("traj_id").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_diff"))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: rank correlation with average ranks over finite pairs; null for fewer than two or without spread."""
    fin = rows.where((F.abs(x) < INF) & (F.abs(y) < INF))
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    r = fin.select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    ok = (F.count(F.lit(1)) >= 2) & (F.var_pop("rx") > 0) & (F.var_pop("ry") > 0)
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("rx", "ry")).alias("rho"))


def rank_summary(rhos: DataFrame) -> DataFrame:
    v = F.when(F.abs("rho") < INF, F.col("rho"))
    return rhos.agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_finite"), F.count(F.lit(1)).alias("n"))


def rejected_check(rows: DataFrame, k: int, m: int, loss: str = "loss") -> DataFrame:
    """Per series: of the next m after the first k, how many have a smaller loss than the best selected one."""
    r = _ranked(rows, False).where(F.col("rn") <= k + m)
    best = F.min(F.when(F.col("rn") <= k, F.col(loss))).over(Window.partitionBy("traj_id"))
    r = r.withColumn("best", best)
    return r.groupBy("traj_id").agg(F.count_if(F.col("rn") > k).alias("checked"), F.count_if((F.col("rn") > k) & (F.col(loss) < F.col("best"))).alias("better"))


def select_population(parents: DataFrame, children: DataFrame, size: int, penalty: float) -> DataFrame:
    """The `size` best of parents and children by loss + penalty * n_params; a parent wins ties, then the smaller id."""
    both = parents.withColumn("is_child", F.lit(0)).unionByName(children.withColumn("is_child", F.lit(1)))
    both = both.withColumn("objective", F.col("loss") + penalty * F.col("n_params"))
    rn = F.row_number().over(Window.partitionBy("traj_id").orderBy("objective", "is_child", "cand_id"))
    return both.withColumn("rn", rn).where(F.col("rn") <= size)


def _plateau(best: Column, old: Column, policy: SearchPolicy) -> Column:
    delta = old - best
    return delta / F.greatest(F.abs(old), F.lit(2.220446049250313e-16)) < policy.plateau_tol if policy.plateau_relative else delta < policy.plateau_tol


def _why(policy: SearchPolicy) -> str:
    return "plateau_relative" if policy.plateau_relative else "plateau_absolute"


def should_stop(history: DataFrame, policy: SearchPolicy) -> DataFrame:
    """history (traj_id, level, best, loss) with reason: max_levels, min_levels, loss_tol, a plateau or continue, in that
    order, and stop."""
    old = F.lag("best", policy.window).over(Window.partitionBy("traj_id").orderBy("level"))
    reason = F.when(F.col("level") >= policy.max_levels, "max_levels").when(F.col("level") < policy.min_levels, "min_levels").when(F.col("loss") < policy.loss_tol, "loss_tol").when(old.isNotNull() & _plateau(F.col("best"), old, policy), _why(policy)).otherwise("continue")
    return history.withColumn("reason", reason).withColumn("stop", ~F.col("reason").isin("min_levels", "continue"))


def _progress(level: Column, loss: Column, n: Column, best: Column, old: Column, stage: Column, top: int | Column, policy: SearchPolicy) -> tuple[Column, Column]:
    """(reason, action) of a series whose stage has n levels, the last of them `best`, and `old` a window before (or null)."""
    flat = old.isNotNull() & _plateau(best, old, policy)
    reason = (
        F.when(level >= policy.max_levels, "max_levels").when(loss < policy.loss_tol, "loss_tol").when(n < policy.min_per_stage, "stage_budget")
        .when(old.isNull(), "insufficient_history").when(flat, _why(policy)).otherwise("continue")
    )
    return reason, F.when(reason.isin("max_levels", "loss_tol"), "stop").when(reason == _why(policy), F.when(stage < top, "promote").otherwise("stop")).otherwise("stay")


def stage_progression(history: DataFrame, policy: SearchPolicy, top: int | Column) -> DataFrame:
    """history (traj_id, level, stage, best, loss) with action (stop, stay, promote) and reason; plateaus are per stage.

    top is the last stage, a number or a column.
    """
    w = Window.partitionBy("traj_id", "stage").orderBy("level")
    h = history.withColumns({"__old": F.lag("best", policy.window).over(w), "__n": F.row_number().over(w)})
    reason, action = _progress(F.col("level"), F.col("loss"), F.col("__n"), F.col("best"), F.col("__old"), F.col("stage"), top, policy)
    return h.withColumns({"reason": reason, "action": action}).drop("__old", "__n")


def _limit(stage: Column, cap: Column, top: int) -> Column:
    """The last stage that an equation may reach: its cap, but not less than where it stands."""
    return F.when(cap.isNull(), F.lit(top)).otherwise(F.greatest(cap, stage))


def _may_promote(flat: Column, n: Column, residual: Column, stage: Column, cap: Column, policy: SearchPolicy, top: int) -> Column:
    """Flat, after n levels of its stage that are enough, above loss_tol and below its limit."""
    return flat & (n >= max(policy.min_per_stage, policy.window + 1)) & (residual > policy.loss_tol) & (stage < _limit(stage, cap, top))


def promote_equations(history: DataFrame, policy: SearchPolicy, top: int) -> DataFrame:
    """history (traj_id, eq, level, stage, cap, residual) with promote: the last `window` residuals of the stage lie within
    the tolerance, the stage has had enough levels, the residual is above loss_tol and the stage below its limit."""
    w = Window.partitionBy("traj_id", "eq", "stage").orderBy("level")
    frame = w.rowsBetween(-(policy.window - 1), 0)
    flat = (F.count("residual").over(frame) >= policy.window) & (F.max("residual").over(frame) - F.min("residual").over(frame) < policy.plateau_tol)
    h = history.withColumns({"plateaued": flat, "__n": F.row_number().over(w)})
    return h.withColumn("promote", _may_promote(F.col("plateaued"), F.col("__n"), F.col("residual"), F.col("stage"), F.col("cap"), policy, top)).drop("__n")


def apply_promotion(promotions: DataFrame) -> DataFrame:
    """promotions (traj_id, eq, level, promote) with stage (from 1), the level's number within its stage and promoted_at."""
    w = Window.partitionBy("traj_id", "eq").orderBy("level")
    before = F.coalesce(F.sum(F.col("promote").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = promotions.withColumn("stage", (before + 1).cast("int"))
    return p.withColumn("in_stage", F.row_number().over(Window.partitionBy("traj_id", "eq", "stage").orderBy("level"))).withColumn("promoted_at", F.when(F.col("promote"), F.col("level")))


def _ending(level: Column, loss: Column, done: Column, policy: SearchPolicy) -> Column:
    """Why a series with stages by equation ends, or min_levels or continue; done: all equations flat at their limits."""
    return F.when(level >= policy.max_levels, "max_levels").when(level < policy.min_levels, "min_levels").when(loss < policy.loss_tol, "loss_tol").when(done, "all_equations_max_stage_plateau").otherwise("continue")


def terminate_v3(rows: DataFrame, policy: SearchPolicy, top: int) -> DataFrame:
    """Per series and level: reason and stop. rows: traj_id, level, loss, eq, stage, cap, plateaued."""
    g = rows.groupBy("traj_id", "level").agg(F.max("loss").alias("loss"), F.bool_and((F.col("stage") >= _limit(F.col("stage"), F.col("cap"), top)) & F.col("plateaued")).alias("done"))
    return g.select("traj_id", "level", _ending(F.col("level"), F.col("loss"), F.col("done"), policy).alias("reason")).withColumn("stop", ~F.col("reason").isin("min_levels", "continue"))


def overshoot(stage: Column, expected: Column) -> Column:
    return F.greatest(F.lit(0), stage - expected)


def signed_overshoot(stage: Column, expected: Column) -> Column:
    """The benchmark's form: signed, and -999 where there is no stage."""
    return F.when(stage.isNull() | (stage < 0), -999).otherwise(stage - expected)


def wasted_levels(history: DataFrame, expected: DataFrame) -> DataFrame:
    return history.join(expected, ["traj_id", "eq"]).groupBy("traj_id", "eq").agg(F.count_if(F.col("stage") > F.col("expected")).alias("wasted"), F.max(overshoot(F.col("stage"), F.col("expected"))).alias("overshoot"))


def stage_first_use(levels: DataFrame) -> DataFrame:
    """traj_id, stage, levels, first_use: levels (traj_id, level, stage, uses: the best structure has a current term)."""
    return levels.groupBy("traj_id", "stage").agg(F.count(F.lit(1)).alias("levels"), F.min(F.when(F.col("uses"), F.col("level"))).alias("first_use"))


def cost_totals(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], codes: str) -> DataFrame:
    """Sums of counters and the sorted union of return codes (a small set) by keys."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.concat_ws(",", F.array_sort(F.collect_set(codes))).alias(codes))


def level_snapshots(levels: DataFrame) -> DataFrame:
    """levels (traj_id, level, best) with accepted: is the level's best below all before it."""
    prev = F.min("best").over(Window.partitionBy("traj_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
    return levels.withColumn("accepted", prev.isNull() | (F.col("best") < prev))


def gp_generation(pop: DataFrame, n_terms: int, seed: int, level: int, elite: int = 1, k: int = 3, max_terms: int = 4) -> DataFrame:
    """traj_id, cand_id, structure, is_elite: the next generation of each series, as large as the last.

    The `elite` best survive. Every other place takes two tournament winners over k hashed draws, each equation from one
    of them, and one of three mutations: add (below 0.34), remove (below 0.67) or replace a term.
    """
    ranked = pop.withColumn("pos", F.row_number().over(Window.partitionBy("traj_id").orderBy("objective", "cand_id")) - 1)
    size = F.count(F.lit(1)).over(Window.partitionBy("traj_id"))
    slots = ranked.select("traj_id", F.col("pos").alias("slot"), size.alias("n"), F.col("structure").alias("own"))
    key = lambda *x: (F.lit(level), "traj_id", "slot", *[F.lit(y) for y in x])
    # positions are by rank, so the best of k draws is the least
    winner = lambda side: F.least(*[draw(F.col("n"), seed, *key(side, i)) for i in range(max(k, 2))]) if k > 1 else draw(F.col("n"), seed, *key(side, 0))
    new = slots.where(F.col("slot") >= elite).withColumns({"a": winner("a"), "b": winner("b")})
    par = ranked.select("traj_id", "pos", "structure")
    new = new.join(par.select("traj_id", F.col("pos").alias("a"), F.col("structure").alias("sa")), ["traj_id", "a"]).join(par.select("traj_id", F.col("pos").alias("b"), F.col("structure").alias("sb")), ["traj_id", "b"])
    mixed = F.zip_with("sa", "sb", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    crossed = F.transform(mixed, lambda z, e: F.when(draw(F.lit(2), seed, *key("cross"), e) == 0, z["x"]).otherwise(z["y"]))
    new = new.withColumn("s", crossed).withColumns({"eq": draw(F.size("s"), seed, *key("eq")), "op": uniform(seed, *key("op"))})
    own = F.element_at("s", F.col("eq") + 1)
    new = new.withColumn("free", F.array_except(F.sequence(F.lit(1), F.lit(n_terms)), own)).withColumn("new_term", pick(F.col("free"), seed, *key("term"))).withColumn("drop_term", pick(own, seed, *key("drop")))
    without = F.filter(own, lambda t: t != F.col("drop_term"))
    add = F.when((F.size(own) < max_terms) & F.col("new_term").isNotNull(), F.array_append(own, F.col("new_term"))).otherwise(own)
    swap = F.when(F.col("new_term").isNull(), own).otherwise(F.array_append(F.when(F.size(own) > 0, without).otherwise(own), F.col("new_term")))
    changed = F.when(F.col("op") < 0.34, add).when(F.col("op") < 0.67, F.when(F.size(own) > 1, without).otherwise(own)).otherwise(swap)
    new = new.withColumn("changed", F.array_sort(F.array_distinct(changed)))
    made = new.select("traj_id", F.col("slot").cast("long").alias("cand_id"), F.transform("s", lambda t, e: F.when(e == F.col("eq"), F.col("changed")).otherwise(t)).alias("structure"), F.lit(False).alias("is_elite"))
    return slots.where(F.col("slot") < elite).select("traj_id", F.col("slot").cast("long").alias("cand_id"), F.col("own").alias("structure"), F.lit(True).alias("is_elite")).unionByName(made)


def scored(cands: DataFrame, factors: DataFrame, p: int, dim: int, most: int | None = None, scoring: Scoring = Scoring()) -> DataFrame:
    """traj_id, cand_id, structure, n, n_params, residuals by equation, valid and loss (Infinity if an equation is invalid),
    with what they cost: fits, shared and reasons."""
    rows = R.screen_sets(cands, factors, p, dim, most=most, solver=scoring.solver)
    rows = rows.withColumn("valid", F.forall("reasons", lambda w: w == ""))
    loss = F.when(F.col("valid"), scoring.loss(F.col("residuals"), F.col("n_params"), F.col("n"))).otherwise(F.lit(INF))
    total = F.aggregate("n_params", F.lit(0), lambda a, x: a + x)
    return rows.select("traj_id", "cand_id", "structure", "n", total.alias("n_params"), "residuals", "valid", loss.cast("double").alias("loss"), "fits", "shared", "reasons")


def screened(kids: DataFrame, parents: DataFrame, policy: SearchPolicy) -> DataFrame:
    """The screen_k children (with parent_id) of each series that selection goes on with: those that pass the nested F gate
    against their parents first, then by screening score."""
    up = parents.select("traj_id", F.col("cand_id").alias("parent_id"), F.col("n_params").alias("p_parent"), F.col("loss").alias("r_parent"))
    pairs = kids.join(up, ["traj_id", "parent_id"]).withColumns({"p_child": F.col("n_params"), "r_child": F.col("loss")})
    rows = nested_f_gate(pairs, policy.gate_alpha).withColumns({"incumbent": F.lit(False), "score": score(F.col("loss"), F.col("n"), F.col("n_params"), F.col("valid"))})
    return select_topk(rows, policy.screen_k, gate=True).select(kids.columns)


#: What a series carries from level to level: stages and caps by equation; levels and last residuals of each equation's
#: stage; stage, levels and last objectives of the series as a whole.
STATE = ("stages", "caps", "in_stage", "recent", "stage", "stage_levels", "bests")


def _start(series: DataFrame, dim: int, top: int, stage_caps: DataFrame | None) -> DataFrame:
    """traj_id and the state before the first level."""
    each = lambda x: F.array(*[x] * dim)
    caps = each(F.lit(None).cast("int"))
    rows = series
    if stage_caps is not None:
        by_eq = stage_caps.groupBy("traj_id").agg(F.map_from_entries(F.collect_list(F.struct("eq", F.greatest(F.lit(1), F.least(F.col("cap"), F.lit(top))).alias("cap")))).alias("m"))  # dim entries
        rows = series.join(by_eq, "traj_id", "left")
        caps = F.when(F.col("m").isNull(), caps).otherwise(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda e: F.element_at("m", e)))
    none = F.array().cast("array<double>")
    return rows.select("traj_id", each(F.lit(1)).alias("stages"), caps.alias("caps"), each(F.lit(0)).alias("in_stage"), each(none).alias("recent"), F.lit(1).alias("stage"), F.lit(0).alias("stage_levels"), none.alias("bests"))


def _tail(values: Column, x: Column, n: int) -> Column:
    """The last n of values and x."""
    grown = F.array_append(values, x)
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - n + 1), F.lit(n))


def _by_equation(rows: DataFrame, level: int, policy: SearchPolicy, top: int) -> DataFrame:
    """rows (state, top_loss, top_residuals) with reason, promoted and the next state: every equation has its own stage."""
    x = F.zip_with("recent", "top_residuals", lambda v, r: _tail(v, r, policy.window))
    rows = rows.withColumns({"recent": x, "in_stage": F.transform("in_stage", lambda n: n + 1)})
    rows = rows.withColumn("flat", F.transform("recent", lambda v: (F.size(v) >= policy.window) & (F.array_max(v) - F.array_min(v) < policy.plateau_tol)))
    eqs = F.arrays_zip("stages", "caps", "in_stage", "flat", "top_residuals")
    done = F.forall(eqs, lambda e: (e["stages"] >= _limit(e["stages"], e["caps"], top)) & e["flat"])
    rows = rows.withColumn("reason", _ending(F.lit(level), F.col("top_loss"), done, policy))
    go = F.transform(eqs, lambda e: _may_promote(e["flat"], e["in_stage"], e["top_residuals"], e["stages"], e["caps"], policy, top) & F.col("reason").isin("min_levels", "continue"))
    return rows.withColumn("up", go).withColumns({
        "stages": F.zip_with("stages", "up", lambda s, u: s + u.cast("int")), "in_stage": F.zip_with("in_stage", "up", lambda n, u: F.when(u, 0).otherwise(n)),
        "recent": F.zip_with("recent", "up", lambda v, u: F.when(u, F.array().cast("array<double>")).otherwise(v)),
    })


def _by_series(rows: DataFrame, level: int, policy: SearchPolicy, top: int) -> DataFrame:
    """The same for stages of whole series: an equation's stage stays at its cap, and the last stage is the largest cap."""
    most = F.array_max(F.transform("caps", lambda c: F.coalesce(c, F.lit(top))))
    rows = rows.withColumns({"bests": _tail(F.col("bests"), F.col("best"), policy.window + 1), "stage_levels": F.col("stage_levels") + 1})
    old = F.when(F.size("bests") > policy.window, F.element_at("bests", 1))
    reason, action = _progress(F.lit(level), F.col("top_loss"), F.col("stage_levels"), F.col("best"), old, F.col("stage"), most, policy)
    rows = rows.withColumns({"reason": reason, "up": action == "promote", "ends": action == "stop"})
    stage = F.col("stage") + F.col("up").cast("int")
    return rows.withColumns({
        "reason": F.when(F.col("up"), "continue").otherwise(F.when(~F.col("ends") & (F.col("reason") == _why(policy)), "continue").otherwise(F.col("reason"))),
        "stages": F.transform("caps", lambda c: F.least(stage, F.coalesce(c, F.lit(top)))), "bests": F.when(F.col("up"), F.array().cast("array<double>")).otherwise(F.col("bests")),
        "stage_levels": F.when(F.col("up"), 0).otherwise(F.col("stage_levels")), "stage": stage, "up": F.transform("caps", lambda c: F.col("up")),
    })


def grow(
    factors: DataFrame, basis: Sequence[Term], dim: int, policy: SearchPolicy = SearchPolicy(), stage_caps: DataFrame | None = None, on_level: Callable[[DataFrame, int], None] | None = None, scoring: Scoring = Scoring()
) -> tuple[DataFrame, DataFrame]:
    """(best, log): the best structure of every series, and one row per series and level.

    A level is one job over all running series: expand their populations, score the children on the block factors, screen
    them, keep the best, decide. Every series carries its own state: each equation has its own stage (or, with progress
    "series", all share one) and unlocks the next when its residuals are flat, so a series' result doesn't depend on which
    others are there. What an equation may take follows from all stages of its series (open_terms). With stage_caps
    (traj_id, eq, cap) no equation unlocks stages above its cap; terms that are there are never removed. Series that stop
    leave the loop. A level reads the table of the one before, so lineage stays one level deep. on_level sees each level's
    population.
    best: traj_id, structure, loss, objective, n_params, stages, levels, reason. log: traj_id, level, stages (during the
    level), best, loss, residuals, promoted, reason, stop, and what the level cost (COUNTERS, codes; the first one with the
    initial population). The search reads one factor a series, which is made from the block factors, or from rows for them, before the first
    level.
    """
    if policy.progress not in ("equation", "series"):
        raise ValueError(f"unknown progress {policy.progress!r}")
    p, top = len(basis), max(t.stage for t in basis)
    decide = _by_equation if policy.progress == "equation" else _by_series
    allowed, own = open_terms(basis, policy.coherent), F.array(*[F.array(*[F.lit(t.idx) for t in basis if t.stage == s]).cast("array<int>") for s in range(1, top + 1)])
    # an equation's current terms are those of its own stage, unless they are all that it has
    current = F.zip_with("allowed", "stages", lambda a, s: F.when(F.size(F.array_except(a, F.element_at(own, s))) == 0, F.array().cast("array<int>")).otherwise(F.array_intersect(a, F.element_at(own, s))))
    columns = ("traj_id", "cand_id", "structure", "n_params", "loss", "residuals")
    made = {"valid": "boolean", "fits": "int", "shared": "int", "reasons": "array<string>"}
    ranked = Window.partitionBy("traj_id").orderBy("objective", "is_child", "cand_id")

    def ranks(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("objective", F.col("loss") + policy.penalty * F.col("n_params")).withColumn("rn", F.row_number().over(ranked))
        return rows.where(F.col("rn") <= policy.pop_size).drop("is_child")

    factors = cut(R.series_factors(factors, p, dim), "series-factors")
    state = cut(_start(factors.select("traj_id"), dim, top, stage_caps), "state")
    first = init_population(state.select("traj_id", allowed.alias("terms")), policy.pop_size, policy.seed)
    begun = cut(scored(first, factors, p, dim, policy.pop_size, scoring), "candidates")
    pop, spent = cut(ranks(begun.select(*columns, F.lit(0).alias("is_child"))), "population"), [costs(begun, "traj_id").withColumn("level", F.lit(1))]
    levels = []
    for level in range(1, policy.max_levels + 1):
        lists = state.withColumn("allowed", allowed).withColumn("current", current)
        kids = _children(pop.select("traj_id", "cand_id", "structure").join(lists, "traj_id"), policy, level, policy.growth)
        # ids: level, then place among the series' children
        number = F.lit(level * 1_000_000).cast("long") + F.row_number().over(Window.partitionBy("traj_id").orderBy("parent_id", "child"))
        kids = kids.select("traj_id", F.col("cand_id").alias("parent_id"), "child", F.col("grown").alias("structure")).withColumn("cand_id", number)
        new = scored(kids, factors, p, dim, policy.pop_size * policy.children, scoring)
        if policy.screen_k is not None:
            # what is screened out has its cost, too
            new = cut(new, "candidates")
            spent.append(costs(new, "traj_id").withColumn("level", F.lit(level)))
            new = screened(new.join(kids.select("traj_id", "cand_id", "parent_id"), ["traj_id", "cand_id"]), pop, policy)
        both = pop.select(*columns, F.lit(0).alias("is_child"), *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).unionByName(new.select(*columns, F.lit(1).alias("is_child"), *made))
        rows = ranks(both.withColumns({f"cost_{n}": c.over(Window.partitionBy("traj_id")) for n, c in _counted().items()})).withColumn("t", F.first(F.struct("objective", "loss", "residuals")).over(Window.partitionBy("traj_id").orderBy("rn")))
        rows = rows.withColumns({"best": F.col("t.objective"), "top_loss": F.col("t.loss"), "top_residuals": F.col("t.residuals")}).join(state.withColumn("during", F.col("stages")), "traj_id")
        rows = decide(rows, level, policy, top).withColumn("stop", ~F.col("reason").isin("min_levels", "continue", "stage_budget", "insufficient_history"))
        promoted = F.filter(F.sequence(F.lit(1), F.size("up")), lambda e: F.element_at("up", e))
        pop = cut(rows.select(*columns, "objective", "rn", *STATE, "during", "best", "top_loss", "top_residuals", promoted.alias("promoted"), "reason", "stop", *[f"cost_{c}" for c in COUNTERS], _union(F.col("cost_codes")).alias("cost_codes")), "population")
        levels.append(pop.where("rn = 1").withColumn("level", F.lit(level)))
        if on_level:
            on_level(pop, level)
        pop = pop.where("not stop")
        state = pop.where("rn = 1").select("traj_id", *STATE)
        if level == policy.max_levels or state.isEmpty():
            break
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    if policy.screen_k is None:
        spent.append(whole.select("traj_id", *[F.col(f"cost_{c}").alias(c) for c in (*COUNTERS, "codes")], "level"))
    log = whole.select("traj_id", "level", F.col("during").alias("stages"), "best", F.col("top_loss").alias("loss"), F.col("top_residuals").alias("residuals"), "promoted", "reason", "stop").join(_by_level(spent), ["traj_id", "level"])
    return whole.where("stop").select("traj_id", "structure", "loss", "objective", "n_params", F.col("during").alias("stages"), F.col("level").alias("levels"), "reason"), log


def _by_level(spent: Sequence[DataFrame]) -> DataFrame:
    """traj_id, level, COUNTERS and codes of the parts of a search."""
    every = spent[0]
    for x in spent[1:]:
        every = every.unionByName(x)
    return every.groupBy("traj_id", "level").agg(*[F.sum(c).alias(c) for c in COUNTERS], _union(F.collect_list("codes")).alias("codes"))


def gp_search(factors: DataFrame, basis: Sequence[Term], dim: int, policy: SearchPolicy = SearchPolicy(), elite: int = 1, k: int = 3, scoring: Scoring = Scoring(), on_level: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(best, log) of the evolutionary baseline: max_levels generations over the full library, or until should_stop.

    Each generation adds its own table; deciding whether to stop reads those of the last window. best and log have grow's
    columns, without stages and promotions.
    """
    p, ids = len(basis), [t.idx for t in basis]
    every = F.array(*[F.array(*[F.lit(i) for i in ids]) for _ in range(dim)])
    factors = cut(R.series_factors(factors, p, dim), "series-factors")

    def with_objective(rows: DataFrame) -> DataFrame:
        return cut(scored(rows, factors, p, dim, policy.pop_size, scoring).withColumn("objective", F.col("loss") + policy.penalty * F.col("n_params")), "population")

    pop = with_objective(init_population(factors.select("traj_id", every.alias("terms")), policy.pop_size, policy.seed))
    logs, done, spent = [], None, [costs(pop, "traj_id").withColumn("level", F.lit(1))]
    for level in range(1, policy.max_levels + 1):
        pop = with_objective(gp_generation(pop.select("traj_id", "cand_id", "structure", "objective"), p, policy.seed, level, elite, k, policy.max_terms).drop("is_elite"))
        spent.append(costs(pop, "traj_id").withColumn("level", F.lit(level)))
        top = pop.groupBy("traj_id").agg(F.min(F.struct("objective", "cand_id", "structure", "loss", "n_params", "residuals")).alias("b"))
        logs.append(cut(top.select("traj_id", F.lit(level).alias("level"), F.col("b.objective").alias("best"), F.col("b.loss").alias("loss"), F.col("b.residuals").alias("residuals"), F.col("b.structure").alias("structure"), F.col("b.n_params").alias("n_params")), "generation"))
        if on_level:
            on_level(pop, level)
        recent = logs[-1]
        for x in logs[-1 - policy.window : -1]:
            recent = recent.unionByName(x)
        now = cut(should_stop(recent, policy).where(F.col("level") == level), "decision")
        gone = now.where("stop").select("traj_id", "structure", "loss", F.col("best").alias("objective"), "n_params", F.col("level").alias("levels"), "reason")
        done = gone if done is None else done.unionByName(gone)
        on = now.where("not stop").select("traj_id")
        if level == policy.max_levels or on.isEmpty():
            break
        pop = pop.join(on, "traj_id", "left_semi")
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    return done, log.drop("structure", "n_params").join(_by_level(spent), ["traj_id", "level"])
