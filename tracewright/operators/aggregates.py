"""Aggregations of run registries, hypothesis checks and distributions. All are partial-then-final hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derivatives import joined
from .quantiles import exact_quantiles

INF = float("inf")


def valid_run() -> Column:
    return F.col("loss").isNotNull() & ~F.isnan("loss")


def as_bool(c: Column) -> Column:
    """Text or number to boolean; anything else null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes"), True).when(t.isin("false", "0", "0.0", "no"), False)


def aggregate_runs(runs: DataFrame, by_ic: bool = False) -> DataFrame:
    """Runs by variant and system (and initial condition set). Means are over valid runs; null keys stay groups.

    A final stage of -1 means none: the mean skips it and is null only if no run has one. Standard deviations need two
    valid runs.
    """
    keys = ["variant_slug", "system_id", *(["initial_condition_set"] if by_ic else [])]
    ok = valid_run()
    mean = lambda c: F.avg(F.when(ok, c))
    match = as_bool(F.col("exact_support_match"))
    stage = F.when(F.col("final_stage") >= 0, F.col("final_stage"))
    return runs.groupBy(*keys).agg(
        F.min("system_name").alias("system_name"), F.count(F.lit(1)).alias("n_seeds"), F.count_if(ok).alias("n_valid"), mean(F.col("loss")).alias("mean_loss"),
        F.stddev_samp(F.when(ok, F.col("loss"))).alias("std_loss"), mean(match.cast("double")).alias("exact_match_rate"), mean(stage).alias("mean_final_stage"), mean(F.col("stage_overshoot")).alias("mean_stage_overshoot"),
        mean(F.col("wasted_levels")).alias("mean_wasted_levels"), mean(F.col("elapsed_s")).alias("mean_elapsed_s"), mean(F.col("total_invalid_evals")).alias("mean_invalid_evals"),
        mean(F.col("r2")).alias("mean_r2"), F.count(F.when(ok, F.col("r2"))).alias("n_r2"),
    )


def aggregate_benchmark(runs: DataFrame, line: str) -> DataFrame:
    """By variant and system, with the descriptive columns of the first row in line order."""
    return runs.groupBy("variant_slug", "system_id").agg(
        F.min_by("system_name", line).alias("system_name"), F.min_by("expected_stage", line).alias("expected_stage"), F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"), F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"),
    )


def recovery_label(match: Column, loss: Column, overlap: Column, good: float = 1e-3, fair: float = 1e-1) -> Column:
    """exact_recovery, surrogate_fit, meaningful_surrogate or weak_surrogate."""
    return F.when(F.coalesce(match, F.lit(False)), "exact_recovery").when(loss <= good, "surrogate_fit").when((loss <= fair) & overlap, "meaningful_surrogate").otherwise("weak_surrogate")


def diagnose_support(rows: DataFrame) -> DataFrame:
    """rows (run_id, raw, pruned: booleans) with diagnosis."""
    return rows.withColumn("diagnosis", F.when(F.col("raw") & F.col("pruned"), "correct").when(~F.col("raw") & F.col("pruned"), "metric_artifact").when(~F.col("raw") & ~F.col("pruned"), "genuine_failure").otherwise("unexpected"))


def diagnosis_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("diagnosis") == d).alias(d) for d in ("correct", "metric_artifact", "genuine_failure", "unexpected")])


def _wide(agg: DataFrame, metric: str, names: dict[str, str], systems: Sequence[int] | None = None) -> DataFrame:
    """system_id and one column per role: the metric of its variant, by one conditional aggregate."""
    rows = agg.where(F.col("system_id").isin(list(systems))) if systems else agg
    return rows.groupBy("system_id").agg(*[F.max(F.when(F.col("variant_slug") == v, F.col(metric))).alias(k) for k, v in names.items()])


def compare(a: Column, b: Column, rel: float = 1e-12) -> Column:
    """lower, equal (within a relative tolerance) or higher; null if either is null."""
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(rel))
    return F.when(a.isNull() | b.isNull(), None).when(near, "equal").when(a < b, "lower").otherwise("higher")


def _direction(ok1: Column, ok2: Column) -> Column:
    return F.when(ok1 & ok2, "correct").when(ok1 | ok2, "partial").otherwise("wrong")


def hypothesis_h1(agg: DataFrame, new: str, old: str, oldest: str) -> DataFrame:
    """Per system: is the new variant's overshoot lower than both others'."""
    w = _wide(agg, "mean_stage_overshoot", {"new": new, "old": old, "oldest": oldest})
    low = lambda c: F.coalesce(compare(F.col("new"), F.col(c)) == "lower", F.lit(False))
    return w.select("system_id", _direction(low("old"), low("oldest")).alias("direction"))


def hypothesis_h2(agg: DataFrame, new: str, baseline: str, variants: Sequence[str]) -> DataFrame:
    """Per system: competitive with the baseline on match rate, or on the best loss where every rate is 0."""
    a = agg.where(F.col("variant_slug").isin(list(variants)))
    ours = F.col("variant_slug") != baseline
    g = a.groupBy("system_id").agg(
        F.bool_and(F.coalesce(F.col("exact_match_rate") == 0, F.lit(False))).alias("collapsed"), F.min(F.when(ours, F.col("mean_loss"))).alias("best_loss"), F.min_by("variant_slug", F.when(ours, F.col("mean_loss"))).alias("best_variant"),
        F.max(F.when(~ours, F.col("mean_loss"))).alias("base_loss"), F.max(F.when(~ours, F.col("exact_match_rate"))).alias("base_rate"), F.max(F.when(F.col("variant_slug") == new, F.col("exact_match_rate"))).alias("new_rate"),
    )
    ok = F.when(F.col("collapsed"), F.col("best_loss") <= F.col("base_loss")).otherwise(F.col("new_rate") >= F.col("base_rate"))
    return g.select("system_id", "collapsed", F.when(F.col("collapsed"), F.col("best_variant")).alias("best_variant"), F.coalesce(ok, F.lit(False)).alias("competitive"))


def hypothesis_h3(agg: DataFrame, new: str, old: str, oldest: str) -> DataFrame:
    """Per system: are the new variant's wasted levels lower than or equal to both others', and is there a tie."""
    w = _wide(agg, "mean_wasted_levels", {"new": new, "old": old, "oldest": oldest})
    c = lambda x: compare(F.col("new"), F.col(x))
    ok = lambda x: F.coalesce(c(x).isin("lower", "equal"), F.lit(False))
    return w.select("system_id", _direction(ok("old"), ok("oldest")).alias("direction"), (F.coalesce(c("old") == "equal", F.lit(False)) | F.coalesce(c("oldest") == "equal", F.lit(False))).alias("tie"))


def hypothesis_h4(agg: DataFrame, hard: str, soft: str, passive: str) -> DataFrame:
    """Per system: hard >= soft >= passive, or the reverse with a strict difference, and whether all three are 0."""
    w = _wide(agg, "exact_match_rate", {"h": hard, "s": soft, "p": passive})
    h, s, p = F.col("h"), F.col("s"), F.col("p")
    no = F.lit(False)
    return w.select("system_id", F.coalesce((h >= s) & (s >= p), no).alias("expected_order"), F.coalesce((p >= s) & (s >= h) & (p > h), no).alias("reverse_order"), F.coalesce((h == 0) & (s == 0) & (p == 0), no).alias("all_zero"))


def verdicts(h1: DataFrame, h2: DataFrame, h3: DataFrame, h4: DataFrame) -> DataFrame:
    """hypothesis, n, verdict: one row each."""
    steps = lambda n, a, b: F.when(n >= a, "SUPPORTED").when(n >= b, "PARTIAL").otherwise("FALSIFIED")
    correct = F.count_if(F.col("direction") == "correct")
    one = h1.agg(correct.alias("n")).select(F.lit("H1").alias("hypothesis"), "n", steps(F.col("n"), 4, 1).alias("verdict"))
    two = h2.agg(F.count_if("competitive").alias("n")).select(F.lit("H2").alias("hypothesis"), "n", steps(F.col("n"), 5, 2).alias("verdict"))
    three = h3.agg(correct.alias("n")).select(F.lit("H3").alias("hypothesis"), "n", steps(F.col("n"), 4, 1).alias("verdict"))
    g = h4.agg(F.count_if("expected_order").alias("n"), F.count_if("reverse_order").alias("rev"), F.bool_and("all_zero").alias("z"))
    four = g.select(F.lit("H4").alias("hypothesis"), "n", F.when(F.col("z"), "VACUOUS").when(F.col("n") >= 3, "SUPPORTED").when(F.col("rev") >= 3, "FALSIFIED").otherwise("AMBIGUOUS").alias("verdict"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def generalization_verdict(cells: DataFrame, least: int = 3) -> DataFrame:
    """Over cells (n_exact_runs, mean_refit_loss, mean_fresh_loss) with enough exact runs: refits at least as good in half?"""
    g = cells.where(F.col("n_exact_runs") >= least).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("mean_refit_loss") <= F.col("mean_fresh_loss")).alias("refit_better"))
    v = F.when(F.col("eligible") == 0, "OMIT").when(F.col("refit_better") >= F.ceil(F.col("eligible") / 2), "INCLUDE_SUPPLEMENTARY").otherwise("INCLUDE_WITH_CAUTION")
    return g.select("eligible", "refit_better", v.alias("verdict"))


def generalization_summary(runs: DataFrame) -> DataFrame:
    """By system, variant and seed: refit mean, minimum and maximum, fresh mean, and refits under ten times the training loss."""
    ok = F.col("refit_loss").isNotNull() & F.col("train_loss").isNotNull()
    return runs.groupBy("system_id", "variant_slug", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.avg("refit_loss").alias("mean_refit_loss"), F.min("refit_loss").alias("min_refit_loss"), F.max("refit_loss").alias("max_refit_loss"), F.avg("fresh_loss").alias("mean_fresh_loss"),
        F.count_if(ok & (F.col("refit_loss") < 10 * F.col("train_loss"))).alias("refit_success"),
    )


def distribution(df: DataFrame, col: str, keys: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    """n, min, q25, median, mean, q75, max with linear interpolation, over finite values.

    hot: groups of more rows are ranked in passes (quantiles.exact_quantiles) instead of in one task."""
    d = df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < INF))
    if hot is not None:
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))
        j = joined(g, exact_quantiles(d, col, (0.25, 0.5, 0.75), keys, "cont", hot).drop("n"), keys)
        return j.select(*keys, "n", "min", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("q25", "median"))], "mean", F.get("q", F.lit(2)).alias("q75"), "max")
    q = lambda p: F.percentile(col, F.lit(p))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), F.avg(col).alias("mean"), q(0.75).alias("q75"), F.max(col).alias("max"))


def quantiles_nearest(df: DataFrame, col: str, keys: Sequence[str] = (), ps: Sequence[float] = (0.5, 0.9, 0.99), hot: int | None = None) -> DataFrame:
    """Nearest-rank quantiles p50, p90, ... hot: as in distribution, over finite values."""
    if hot is not None:
        return exact_quantiles(df, col, ps, keys, "disc", hot).select(*keys, *[F.get("q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(ps)])
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").alias(f"p{round(100 * p)}") for p in ps])


def suspicious_cells(runs: DataFrame, exact: Column, least: float = 0.99) -> DataFrame:
    """Exact cells whose R2 is missing or too small."""
    return runs.where(exact & (F.col("r2").isNull() | F.isnan("r2") | (F.col("r2") < least)))


def breakdowns(cells: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """split, value, n_cells and finite means for each single column of `by`, in one pass over grouping sets."""
    grouped = cells.groupingSets([[c] for c in by], *by).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_cells"), *[F.avg(F.when(F.abs(m) < INF, F.col(m))).alias(f"mean_{m}") for m in metrics])
    n = len(by)
    full = (1 << n) - 1
    split, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        only = F.col("gid") == full ^ (1 << (n - 1 - i))
        split, value = F.when(only, c).otherwise(split), F.when(only, F.col(c).cast("string")).otherwise(value)
    return grouped.select(split.alias("split"), value.alias("value"), "n_cells", *[f"mean_{m}" for m in metrics])


def level_costs(levels: DataFrame, keys: Sequence[str], hot: int | None = None) -> DataFrame:
    """Cost per key after the first level (a warm-up): n, mean, median, sum and share of the total. hot: as in distribution."""
    sums = [F.count(F.lit(1)).alias("n"), F.avg("cost").alias("mean_cost"), F.sum("cost").alias("total_cost"), F.sum("solves").alias("solves")]
    if hot is None:
        g = levels.where("level > 1").groupBy(*keys).agg(*sums, F.percentile("cost", F.lit(0.5)).alias("median_cost"))
    else:
        middle = exact_quantiles(levels.where("level > 1"), "cost", (0.5,), keys, "cont", hot).select(*keys, F.get("q", F.lit(0)).alias("median_cost"))
        g = joined(levels.where("level > 1").groupBy(*keys).agg(*sums), middle, keys)
    total = levels.where("level > 1").agg(F.sum("cost").alias("__t"))  # one row
    return g.crossJoin(F.broadcast(total)).select(*keys, "n", "mean_cost", "median_cost", "total_cost", (F.col("total_cost") / F.col("__t")).alias("share"), F.when(F.col("solves") > 0, 1000 * F.col("total_cost") / F.col("solves")).alias("ms_per_solve"))


def compare_variants(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Per system and seed set: runtime ratio a / b and equal support of the two variants."""
    side = lambda v, x: runs.where(F.col("variant_slug") == v).groupBy("system_id").agg(F.sum("elapsed_s").alias(f"t{x}"), F.array_sort(F.collect_set("final_stage")).alias(f"s{x}"))
    return side(a, "a").join(side(b, "b"), "system_id").select("system_id", F.when(F.col("tb") > 0, F.col("ta") / F.col("tb")).alias("runtime_ratio"), (F.col("sa") == F.col("sb")).alias("same_support"))


def same_pruned_support(terms: DataFrame, a: str, b: str, cell: Sequence[str] = ("system_id", "seed"), relative: float = 1e-3, absolute: float = 1e-6) -> DataFrame:
    """system_id, cells, same_cells, same_support: do two variants find the same supports, cell by cell, once small terms are
    pruned? terms: variant_slug, cell, eq, term, coef.

    Cells that both variants have are compared; equal means the same terms in each equation. same_support: in all of them.
    """
    from .terms import prune

    kept = prune(terms.where(F.col("variant_slug").isin(a, b)), ["variant_slug", *cell, "eq"], absolute, relative)
    per = kept.groupBy("variant_slug", *cell).agg(F.array_sort(F.collect_set(F.struct("eq", "term"))).alias("s"))  # a structure is small
    side = lambda v, x: per.where(F.col("variant_slug") == v).select(*cell, F.col("s").alias(x))
    j = side(a, "sa").join(side(b, "sb"), list(cell)).withColumn("same", F.col("sa") == F.col("sb"))
    return j.groupBy("system_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("same").alias("same_cells"), F.bool_and("same").alias("same_support"))
