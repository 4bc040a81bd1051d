"""Windows over level histories and evaluation logs. Levels: cell, level, best_loss, us (event time in microseconds).

All windows share the partitioning by cell (or fit_id), so chained steps need one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .derivatives import joined

INF = float("inf")
SENTINEL = 1e6


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def marked(levels: DataFrame) -> DataFrame:
    """Levels with prev (best before), improved, silent (levels since the last improvement, this one included if silent)."""
    w = Window.partitionBy("cell").orderBy("level")
    prev = F.min("best_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = levels.withColumn("prev", prev).withColumn("improved", F.col("prev").isNull() | (F.col("best_loss") < F.col("prev")))
    m = m.withColumn("island", F.sum(F.col("improved").cast("int")).over(w))
    inside = Window.partitionBy("cell", "island").orderBy("level")
    return m.withColumn("silent", (F.row_number().over(inside) - 1).cast("int"))


def improvements(levels: DataFrame) -> DataFrame:
    """One row per strict improvement after the first level: drops and the silent levels before it."""
    m = marked(levels)
    w = Window.partitionBy("cell").orderBy("level")
    m = m.withColumn("silent_before", F.lag("silent").over(w)).where(F.col("improved") & F.col("prev").isNotNull())
    drop = F.col("prev") - F.col("best_loss")
    return m.select("cell", "level", "stage", F.col("prev").alias("old_best"), F.col("best_loss").alias("new_best"), drop.alias("abs_drop"), F.when(F.col("prev") != 0, drop / F.abs("prev")).alias("rel_drop"), "silent_before")


def tail_metrics(levels: DataFrame, part: float = 0.001) -> DataFrame:
    """Per cell: last improvement, last improvement of at least a part of the previous best, longest pause before one."""
    m = marked(levels).withColumn("silent_before", F.lag("silent").over(Window.partitionBy("cell").orderBy("level")))
    big = F.col("prev").isNull() | ((F.col("prev") != 0) & ((F.col("prev") - F.col("best_loss")) / F.abs("prev") >= part))
    real = F.col("improved") & F.col("prev").isNotNull()
    return m.groupBy("cell").agg(
        F.max("level").alias("total_levels"), F.max(F.when(F.col("improved"), F.col("level"))).alias("last_improvement"),
        F.max(F.when(F.col("improved") & big, F.col("level"))).alias("last_promille"), F.coalesce(F.max(F.when(real, F.col("silent_before"))), F.lit(0)).alias("longest_pause"),
    )


def silent_tail(levels: DataFrame) -> DataFrame:
    """Levels and seconds after the last improvement, and their share of the cell's time (null for no time)."""
    m = marked(levels).groupBy("cell").agg(
        F.max("level").alias("total_levels"), F.max(F.when(F.col("improved"), F.col("level"))).alias("last"), F.max(F.when(F.col("improved"), F.struct("level", "us"))).alias("at"),
        F.min(F.struct("level", "us")).alias("first"), F.max(F.struct("level", "us")).alias("end"),
    )
    tail = F.greatest((F.col("end.us") - F.col("at.us")) / 1e6, F.lit(0.0))
    total = F.greatest((F.col("end.us") - F.col("first.us")) / 1e6, F.lit(0.0))
    return m.select("cell", "total_levels", (F.col("total_levels") - F.col("last")).alias("silent_tail_levels"), tail.alias("silent_tail_s"), total.alias("total_s"), F.when(total > 0, tail / total).alias("silent_tail_share"))


def early_stop_replay(levels: DataFrame, ks: Sequence[int] = (3, 5, 8)) -> DataFrame:
    """Per cell and k: where a stop after k silent levels falls, what it saves and whether an improvement is missed."""
    m = marked(levels).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    first = F.min(F.when(F.col("silent") >= F.col("k"), F.struct("level", "us"))).over(Window.partitionBy("cell", "k"))
    m = m.withColumn("stop", first)
    g = m.groupBy("cell", "k").agg(
        F.first("stop").alias("stop"), F.max(F.struct("level", "us")).alias("end"), F.count_if(F.col("improved") & (F.col("level") > F.col("stop.level"))).alias("n_missed")
    )
    at = F.coalesce("stop", "end")
    return g.select("cell", "k", at["level"].alias("abort_level"), (F.col("end.level") - at["level"]).alias("saved_levels"), ((F.col("end.us") - at["us"]) / 1e6).alias("saved_s"), (F.col("n_missed") > 0).alias("missed"), "n_missed")


def savings_summary(replay: DataFrame) -> DataFrame:
    return replay.groupBy("k").agg(F.sum("saved_levels").alias("saved_levels"), F.sum("saved_s").alias("saved_s"), F.count_if("missed").alias("missed_cells"))


def source_coverage(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per source: heartbeat files, records read and missing, malformed lines. files: source, cell, malformed; records: cell."""
    j = files.join(records.select("cell", F.lit(True).alias("has")).distinct(), "cell", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count("has").alias("records_read"), F.count_if(F.col("has").isNull()).alias("records_missing"), F.sum("malformed").alias("malformed"))


def cell_identity(levels: DataFrame, records: DataFrame) -> DataFrame:
    """cell, variant, pretune: the record's values, else those of the cell's first level row; the pretune label from the
    record's condition, its flag or the variant's text."""
    first = levels.groupBy("cell").agg(F.min_by(F.struct("variant", "pretune"), "level").alias("f"))
    j = first.join(records.select("cell", F.col("variant").alias("rv"), "condition", "flag"), "cell", "left")
    variant = F.coalesce("rv", "f.variant")
    label = F.when(F.col("condition").isNotNull(), F.col("condition")).when(F.col("flag"), "on").when(~F.col("flag"), "off").when(variant.like("%nopretune%"), "off").when(variant.like("%pretune%"), "on").otherwise(F.col("f.pretune"))
    return j.select("cell", variant.alias("variant"), label.alias("pretune"))


def budget_replay(evals: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Per fit and budget: the best finite loss within the budget against the final one. evals: fit_id, i, loss."""
    e = evals.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    g = e.groupBy("fit_id", "budget").agg(F.count(F.lit(1)).alias("total"), F.min(F.when(finite("loss"), F.col("loss"))).alias("final"), F.min(F.when(finite("loss") & (F.col("i") <= F.col("budget")), F.col("loss"))).alias("upto"))
    stop = F.col("total") > F.col("budget")
    final = F.coalesce("final", F.lit(INF))
    replay = F.when(stop, F.coalesce("upto", F.lit(INF))).otherwise(final)
    factor = F.when((final < INF) & (final > 0), replay / final).otherwise(F.lit(INF))
    return g.select("fit_id", "budget", "total", stop.alias("would_stop"), final.alias("final_loss"), replay.alias("replay_loss"), factor.alias("factor"), (replay == final).alias("identical"))


def evaluation_summary(evals: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    """Per fit: counts, distinct losses, runs of sentinel losses (count, longest, nearest-rank p50 and p90)."""
    w = Window.partitionBy("fit_id").orderBy("i")
    s = finite("loss") & (F.col("loss") >= sentinel)
    e = evals.withColumn("s", s).withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("fit_id", "s").orderBy("i")))
    runs = e.where("s").groupBy("fit_id", "island").agg(F.count(F.lit(1)).alias("len"))
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY len)")
    runs = runs.groupBy("fit_id").agg(F.count(F.lit(1)).alias("sentinel_runs"), F.max("len").alias("longest_run"), p(0.5).cast("long").alias("run_p50"), p(0.9).cast("long").alias("run_p90"))
    all_ = e.groupBy("fit_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("s").alias("sentinels"), F.count_if(finite("loss") & ~F.col("s")).alias("finite_losses"), F.count_if(~finite("loss")).alias("nonfinite"), F.countDistinct("loss").alias("distinct_losses"),
    )
    return all_.join(runs, "fit_id", "left").fillna(0, ["sentinel_runs", "longest_run"])


def ends_of_log(evals: DataFrame, k: int = 10) -> DataFrame:
    """fit_id, pos, loss_first, loss_last: the first and last k losses by position."""
    up = F.row_number().over(Window.partitionBy("fit_id").orderBy("i"))
    dn = F.row_number().over(Window.partitionBy("fit_id").orderBy(F.col("i").desc()))
    e = evals.select("fit_id", "loss", up.alias("a"), dn.alias("b")).where((F.col("a") <= k) | (F.col("b") <= k))
    one = e.where(F.col("a") <= k).select("fit_id", F.col("a").alias("pos"), F.col("loss").alias("loss_first"))
    two = e.where(F.col("b") <= k).select("fit_id", F.col("b").alias("pos"), F.col("loss").alias("loss_last"))
    return one.join(two, ["fit_id", "pos"], "full")


def budget_curve(evals: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Per fit: best finite loss, the first index that reaches it and its place in the log, and loss and factor by budget."""
    best = F.min(F.when(finite("loss"), F.col("loss"))).over(Window.partitionBy("fit_id"))
    e = evals.withColumn("best", best)
    upto = [F.coalesce(F.min(F.when(finite("loss") & (F.col("i") <= b), F.col("loss"))), F.lit(INF)).alias(f"loss_{b}") for b in budgets]
    g = e.groupBy("fit_id").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best_loss"), F.min(F.when(F.col("loss") == F.col("best"), F.col("i"))).alias("first_index"), *upto)
    ok = (F.col("best_loss") > 0) & F.col("best_loss").isNotNull()
    return g.select("fit_id", F.coalesce("best_loss", F.lit(INF)).alias("best_loss"), "first_index", (F.col("first_index") / F.col("n")).alias("first_fraction"), *[f"loss_{b}" for b in budgets], *[F.when(ok, F.col(f"loss_{b}") / F.col("best_loss")).otherwise(F.lit(INF)).alias(f"factor_{b}") for b in budgets])


def stuck_cells(levels: DataFrame, now_us: Column, finished: DataFrame, stuck_s: int = 7200, active_s: int = 5400) -> DataFrame:
    """Cells that run without an event for over stuck_s, and those active within active_s, as of now."""
    g = levels.groupBy("cell").agg(F.max("us").alias("last_us")).join(finished.select("cell").distinct(), "cell", "left_anti")
    age = (now_us - F.col("last_us")) / 1e6
    return g.select("cell", age.alias("age_s"), (age > stuck_s).alias("stuck"), (age <= active_s).alias("active"))


def _latest(rows: DataFrame, order: Column, last: int) -> DataFrame:
    """The `last` rows of each group by order; the limit is applied before the shuffle and after it."""
    rn = F.row_number().over(Window.partitionBy("grp").orderBy(order.desc()))
    return rows.withColumn("rn", rn).where(F.col("rn") <= last).drop("rn")


def progress_eta(finishes: DataFrame, total: int, last: int = 20) -> DataFrame:
    """group, done, remaining, mean gap of the last finishes and the seconds left; null with fewer than two finishes.

    finishes: grp, us, id. Counts are combined before the shuffle, and of the ranking every task passes on `last` rows a
    group only, so a group of very many finishes is no task's work.
    """
    done = finishes.groupBy("grp").agg(F.count(F.lit(1)).alias("done"))
    g = _latest(finishes.select("grp", "us", "id"), F.struct("us", "id"), last).groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.max("us").alias("hi"), F.min("us").alias("lo"))
    g = joined(g, done, ["grp"])
    gap = F.when(F.col("m") >= 2, (F.col("hi") - F.col("lo")) / 1e6 / (F.col("m") - 1))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return g.select("grp", "done", left.alias("remaining"), gap.alias("mean_gap_s"), (gap * left).alias("eta_s"))


def progress_eta_flat(runs: DataFrame, total: int, last: int = 20) -> DataFrame:
    """The same from finished rows alone (grp, id, elapsed_s): the mean time of the last rows stands for the gap."""
    done = runs.groupBy("grp").agg(F.count(F.lit(1)).alias("done"))
    g = joined(_latest(runs.select("grp", "id", "elapsed_s"), F.col("id"), last).groupBy("grp").agg(F.avg("elapsed_s").alias("mean_s")), done, ["grp"])
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return g.select("grp", "done", left.alias("remaining"), "mean_s", (F.col("mean_s") * left).alias("eta_s"))
