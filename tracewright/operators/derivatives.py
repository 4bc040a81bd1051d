"""Trajectories and derivative estimates with their errors. A trajectory: traj_id, seq (from 1), t, and state columns.

Every window is partitioned by trajectory, so the only shuffle is one by traj_id, shared by the steps of a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

HALF, DEGREE = 4, 3


def by_seq(by: Sequence[str] = ("traj_id",)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("seq")


def whole(by: Sequence[str] = ("traj_id",)) -> WindowSpec:
    return Window.partitionBy(*by)


def whole_in_order(by: Sequence[str] = ("traj_id",)) -> WindowSpec:
    """The whole series in the order of by_seq, so that both share one sort; without an order Spark sorts by series first, then
    anew by row, and holds both."""
    return by_seq(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def to_trajectories(df: DataFrame, id_col: str, ts: str, cols: Sequence[str], tie: Sequence[str] = (), unit_us: float = 1e6) -> DataFrame:
    """Rows of any table in time order: seq, t (elapsed, in units of unit_us microseconds) and the columns."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(id_col)
    return df.select(
        F.col(id_col).alias("traj_id"), F.row_number().over(w.orderBy(ts, *tie)).alias("seq"), ((us - F.min(us).over(w)) / unit_us).alias("t"), *[F.col(c).cast("double").alias(c) for c in cols]
    )


def to_long(traj: DataFrame, cols: Sequence[str]) -> DataFrame:
    """traj_id, seq, t, eq, value: one row per state column."""
    return traj.select("traj_id", "seq", "t", F.posexplode(F.array(*cols)).alias("p", "value")).withColumn("eq", F.col("p") + 1).drop("p")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _at(c: str, k: int, w: WindowSpec) -> Column:
    """The value k rows further on."""
    return F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k else F.col(c)


def central(col: str, w: WindowSpec | None = None, stride: int = 1) -> Column:
    """Central difference inside, one-sided at the ends; one point alone gives 0. stride: rows between neighbours."""
    x, t, w = F.col(col), F.col("t"), w or by_seq()
    up, dn = F.coalesce(_at(col, stride, w), x), F.coalesce(_at(col, -stride, w), x)
    return _ratio(up - dn, F.coalesce(_at("t", stride, w), t) - F.coalesce(_at("t", -stride, w), t))


def fd4(col: str, place: Column, n: Column, h: Column, w: WindowSpec, stride: int = 1) -> Column:
    """Fourth-order difference on the mean step h; second and first order at the edges; under 5 points: central.

    place: number (from 1) among the n points of the series."""
    at = lambda k: _at(col, k * stride, w)
    d = F.when(n < 5, central(col, w, stride)).when(place == 1, (at(1) - at(0)) / h).when(place == n, (at(0) - at(-1)) / h)
    return d.when((place == 2) | (place == n - 1), (at(1) - at(-1)) / (h * 2)).otherwise((at(-2) - at(-1) * 8 + at(1) * 8 - at(2)) / (h * 12))


def deriv_central(traj: DataFrame, cols: Sequence[str], by: Sequence[str] = ("traj_id",)) -> DataFrame:
    return traj.select("*", *[central(c, by_seq(by)).alias(f"d_{c}") for c in cols])


def deriv_fd4(traj: DataFrame, cols: Sequence[str], by: Sequence[str] = ("traj_id",)) -> DataFrame:
    over = whole_in_order(by)
    n = F.count(F.lit(1)).over(over)
    h = F.when(n > 1, (F.max("t").over(over) - F.min("t").over(over)) / (n - 1))
    base = traj.select("*", n.alias("__n"), h.alias("__h"))
    return base.select(*traj.columns, *[fd4(c, F.col("seq"), F.col("__n"), F.col("__h"), by_seq(by)).alias(f"d_{c}") for c in cols])


def _slopes(t: np.ndarray, times, values) -> np.ndarray:
    """Slope at t of a cubic through each window's points (lower degree with fewer points); null windows give nan."""
    n = np.array([0 if x is None else len(x) for x in times], dtype=int)
    res = np.full((len(t), len(values)), np.nan)
    for m in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == m)
        x = np.stack([np.asarray(times[i]) for i in rows]) - t[rows, None]
        scale = np.abs(x).max(axis=1, keepdims=True)
        scale[scale == 0] = 1
        v = (x / scale)[..., None] ** np.arange(min(DEGREE, m - 1) + 1)
        inv = np.linalg.pinv(v)
        for j, u in enumerate(values):
            res[rows, j] = np.einsum("nm,nm->n", inv[:, 1], np.stack([np.asarray(u[i]) for i in rows])) / scale[:, 0] if v.shape[2] > 1 else 0.0
    return res


def _local(k: int, tags: Sequence[str]):
    """__d<j> (and with tag h the half grid's __h<j>) from collected windows __t, __u<j> (__ht, __hu<j>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {c: b[c] for c in b.columns if not c.startswith("__w")}
            for tag in tags:
                res = _slopes(b["t"].to_numpy(), b[f"__w{tag}t"].to_numpy(), [b[f"__w{tag}{j}"].to_numpy() for j in range(k)])
                out |= {f"__{tag}{j}": res[:, j] for j in range(k)}
            yield pd.DataFrame(out)

    return run


def _poly(rows: DataFrame, cols: Sequence[str], frames: dict[str, Callable[[str], Column]]) -> DataFrame:
    """rows with __<tag><j>: slopes of column j over the windows that frames[tag] collects."""
    wide = rows.select("*", *[x for tag, f in frames.items() for x in (f("t").alias(f"__w{tag}t"), *[f(c).alias(f"__w{tag}{j}") for j, c in enumerate(cols)])])
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"__{tag}{j} double" for tag in frames for j in range(len(cols))])
    return wide.mapInPandas(_local(len(cols), list(frames)), schema)


def deriv_local_poly(traj: DataFrame, cols: Sequence[str], by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Linear coefficient of a cubic least-squares fit over seq - 4 .. seq + 4, clipped at the ends.

    Frames carry at most nine points, so a long series is windowed in order, never gathered. Batches go to numpy in
    stacked form, grouped by window length.
    """
    frame = by_seq(by).rowsBetween(-HALF, HALF)
    return _poly(traj, cols, {"d": lambda c: F.collect_list(c).over(frame)}).select(*traj.columns, *[F.col(f"__d{j}").alias(f"d_{c}") for j, c in enumerate(cols)])


ESTIMATORS = {"central": deriv_central, "fd4": deriv_fd4, "local_poly": deriv_local_poly}


def derivatives(traj: DataFrame, cols: Sequence[str], estimator: str = "local_poly", by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """traj with d_<col>. by: the columns that name a series."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown derivative estimator {estimator!r}; known: {', '.join(ESTIMATORS)}")
    return ESTIMATORS[estimator](traj, cols, by)


def coarsen(traj: DataFrame, k: int = 2) -> DataFrame:
    """Every k-th row from the first, numbered anew."""
    return traj.where((F.col("seq") - 1) % k == 0).withColumn("seq", F.floor((F.col("seq") - 1) / k).cast("int") + 1)


def _between(point: Column, cols: Sequence[str]) -> dict[str, Column]:
    """Linear interpolation at t between the last non-null point (struct of t and cols) at or before a row and the first at
    or after it, held constant beyond both ends."""
    # both frames grow row by row; a frame that shrinks towards the end would be folded anew for every row
    before = Window.partitionBy("traj_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("traj_id").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    a, b = F.last(point, True).over(before), F.last(point, True).over(after)
    f = F.when(b["t"] > a["t"], (F.col("t") - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return {c: F.when(a.isNull(), b[c]).when(b.isNull(), a[c]).otherwise(a[c] + f * (b[c] - a[c])) for c in cols}


def interp_to_full(full: DataFrame, coarse: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Linear interpolation of coarse columns at the full grid's times, held constant beyond both ends.

    One union and two running windows.
    """
    both = full.select("traj_id", "t", "seq", F.lit(1).alias("__full"), *[F.lit(None).cast("double").alias(c) for c in cols]).unionByName(
        coarse.select("traj_id", "t", F.lit(None).cast("int").alias("seq"), F.lit(0).alias("__full"), *cols)
    )
    at = _between(F.when(F.col("__full") == 0, F.struct("t", *cols)), cols)
    return both.select("traj_id", "seq", "t", "__full", *[x.alias(c) for c, x in at.items()]).where("__full = 1").drop("__full")


#: How many rows away an estimator looks.
REACH = {"central": 1, "fd4": 2, "local_poly": HALF}
#: Rows of a range of a series that is spread over tasks.
RANGE = 1 << 17


def ranged(traj: DataFrame, reach: int, by: Sequence[str] = ("traj_id",), rows: int = RANGE) -> DataFrame:
    """traj in ranges of `rows` rows of each series: __range, and __core false for the `reach` rows of either neighbour that a
    range needs beside its own. A series of any length is spread over tasks; a short one is one range."""
    if rows <= reach:
        raise ValueError("a range must hold more rows than an estimator looks away")
    own, at = F.floor((F.col("seq") - 1) / rows), (F.col("seq") - 1) % rows
    near = F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= rows - reach, own + 1))
    return traj.select("*", own.alias("__own"), F.explode(F.filter(near, lambda x: x.isNotNull())).alias("__range")).withColumn("__core", F.col("__own") == F.col("__range")).drop("__own")


def joined(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """a with b's other columns, by equal keys; null keys are equal to each other."""
    right = b.withColumnsRenamed({c: f"__k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return a.join(right, same).drop(*[f"__k_{c}" for c in by])


def with_errors(traj: DataFrame, cols: Sequence[str], estimator: str = "local_poly", by: Sequence[str] = ("traj_id",), rows: int | None = None) -> DataFrame:
    """traj with d_<col> and r_<col>: the derivative and its difference from the half-grid derivative, interpolated.

    The half grid is the 1st, 3rd, ... point; rows between take the line between their neighbours' derivatives, a last row
    that is not on it its left neighbour's. All comes from the rows up to twice the estimator's reach away, so that one
    window by seq does; a series' points must be in time order. With `rows`, long series are spread over tasks in ranges of
    so many rows; what it needs of a whole series (length, first and last time) then comes from a grouped aggregate.
    """
    if estimator not in REACH:
        raise ValueError(f"unknown derivative estimator {estimator!r}; known: {', '.join(REACH)}")
    odd = F.col("seq") % 2 == 1
    last_odd = F.max(F.when(odd, F.col("t")))
    if rows is None:
        keys, w = list(by), by_seq(by)
        base = traj.select("*", F.lit(True).alias("__core"))
        if estimator == "fd4":
            over = whole_in_order(by)
            base = base.select("*", F.count(F.lit(1)).over(over).alias("__n"), F.min("t").over(over).alias("__lo"), F.max("t").over(over).alias("__hi"), last_odd.over(over).alias("__ho"))
    else:
        keys, w = [*by, "__range"], by_seq([*by, "__range"])
        base = ranged(traj, 2 * REACH[estimator] + 1, by, rows)
        if estimator == "fd4":
            base = joined(base, traj.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("t").alias("__lo"), F.max("t").alias("__hi"), last_odd.alias("__ho")), by)
    if estimator == "central":
        base = base.select("*", *[central(c, w).alias(f"__d{j}") for j, c in enumerate(cols)], *[central(c, w, 2).alias(f"__h{j}") for j, c in enumerate(cols)])
    elif estimator == "fd4":
        half = F.floor((F.col("__n") + 1) / 2)
        base = base.withColumns({"__m": half, "__step": F.when(F.col("__n") > 1, (F.col("__hi") - F.col("__lo")) / (F.col("__n") - 1)), "__step2": F.when(half > 1, (F.col("__ho") - F.col("__lo")) / (half - 1))})
        place = (F.floor((F.col("seq") - 1) / 2) + 1).cast("int")
        base = base.select("*", *[fd4(c, F.col("seq"), F.col("__n"), F.col("__step"), w).alias(f"__d{j}") for j, c in enumerate(cols)], *[fd4(c, place, F.col("__m"), F.col("__step2"), w, 2).alias(f"__h{j}") for j, c in enumerate(cols)])
    else:
        # the half grid's windows skip every other row of twice the width
        at = lambda c: F.array(*[_at(c, 2 * k, w) for k in range(-HALF, HALF + 1)])
        base = _poly(base, cols, {"d": lambda c: F.collect_list(c).over(w.rowsBetween(-HALF, HALF)), "h": lambda c: F.when(odd, F.filter(at(c), lambda x: x.isNotNull()))})
    dn, up = (lambda c: _at(c, -1, w)), (lambda c: _at(c, 1, w))
    f = F.when(up("t") > dn("t"), (F.col("t") - dn("t")) / (up("t") - dn("t"))).otherwise(0.0)
    between = lambda h: F.when(odd, F.col(h)).when(up(h).isNull(), dn(h)).otherwise(dn(h) + f * (up(h) - dn(h)))
    out = base.select(*traj.columns, "__core", *[F.col(f"__d{j}").alias(f"d_{c}") for j, c in enumerate(cols)], *[F.abs(F.col(f"__d{j}") - between(f"__h{j}")).alias(f"r_{c}") for j, c in enumerate(cols)])
    return out.where("__core").drop("__core") if rows is not None else out.drop("__core")


def richardson_error(traj: DataFrame, cols: Sequence[str], estimator: str = "local_poly", by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """The series' keys, seq, t and r_<col>: absolute difference of full-grid and interpolated half-grid derivatives."""
    return with_errors(traj, cols, estimator, by).select(*by, "seq", "t", *[f"r_{c}" for c in cols])


EPS = 2.220446049250313e-16


def medians(rich: DataFrame, cols: Sequence[str], by: Sequence[str] = ("traj_id",), hot: int | None = None) -> DataFrame:
    """The series' keys, m_<col> (exact median of r^2) and __n, the series' length. hot: series of more rows are ranked in
    passes (quantiles.exact_quantiles)."""
    if hot is None:
        return rich.groupBy(*by).agg(*[F.percentile(F.col(f"r_{c}") * F.col(f"r_{c}"), F.lit(0.5)).alias(f"m_{c}") for c in cols], F.count(F.lit(1)).alias("__n"))
    from .quantiles import exact_quantiles

    out = rich.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    for c in cols:
        out = joined(out, exact_quantiles(rich.withColumn("__r2", F.col(f"r_{c}") * F.col(f"r_{c}")), "__r2", (0.5,), by, "cont", hot).select(*by, F.get("q", F.lit(0)).alias(f"m_{c}")), by)
    return out


def weight(c: str, eps: float = EPS) -> Column:
    return 1 / (F.col(f"r_{c}") * F.col(f"r_{c}") + F.col(f"m_{c}") + eps)


def richardson_weights(rich: DataFrame, cols: Sequence[str], eps: float = EPS) -> DataFrame:
    """w_<col> = 1 / (r^2 + median r^2 + eps) per trajectory, with the exact median."""
    return rich.join(medians(rich, cols), "traj_id").select("traj_id", "seq", *[weight(c, eps).alias(f"w_{c}") for c in cols])


def blocks_of(seq: Column, n: Column, fits: bool = False) -> Column:
    """Names of the report blocks that hold a row: all, first / middle / last 30 %, and with fits the rows that the splits
    A, B and C fit on."""
    k, mid = F.floor(n * 0.3), F.floor(n * 0.35)
    first, middle, last = seq <= k, (seq > mid) & (seq <= n - mid), seq > n - k
    held = {"first": first, "middle": middle, "last": last} | ({"fit_a": ~last, "fit_b": ~first, "fit_c": ~middle} if fits else {})
    return F.filter(F.array(F.lit("all"), *[F.when(c, F.lit(x)) for x, c in held.items()]), lambda x: x.isNotNull())


def estimator_error(est: DataFrame, truth: DataFrame, col: str, fits: bool = False) -> DataFrame:
    """Per trajectory and block: RMS and maximum of the error against a known derivative, RMS of the error bound r,
    their ratio (Infinity at a zero bound), correlation of |error| with r, and the share of rows where r covers it.

    est: traj_id, seq, d, r; truth: traj_id, seq, d_true.
    """
    rows = est.join(truth, ["traj_id", "seq"]).withColumns({"e": F.abs(F.col("d") - F.col("d_true")), "__n": F.count(F.lit(1)).over(whole())})
    rows = rows.withColumn("block", F.explode(blocks_of(F.col("seq"), F.col("__n"), fits)))
    rms, bound = F.sqrt(F.avg(F.col("e") * F.col("e"))), F.sqrt(F.avg(F.col("r") * F.col("r")))
    return rows.groupBy("traj_id", "block").agg(
        F.count(F.lit(1)).alias("n"), rms.alias("rms"), F.max("e").alias("max_abs"), bound.alias("bound_rms"),
        F.when(bound > 0, rms / bound).otherwise(F.lit(float("inf"))).alias("ratio"), F.corr("e", "r").alias("corr"), F.avg((F.col("e") <= F.col("r")).cast("double")).alias("covered"),
    ).withColumn("col", F.lit(col))


def best_estimator(report: DataFrame) -> DataFrame:
    """The estimator of the smallest median RMS over the whole-series block; ties by name."""
    med = report.where("block = 'all'").groupBy("estimator").agg(F.percentile("rms", F.lit(0.5)).alias("median_rms"))
    return med.agg(F.min(F.struct("median_rms", "estimator")).alias("b")).select("b.estimator", "b.median_rms")


def active_fraction(deriv: DataFrame, cols: Sequence[str], part: float = 0.01) -> DataFrame:
    """Share of rows whose |d| exceeds a part of the largest |d|; 0 if all are zero."""
    d = deriv.select("traj_id", *[F.abs(F.col(f"d_{c}")).alias(c) for c in cols]).select("*", *[F.max(c).over(whole()).alias(f"m_{c}") for c in cols])
    return d.groupBy("traj_id").agg(*[F.avg(F.when((F.col(f"m_{c}") > 0) & (F.col(c) > part * F.col(f"m_{c}")), 1.0).otherwise(0.0)).alias(f"active_{c}") for c in cols])


def settle_time(traj: DataFrame, cols: Sequence[str], part: float = 0.01) -> DataFrame:
    """First time at which a state lies within a part of its spread above its minimum; null without spread."""
    w = traj.select("traj_id", "t", *cols, *[F.min(c).over(whole()).alias(f"lo_{c}") for c in cols], *[F.max(c).over(whole()).alias(f"hi_{c}") for c in cols])
    hit = lambda c: (F.col(f"hi_{c}") > F.col(f"lo_{c}")) & (F.col(c) <= F.col(f"lo_{c}") + part * (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    return w.groupBy("traj_id").agg(*[F.min(F.when(hit(c), F.col("t"))).alias(f"settle_{c}") for c in cols])


def audit_trajectories(traj: DataFrame, init: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Point count, time range and whether the first state equals the declared one (init: traj_id and i_<col>)."""
    a = traj.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min(F.struct("seq", *cols)).alias("f"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"i_{c}"))
    return a.join(init, "traj_id", "left").select("traj_id", "n", "t_min", "t_max", same.alias("starts_as_declared"))


def max_difference(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest |a - b| per trajectory and column over equal seq."""
    j = a.select("traj_id", "seq", *cols).join(b.select("traj_id", "seq", *[F.col(c).alias(f"o_{c}") for c in cols]), ["traj_id", "seq"])
    return j.groupBy("traj_id").agg(*[F.max(F.abs(F.col(c) - F.col(f"o_{c}"))).alias(f"max_{c}") for c in cols])


def decimated(traj: DataFrame, ks: Sequence[int], by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """traj once for each k, with k: every k-th row from the first, numbered anew. The keys of its series are by and k."""
    if min(ks) < 1 or len(set(ks)) != len(ks):
        raise ValueError("densities must be distinct whole numbers from 1 on")
    rows = traj.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where((F.col("seq") - 1) % F.col("k") == 0)
    return rows.withColumn("seq", (F.floor((F.col("seq") - 1) / F.col("k")) + 1).cast("int"))


def density_bounds(traj: DataFrame, cols: Sequence[str], ks: Sequence[int] = (1, 2, 4), estimator: str = "central") -> DataFrame:
    """RMS error bound per trajectory, column and decimation k: one job over (trajectory, k)."""
    r = richardson_error(decimated(traj, ks), cols, estimator, ("traj_id", "k"))
    return r.groupBy("traj_id", "k").agg(F.count(F.lit(1)).alias("n"), *[F.sqrt(F.avg(F.col(f"r_{c}") * F.col(f"r_{c}"))).alias(f"bound_{c}") for c in cols])
