"""Exact quantiles of groups of any size. `percentile` holds all distinct values of a group in one task; here a group that
is too large for that is narrowed down, pass by pass, to few values around each wanted rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.scratch import cut

#: Rows of a group that one task may sort.
HOT = 1_000_000
#: Splitters of a pass, and the accuracy of the sketch that they come from. Only speed depends on them.
SPLITTERS, ACCURACY = 64, 2000


def _ranks(groups: DataFrame, by: Sequence[str], ps: Sequence[float], kind: str) -> DataFrame:
    """by, i, pos, r0, r1: for each quantile i the places (from 0) of the values that it lies between."""
    each = groups.withColumn("q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ps)])))
    pos = F.col("q.p") * (F.col("n") - 1) if kind == "cont" else F.greatest(F.ceil(F.col("q.p") * F.col("n")), F.lit(1)) - 1.0
    return each.select(*by, F.col("q.i").alias("i"), pos.cast("double").alias("pos")).select("*", F.floor("pos").alias("r0"), F.ceil("pos").alias("r1"))


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with __g, a string that stands for its group; null keys are a group."""
    return df.withColumn("__g", F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit(""))


def _narrow(rows: DataFrame, targets: DataFrame, hot: int) -> DataFrame:
    """__g, rank, value of targets (__g, rank) among rows (__g, v), all of them groups of more than `hot` rows.

    A pass draws splitters from a sketch that is combined map-side, counts exactly how many rows lie on and between them, and
    keeps the interval that a rank falls into; a rank that falls on a splitter is found. It ends with intervals of at most
    `hot` rows, which are ranked as they are. Nothing but counts passes the driver.
    """
    known = None
    open_ = cut(targets.select("__g", "rank", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("inside")), "ranks")
    grid = F.array(*[F.lit(i / SPLITTERS) for i in range(SPLITTERS + 1)])
    while True:
        inner = rows.join(open_.where(F.coalesce(F.col("inside") > hot, F.lit(True))), "__g").where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")) | (F.col("inside").isNull()))
        cuts = cut(inner.groupBy("__g", "rank").agg(F.array_distinct(F.percentile_approx("v", grid, F.lit(ACCURACY))).alias("s")), "splitters")
        if cuts.isEmpty():
            break
        # even places lie between splitters, odd ones on them
        place = F.size(F.filter("s", lambda x: x < F.col("v"))) * 2 + F.array_contains("s", F.col("v")).cast("int")
        hist = inner.join(cuts, ["__g", "rank"]).groupBy("__g", "rank", "lo", "hi", "below", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("__g", "rank").orderBy("place")
        hist = hist.withColumn("upto", F.col("below") + F.sum("n").over(w)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).join(cuts, ["__g", "rank"])
        at = lambda k: F.get("s", k.cast("int"))
        half, on = F.floor(F.col("place") / 2), F.col("place") % 2 == 1
        now = cut(hist.select("__g", "rank", on.alias("on"), at(half).alias("value"), F.coalesce(at(half - 1), F.col("lo")).alias("lo"), F.coalesce(at(half), F.col("hi")).alias("hi"), (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside")), "ranks")
        found = now.where("on").select("__g", "rank", "value")
        known = found if known is None else known.unionByName(found)
        rest = open_.where(F.col("inside").isNotNull() & (F.col("inside") <= hot))
        open_ = cut(now.where("not on").drop("on", "value").unionByName(rest.select("__g", "rank", "lo", "hi", "below", "inside")), "ranks")
    few = rows.join(open_, "__g").where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).groupBy("__g", "rank", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__g", "rank").orderBy("v")
    last = few.withColumn("upto", F.col("below") + F.sum("n").over(w)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("__g", "rank", F.col("v").alias("value"))
    return last if known is None else known.unionByName(last)


def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = (), kind: str = "cont", hot: int = HOT) -> DataFrame:
    """by, n and q (array, one entry for each of ps): exact quantiles of the finite values of col; groups without any are absent.

    kind cont interpolates as `percentile` does, disc takes the nearest rank as `percentile_disc` does. Groups of up to `hot`
    rows are left to these; for larger ones the wanted ranks are found in passes over the data, so that no task holds more
    than `hot` rows of a group. Group sizes are counted first (one aggregate, run when this is called).
    """
    if kind not in ("cont", "disc") or any(not 0 <= p <= 1 for p in ps):
        raise ValueError("kind is cont or disc, quantiles lie between 0 and 1")
    v = F.col(col).cast("double")
    rows = _keyed(df, by).select(*by, "__g", v.alias("v")).where((F.abs("v") < float("inf")) & ~F.isnan("v"))
    sizes = cut(rows.groupBy("__g", *by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > hot)
    q = [F.percentile("v", F.lit(float(p))) if kind == "cont" else F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY v)") for p in ps]
    plain = lambda some: some.groupBy("__g", *by).agg(F.count(F.lit(1)).alias("n"), F.array(*q).alias("q")).drop("__g")
    if large.isEmpty():
        return plain(rows)
    small = plain(rows.join(large.select("__g"), "__g", "left_anti"))
    ranks = cut(_ranks(large, ["__g", *by, "n"], ps, kind), "quantiles")
    wanted = ranks.select("__g", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("rank")).distinct()
    found = cut(_narrow(rows.select("__g", "v").join(large.select("__g"), "__g", "left_semi"), wanted, hot), "values")
    side = lambda r: found.select("__g", F.col("rank").alias(r), F.col("value").alias(f"v_{r}"))
    both = ranks.join(side("r0"), ["__g", "r0"]).join(side("r1"), ["__g", "r1"])
    value = F.when(F.col("r0") == F.col("r1"), F.col("v_r0")).otherwise((F.col("r1") - F.col("pos")) * F.col("v_r0") + (F.col("pos") - F.col("r0")) * F.col("v_r1"))
    g = both.groupBy("__g", *by, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("q"))
    return small.unionByName(g.select(*by, "n", F.transform("q", lambda x: x["x"]).alias("q")))
