"""Mixing sources to target weights by capped water-filling and seeded repetitions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hash32, materialize, table

#: A source's hash range is cut into 2**BITS buckets, and the bucket in which its last fractional repetition ends into as
#: many again; only that last part (2**-24 of the source) is ranked document by document.
BITS = 12
OWN = ("__tw_", "mix_")


def _keyed(docs: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """docs without columns of reserved names, with the source's key and the hash that the draw goes by."""
    plain = docs.drop(*[c for c in docs.columns if c.lower().startswith(OWN)])
    return plain.withColumns({"__tw_key": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")), "__tw_h": hash32(F.lit(seed), F.col(key))})


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _end(hist: DataFrame, by_source: DataFrame) -> DataFrame:
    """__tw_key, __tw_end and __tw_before: the first bucket of hist (__tw_key, __tw_bucket, __tw_b) that reaches __tw_need
    (of by_source, counted from __tw_before on) and what lies before it; no bucket reaches it: the one after the last."""
    cum = Window.partitionBy("__tw_key").orderBy("__tw_bucket")
    h = hist.join(by_source, "__tw_key").withColumn("__tw_cum", F.col("__tw_before") + F.sum("__tw_b").over(cum))
    first = F.min(F.when(F.col("__tw_cum") >= F.col("__tw_need"), F.struct("__tw_bucket", (F.col("__tw_cum") - F.col("__tw_b")).alias("before"))))
    end = h.groupBy("__tw_key").agg(F.coalesce(first, F.struct(F.lit(1 << BITS).alias("__tw_bucket"), F.lit(0).cast("long").alias("before"))).alias("e"))
    return end.select("__tw_key", F.col("e.__tw_bucket").alias("__tw_end"), F.col("e.before").alias("__tw_before"))


def source_plan(docs: DataFrame, *, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 2.0, seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per source: its size, target, whole repetitions and where its fractional repetition ends.

    A target is weight * level, with one level for all sources that stay under max_epochs * size. Sources sorted by
    cap / weight are clamped from the front as long as the level of the rest exceeds their cap.
    """
    keyed = _keyed(docs, source, key, seed)
    bucket = F.shiftright("__tw_h", 32 - BITS).cast("int").alias("__tw_bucket")
    hist = materialize(keyed.groupBy("__tw_key", F.col(source).cast("string").alias("__tw_source"), bucket).agg(F.sum(_size(text)).alias("__tw_b")), "mix-hist")
    by_source = hist.groupBy("__tw_key", "__tw_source").agg(F.sum("__tw_b").alias("__tw_n"))
    # one row per source from here on
    order, every = Window.orderBy(F.col("__tw_source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumns({"cap": F.lit(float(max_epochs)) * F.col("__tw_n"), "budget": F.lit(float(share)) * F.sum("__tw_n").over(every)})
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("__tw_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"rn": F.row_number().over(fill), "c0": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "wt": F.sum("w").over(every)})
    s = s.withColumn("level", (F.col("budget") - F.col("c0")) / (F.col("wt") - F.col("w0")))
    s = s.withColumn("clamped", F.col("cap") <= F.col("w") * F.col("level"))
    s = s.withColumn("first_free", F.min(F.when(~F.col("clamped"), F.col("rn"))).over(every))
    s = s.withColumn("level", F.max(F.when(F.col("rn") == F.col("first_free"), F.col("level"))).over(every))
    s = s.withColumn("__tw_target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * F.col("level")))
    s = s.withColumn("__tw_whole", F.when(F.col("__tw_n") > 0, F.floor(F.col("__tw_target") / F.col("__tw_n"))).otherwise(0).cast("long"))
    s = s.withColumn("__tw_need", F.col("__tw_target") - (F.col("__tw_whole") * F.col("__tw_n")).cast("double"))
    plan = s.select("__tw_key", "__tw_n", "__tw_target", "__tw_whole", "__tw_need")
    first = materialize(_end(hist, plan.withColumn("__tw_before", F.lit(0).cast("long"))).join(plan, "__tw_key"), "mix-plan")
    # sizes are counted again only in the bucket that each source ends in
    inside = keyed.join(first.select("__tw_key", "__tw_end"), "__tw_key").where(F.shiftright("__tw_h", 32 - BITS) == F.col("__tw_end"))
    inner = F.shiftright("__tw_h", 32 - 2 * BITS).bitwiseAND((1 << BITS) - 1).cast("int").alias("__tw_bucket")
    second = _end(inside.groupBy("__tw_key", inner).agg(F.sum(_size(text)).alias("__tw_b")), first).withColumnsRenamed({"__tw_end": "__tw_end2", "__tw_before": "__tw_before2"})
    end = F.when(F.col("__tw_need") > 0, F.shiftleft("__tw_end", BITS) + F.coalesce("__tw_end2", F.lit(0))).otherwise(-1)
    return materialize(first.join(second, "__tw_key", "left").select("__tw_key", "__tw_n", "__tw_target", "__tw_whole", "__tw_need", end.alias("__tw_end"), F.coalesce("__tw_before2", F.lit(0)).alias("__tw_before")), "mix-plan")


def mix(docs: DataFrame, *, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 2.0, seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of docs with size, source_size, target, reps and taken under the prefix mix_.

    Sources by code point, null last, take the weights in turn. Each document gets its source's whole repetitions; the
    fractional one goes to documents in the order of a seeded hash until their words reach the rest of the target. The
    draw depends on (seed, key, source) alone, so reruns agree. Null text: size 0. Repeated rows are drawn one by one.
    A hot source is never gathered: buckets before its end are taken whole, only 2**-24 of it is ranked.
    Empty table: empty result. Other columns pass through; input columns whose names start with __tw_ or mix_ are dropped.
    """
    plan = source_plan(docs, share=share, weights=weights, max_epochs=max_epochs, seed=seed, source=source, text=text, key=key)
    keyed = _keyed(docs, source, key, seed)
    names = keyed.columns[:-2]
    rows = keyed.withColumns({"__tw_size": _size(text), "__tw_at": F.shiftright("__tw_h", 32 - 2 * BITS)}).join(plan, "__tw_key")
    rank = Window.partitionBy("__tw_key").orderBy("__tw_h", key, "__tw_size").rowsBetween(Window.unboundedPreceding, -1)
    at_end = rows.where(F.col("__tw_at") == F.col("__tw_end")).withColumn(
        "__tw_extra", (F.col("__tw_before") + F.coalesce(F.sum("__tw_size").over(rank), F.lit(0)) + F.col("__tw_size") / 2.0 <= F.col("__tw_need")).cast("int")
    )
    others = rows.where(F.col("__tw_at") != F.col("__tw_end")).withColumn("__tw_extra", (F.col("__tw_at") < F.col("__tw_end")).cast("int"))
    reps = (F.col("__tw_whole") + F.col("__tw_extra")).cast("int")
    return others.unionByName(at_end).select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__tw_size").alias("mix_size"), F.col("__tw_n").alias("mix_source_size"), F.col("__tw_target").alias("mix_target"), reps.alias("mix_reps"), (reps * F.col("__tw_size")).alias("mix_taken"),
    )


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as mix_reps says, without the mix_ columns."""
    keep = [c for c in mixed.columns if not c.startswith("mix_")]
    return mixed.where("mix_reps > 0").withColumn("__tw_copy", F.explode(F.sequence(F.lit(1), F.col("mix_reps")))).select(*[F.col(f"`{c}`") for c in keep])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
             2 * CAST(source_size AS DOUBLE) AS cap, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
f AS (SELECT *, row_number() OVER o AS rn, coalesce(sum(cap) OVER b, 0) AS c0, coalesce(sum(w) OVER b, 0) AS w0, sum(w) OVER () AS wt FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST), b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (budget - c0) / (wt - w0) AS level, cap <= w * ((budget - c0) / (wt - w0)) AS clamped FROM f),
k AS (SELECT *, min(CASE WHEN NOT clamped THEN rn END) OVER () AS first_free FROM g),
m AS (SELECT *, max(CASE WHEN rn = first_free THEN level END) OVER () AS final_level FROM k),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE w * final_level END AS target FROM m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - CAST(p.whole * p.source_size AS DOUBLE) AS need,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN need > 0 AND before + size / 2.0 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
