"""Campaign data: manifests, resume, registries, merges, tables of results. Mostly joins and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.scratch import cut

from .aggregates import as_bool

#: What names a cell of a campaign.
KEY = ("variant", "system_id", "initial_condition_set", "seed", "config_fingerprint")


def build_manifest(variants: DataFrame, systems: DataFrame, ics: DataFrame, seeds: DataFrame) -> DataFrame:
    """manifest_index, variant, system_id, initial_condition_set, seed: the product of four lists, numbered from 0.

    A row's number follows from its places in the lists, so the product itself is never sorted. A value twice in a list is
    an error, as it would repeat identities.
    """
    sizes, rows, index = [], None, F.lit(0).cast("long")
    for d in (variants, systems, ics, seeds):
        (c,) = d.columns
        n = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(c).alias("k"), F.count(c).alias("m")).first()
        if n["n"] != n["k"] + (n["n"] > n["m"]):
            raise ValueError(f"repeated values in {d.columns}")
        sizes.append(n["n"])
        numbered = d.withColumn(f"__{c}", F.row_number().over(Window.orderBy(c)) - 1)
        rows = numbered if rows is None else rows.crossJoin(numbered)
        index = index * n["n"] + F.col(f"__{c}")
    return rows.select(index.alias("manifest_index"), "variant", "system_id", "initial_condition_set", "seed")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place from 1 by order (which no two rows of a group share) within its group, as column name.

    Rows are cut into ranges; a place is that within the range plus the sizes of the group's ranges before. So a group of
    any size is numbered by many tasks.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    return ranged.withColumn(name, inside).join(sizes.select(*group, "__part", before.alias("__before")), [*group, "__part"]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def manifest_order(manifest: DataFrame, dims: DataFrame, costs: Mapping[int, float]) -> DataFrame:
    """manifest_index, dim, by_dim (position in the dimension's list), by_cost (position in the cost-descending list)."""
    cost = F.lit(0.0)
    for d, c in costs.items():
        cost = F.when(F.col("dim") == d, c).otherwise(cost)
    m = manifest.select("manifest_index", "system_id").join(dims, "system_id").select("manifest_index", "dim", (-cost).alias("__cheap"))
    return ranked(ranked(m, ["dim"], ["manifest_index"], "by_dim"), [], ["__cheap", "manifest_index"], "by_cost").select("manifest_index", "dim", "by_dim", "by_cost")


def with_ic(df: DataFrame) -> DataFrame:
    return df.withColumn("initial_condition_set", F.coalesce("initial_condition_set", F.lit(1)))


def ok_record() -> Column:
    return F.col("error").isNull() | (F.col("error") == "")


def remaining_cells(manifest: DataFrame, history: DataFrame, fingerprint: str) -> DataFrame:
    """Manifest rows without a finished record of the same fingerprint; a missing condition set is 1."""
    done = with_ic(history.where(ok_record() & (F.col("config_fingerprint") == fingerprint))).select("variant", "system_id", "initial_condition_set", "seed").distinct()
    return manifest.join(done, ["variant", "system_id", "initial_condition_set", "seed"], "left_anti")


def build_registry(manifest: DataFrame, config: DataFrame, status: DataFrame, metrics: DataFrame, result: DataFrame) -> DataFrame:
    """run_id, status, inferred_status, metrics_available, corrupted, loss: one row per manifest run.

    Each folder table has run_id and readable (false: the file is there but broken); config decides first, then status.
    """
    side = lambda d, x, *c: d.select("run_id", F.col("readable").alias(f"{x}_ok"), *c)
    j = manifest.select("run_id").join(side(config, "config"), "run_id", "left").join(side(status, "status", "status", "finished_at"), "run_id", "left")
    j = j.join(side(metrics, "metrics", "loss"), "run_id", "left").join(side(result, "result"), "run_id", "left")
    no_config = ~F.coalesce("config_ok", F.lit(False))
    st = F.when(no_config | (~F.col("status_ok")), "corrupted").otherwise(F.col("status"))
    inferred = F.when(no_config, "corrupted").when(F.col("status_ok").isNull(), "never_started").when(~F.col("status_ok"), "corrupted").when((F.col("status") == "running") & F.col("finished_at").isNull(), "interrupted").otherwise(F.col("status"))
    bad = no_config | F.coalesce(~F.col("status_ok"), F.lit(False)) | F.coalesce(~F.col("metrics_ok"), F.lit(False)) | F.coalesce((F.col("status") == "finished") & (~F.coalesce("result_ok", F.lit(False)) | F.col("metrics_ok").isNull()), F.lit(False))
    return j.select("run_id", st.alias("status"), inferred.alias("inferred_status"), (~no_config & F.coalesce("metrics_ok", F.lit(False))).alias("metrics_available"), bad.alias("corrupted"), F.when(~no_config & F.coalesce("metrics_ok", F.lit(False)), F.col("loss")).alias("loss"))


def registry_counts(registry: DataFrame) -> DataFrame:
    kinds = ("finished", "failed", "interrupted", "never_started", "corrupted")
    return registry.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("inferred_status") == k).alias(k) for k in kinds])


def merge_records(new: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): failed records and keys already in the history are skipped; of equal keys the first by
    (file, line) wins. new also has file and line."""
    have = with_ic(history).select(*KEY).distinct()
    rows = with_ic(new).withColumn("__rn", F.row_number().over(Window.partitionBy(*KEY, ok_record()).orderBy("file", "line")))
    seen = rows.join(have.withColumn("__seen", F.lit(True)), [rows[k].eqNullSafe(have[k]) for k in KEY], "left").select(rows["*"], "__seen")
    added = ok_record() & F.col("__seen").isNull() & (F.col("__rn") == 1)
    counts = seen.agg(F.count(F.lit(1)).alias("considered"), F.count_if(added).alias("added"), F.count_if(ok_record() & ~added).alias("skipped_duplicates"), F.count_if(~ok_record()).alias("skipped_failed"))
    return seen.where(added).drop("__rn", "__seen", "file", "line"), counts


def history_to_registry(history: DataFrame) -> DataFrame:
    """Registry columns of campaign records: a run_id of the parts that are there, the dimension from u0 or else the
    support, no match for surrogates, and the status from the error."""
    text = lambda c: F.col(c).cast("string")
    ok = ok_record()
    return history.select(
        F.concat_ws("_", *[text(c) for c in ("manifest_index", "variant", "system_id", "initial_condition_set", "seed")]).alias("run_id"), F.lit("B").alias("phase"), "system_id",
        F.when(F.col("u0").isNotNull(), F.size("u0")).when(F.col("support_terms").isNotNull(), F.size("support_terms")).alias("system_dim"), F.col("variant").alias("variant_slug"), "seed",
        F.when(ok, "finished").otherwise("failed").alias("status"), ok.alias("success"), F.when(~ok, F.col("error")).alias("failure_reason"), "loss",
        F.when(F.coalesce(F.col("representability") != "surrogate", F.lit(True)), F.col("pruned_match")).alias("exact_support_match"), ok.alias("metrics_available"), "r2",
    )


def normalize_registry(df: DataFrame, required: Sequence[str] = ("variant_slug", "system_id", "loss")) -> DataFrame:
    """variant becomes variant_slug; match texts become booleans and metric texts numbers; missing columns are an error."""
    if "variant_slug" not in df.columns and "variant" in df.columns:
        df = df.withColumnRenamed("variant", "variant_slug")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"registry lacks {', '.join(missing)}")
    out = {"exact_support_match": as_bool(F.col("exact_support_match"))} if "exact_support_match" in df.columns else {}
    kinds = dict(df.dtypes)
    out |= {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("loss", "final_stage", "stage_overshoot", "wasted_levels", "elapsed_s", "r2") if kinds.get(c) == "string"}
    return df.withColumns(out)


def reindex(cells: DataFrame, variants: DataFrame, systems: DataFrame, fill: Mapping[str, float] | None = None) -> DataFrame:
    """A row for every (variant_slug, system_id) of the two lists; missing cells are null, or the fill values."""
    full = variants.select("variant_slug").distinct().crossJoin(F.broadcast(systems.select("system_id").distinct())).join(cells, ["variant_slug", "system_id"], "left")
    return full.fillna(dict(fill)) if fill else full


def ordered_variants(cells: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """variant_slug, pos: preferred names in their order, then the others by name."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("variant_slug"))
    d = cells.select("variant_slug").distinct()
    return d.select("variant_slug", F.row_number().over(Window.orderBy(F.when(rank > 0, rank).otherwise(len(preferred) + 1), "variant_slug")).alias("pos"))


def class_coverage(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """system_id, problem: observed systems without a classification; one row 'no_overlap' if none is classified."""
    seen = cells.select("system_id").distinct()
    miss = seen.join(classes.select("system_id").distinct(), "system_id", "left_anti")
    n = seen.join(classes.select("system_id").distinct(), "system_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    none = n.where("n = 0").select(F.lit(None).cast("long").alias("system_id"), F.lit("no_overlap").alias("problem"))
    return miss.select(F.col("system_id").cast("long").alias("system_id"), F.lit("unclassified").alias("problem")).unionByName(none)


def split_by_class(cells: DataFrame, classes: DataFrame, strict: bool = True) -> DataFrame:
    """cells with cls: exact if all of a system's classification rows are, else surrogate. Strict: gaps are an error."""
    if strict and not class_coverage(cells, classes).isEmpty():
        raise ValueError("systems without classification")
    c = classes.groupBy("system_id").agg(F.when(F.bool_and(F.col("representability") == "exact"), "exact").otherwise("surrogate").alias("cls"))
    return cells.join(c, "system_id")


def split_by_support(cells: DataFrame) -> DataFrame:
    """cells with cls: exact if the system has any match rate."""
    any_rate = F.bool_or(F.col("exact_match_rate").isNotNull()).over(Window.partitionBy("system_id"))
    return cells.withColumn("cls", F.when(any_rate, "exact").otherwise("surrogate"))


def main_results(cells: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The exact block and then the surrogate block, ordered; R2 only for surrogates."""
    order = ordered_variants(cells, preferred)
    j = cells.join(F.broadcast(order), "variant_slug").withColumn("block", F.when(F.col("cls") == "exact", 1).otherwise(2))
    rn = F.row_number().over(Window.partitionBy("block").orderBy("system_id", "pos"))
    return j.select("block", rn.alias("row"), "system_id", "variant_slug", "mean_loss", "exact_match_rate", F.when(F.col("block") == 2, F.col("mean_r2")).alias("mean_r2"))


def scientific(x: Column, digits: int = 2) -> Column:
    """1.2e-3 as text; -- for null; 0 for zero."""
    e = F.floor(F.log10(F.abs(x)))
    return F.when(x.isNull() | F.isnan(x), "--").when(x == 0, "0").otherwise(F.concat(F.format_string(f"%.{digits - 1}f", x / F.pow(F.lit(10.0), e)), F.lit("e"), e.cast("string")))


def format_cells(cells: DataFrame) -> DataFrame:
    """variant_slug, system_id, cell: loss with its deviation and match rate; -- without valid runs."""
    std = scientific(F.col("std_loss"))
    loss = F.concat(scientific(F.col("mean_loss")), F.when(std != "--", F.concat(F.lit(" +- "), std)).otherwise(""))
    match = F.when(F.col("exact_match_rate").isNull(), "--").otherwise(F.concat(F.rint(F.col("exact_match_rate") * 100).cast("int").cast("string"), F.lit("%")))
    return cells.select("variant_slug", "system_id", F.when(F.coalesce("n_valid", F.lit(0)) == 0, "--").otherwise(F.concat(loss, F.lit("; EM: "), match)).alias("cell"))


def audit_pairs(rows: DataFrame, systems: DataFrame, ics: DataFrame) -> DataFrame:
    """system_id, initial_condition_set, problem: pairs that are missing or repeated."""
    full = systems.select("system_id").distinct().crossJoin(F.broadcast(ics.select("initial_condition_set").distinct()))
    miss = full.join(rows.select("system_id", "initial_condition_set").distinct(), ["system_id", "initial_condition_set"], "left_anti").withColumn("problem", F.lit("missing"))
    twice = rows.groupBy("system_id", "initial_condition_set").count().where("count > 1").select("system_id", "initial_condition_set", F.lit("repeated").alias("problem"))
    return miss.unionByName(twice)


def check_identity(records: DataFrame) -> DataFrame:
    """campaign, n_hashes, n_configs, n_behaviours, n_mismatched, ok: one identity per campaign, equal to the manifest's."""
    g = records.groupBy("campaign").agg(
        F.countDistinct("git_hash").alias("n_hashes"), F.countDistinct("config_fingerprint").alias("n_configs"), F.countDistinct("behaviour_fingerprint").alias("n_behaviours"),
        F.count_if(~F.col("config_fingerprint").eqNullSafe(F.col("manifest_fingerprint"))).alias("n_mismatched"),
    )
    return g.withColumn("ok", (F.col("n_hashes") <= 1) & (F.col("n_configs") <= 1) & (F.col("n_behaviours") <= 1) & (F.col("n_mismatched") == 0))


def gate_readout(records: DataFrame, anchor_loss: float, expected_caps: Sequence[int], truth: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """The latest matching record (last line) of each key against a fixed anchor: stages, support per equation, loss,
    verdict. records: line_no, loss, error, eq_final_stages, support_terms."""
    ok = records.where(ok_record() & F.col("support_terms").isNotNull())
    last = ok.groupBy(*keys).agg(F.max_by(F.struct("loss", "eq_final_stages", "support_terms"), "line_no").alias("r"))
    stages = F.coalesce(F.col("r.eq_final_stages") == F.array(*[F.lit(x) for x in expected_caps]), F.lit(False))
    sup = [F.coalesce(F.array_sort(F.array_distinct(F.get(F.col("r.support_terms"), F.lit(i)))) == F.array(*[F.lit(x) for x in sorted(t)]), F.lit(False)).alias(f"du{i + 1}_exact") for i, t in enumerate(truth)]
    loss = F.col("r.loss")
    versus = F.when(loss < anchor_loss, "better").when(loss == anchor_loss, "equal").otherwise("worse")
    return last.select(*keys, F.when(stages, "REPORTABLE").otherwise("IMPLEMENTATION_CHECK_FAILED").alias("verdict"), *sup, versus.alias("loss_vs_anchor"))


def diff_frozen(a: DataFrame, b: DataFrame, volatile: Sequence[str] = ()) -> DataFrame:
    """Rows of a that b lacks (side 'new') and the other way round (side 'frozen'), without the volatile columns."""
    x, y = a.drop(*volatile), b.drop(*volatile).select(*a.drop(*volatile).columns)
    return x.exceptAll(y).withColumn("side", F.lit("new")).unionByName(y.exceptAll(x).withColumn("side", F.lit("frozen")))


def validate_inputs(cells: DataFrame, variants: DataFrame, systems: DataFrame) -> DataFrame:
    """kind, what: missing variants and systems (errors) and cells without a valid run (warnings)."""
    v = variants.select("variant_slug").distinct().join(cells.select("variant_slug").distinct(), "variant_slug", "left_anti").select(F.lit("missing_variant").alias("kind"), F.col("variant_slug").alias("what"))
    s = systems.select("system_id").distinct().join(cells.select("system_id").distinct(), "system_id", "left_anti").select(F.lit("missing_system").alias("kind"), F.col("system_id").cast("string").alias("what"))
    w = cells.where(F.coalesce("n_valid", F.lit(0)) <= 0).select(F.lit("no_valid_runs").alias("kind"), F.concat_ws("/", F.col("variant_slug"), F.col("system_id").cast("string")).alias("what"))
    return v.unionByName(s).unionByName(w)


def infer_seed(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """rows with seed filled from the row's place within (variant_slug, system_id) by line, cycling through the list."""
    n = F.row_number().over(Window.partitionBy("variant_slug", "system_id").orderBy("line_no")) - 1
    return rows.withColumn("__n", n).withColumn("seed", F.coalesce("seed", F.element_at(F.array(*[F.lit(s) for s in seeds]), (F.col("__n") % len(seeds) + 1).cast("int")))).drop("__n")
