"""Term libraries and what is computed from terms and structures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.structures import core_term, gap_reason, term_stage


@dataclass(frozen=True)
class Term:
    idx: int
    name: str
    stage: int
    vars: tuple[int, ...]

    def column(self, prefix: str = "u") -> Column:
        u = [F.col(f"{prefix}{v}") for v in self.vars]
        if "(" in self.name:
            return (F.sin if self.name.startswith("sin") else F.cos)(u[0])
        if "^" in self.name:
            return u[0] * u[0] * u[0] if self.name.endswith("3") else u[0] * u[0]
        return u[0] * u[1] if len(u) == 2 else u[0]


@dataclass(frozen=True)
class CustomTerm(Term):
    """A term of one's own: fn makes its Column from the state columns u1, u2, ..."""

    fn: Callable[[Sequence[Column]], Column] = None

    def column(self, prefix: str = "u") -> Column:
        return self.fn([F.col(f"{prefix}{v}") for v in self.vars])


def custom_basis(specs: Sequence[tuple[str, int, tuple[int, ...], Callable[[Sequence[Column]], Column]]]) -> list[Term]:
    """A library of (name, stage, variables, function) in stage order, as cumulative stages are column prefixes."""
    if [s[1] for s in specs] != sorted(s[1] for s in specs):
        raise ValueError("terms must come in stage order")
    return [CustomTerm(k + 1, name, stage, tuple(v), fn) for k, (name, stage, v, fn) in enumerate(specs)]


def staged_basis(dim: int) -> list[Term]:
    """Stage 1 u_i, 2 squares, 3 products of two, 4 cubes, 5 sine and cosine in turn: 5d + d(d-1)/2 terms."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    one = range(1, dim + 1)
    specs = [(f"u{i}", 1, (i,)) for i in one] + [(f"u{i}^2", 2, (i,)) for i in one] + [(f"u{i}*u{j}", 3, (i, j)) for i in one for j in one if i < j]
    specs += [(f"u{i}^3", 4, (i,)) for i in one] + [(f"{f}(u{i})", 5, (i,)) for i in one for f in ("sin", "cos")]
    return [Term(k + 1, *s) for k, s in enumerate(specs)]


def flat_basis(dim: int, cols: Sequence[str] = ()) -> list[Term]:
    """Linear terms, squares and products of two, all of stage 1; dim 0 takes the number of state columns."""
    keep = [t for t in staged_basis(dim or len(cols)) if t.stage <= 3]
    order = {1: 0, 2: 1, 3: 2}
    return [Term(k + 1, t.name, 1, t.vars) for k, t in enumerate(sorted(keep, key=lambda t: (order[t.stage], t.idx)))]


def terms_table(spark: SparkSession, basis: Sequence[Term]) -> DataFrame:
    """One row per term of a library: a few dozen rows, built on the driver."""
    return spark.createDataFrame([(t.idx, t.name, t.stage, list(t.vars)) for t in basis], "term int, name string, stage int, vars array<int>")


def design(traj: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """traj_id, seq and phi, the active terms' values in order: one projection."""
    return traj.select("traj_id", "seq", F.array(*[t.column() for t in terms]).alias("phi"))


def eval_rhs(traj: DataFrame, basis: Sequence[Term], coefs: DataFrame) -> DataFrame:
    """traj_id, seq, eq, rhs: fitted right-hand sides on observed rows. coefs: traj_id, eq, term, coef."""
    packed = coefs.groupBy("traj_id", "eq").agg(F.array_sort(F.collect_list(F.struct("term", "coef"))).alias("p"))  # at most one entry a term
    rows = design(traj, basis).join(packed, "traj_id")
    return rows.select("traj_id", "seq", "eq", F.expr("aggregate(p, 0D, (a, x) -> a + x.coef * element_at(phi, CAST(x.term AS INT)))").alias("rhs"))


def allowed_terms(terms: DataFrame, stage: int) -> DataFrame:
    return terms.where(F.col("stage") <= stage)


def current_terms(terms: DataFrame, stage: int) -> DataFrame:
    return terms.where(F.col("stage") == stage)


def term_open(term: Column, eq: Column, state: Callable[[Column], Column], coherent: bool = True) -> Column:
    """May equation eq use the term (struct of stage and vars)? state(v) is variable v's equation: struct of stage and cap.

    A term's stage may not exceed the equation's. With coherence, a term of several variables also needs every other
    variable's equation at that stage, unless that equation's cap lies below it.
    """
    ready = state(eq)["stage"] >= term["stage"]
    if not coherent:
        return ready
    others = F.forall(term["vars"], lambda v: (v == eq) | (state(v)["stage"] >= term["stage"]) | F.coalesce(state(v)["cap"] < term["stage"], F.lit(False)))
    return ready & F.coalesce((F.size(term["vars"]) < 2) | others, F.lit(True))


def equation_terms(stages: DataFrame, terms: DataFrame, coherent: bool = True) -> DataFrame:
    """traj_id, eq, term: what each equation may use (term_open). stages: traj_id, eq, stage, cap (null: none)."""
    rows = _with_state(stages, ["traj_id"]).crossJoin(F.broadcast(terms))
    return rows.where(term_open(F.struct("stage", "vars"), F.col("eq"), lambda v: F.element_at("__all", v), coherent)).select("traj_id", "eq", "term")


def _with_state(stages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, eq and __all, the stages and caps of all equations by number. A window, as a join might be broadcast: what Spark
    thinks is small by the bytes of the files can be large in the driver."""
    every = F.map_from_entries(F.collect_list(F.struct("eq", F.struct("stage", "cap"))).over(Window.partitionBy(*by)))
    return stages.select(*by, "eq", every.alias("__all"))


def open_terms(basis: Sequence[Term], coherent: bool = True) -> Column:
    """equation_terms as an array of sorted term numbers for each equation, from array columns stages and caps."""
    known = F.array(*[F.struct(F.lit(t.idx).alias("term"), F.lit(t.stage).alias("stage"), F.array(*[F.lit(v) for v in t.vars]).alias("vars")) for t in basis])
    state = lambda v: F.struct(F.element_at("stages", v).alias("stage"), F.element_at("caps", v).alias("cap"))
    return F.transform(F.sequence(F.lit(1), F.size("stages")), lambda e: F.transform(F.filter(known, lambda t: term_open(t, e, state, coherent)), lambda t: t["term"]))


def coupling_audit(stages: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """traj_id, level, same: for each level up to the highest reachable one, whether coherence changes what is allowed.

    At a level every equation stands at min(level, cap or top).
    """
    limit = F.least(F.coalesce("cap", F.lit(top)), F.lit(top))
    at = stages.withColumn("__top", F.max(limit).over(Window.partitionBy("traj_id"))).withColumn("level", F.explode(F.sequence(F.lit(1), F.col("__top"))))
    at = at.select("traj_id", "level", "eq", F.least(F.col("level"), limit).alias("stage"), "cap")
    rows = _with_state(at, ["traj_id", "level"]).crossJoin(F.broadcast(terms))
    is_open = lambda coherent: term_open(F.struct("stage", "vars"), F.col("eq"), lambda v: F.element_at("__all", v), coherent)
    # coherence only removes terms, so equal counts are equal sets
    n = rows.where(is_open(False)).groupBy("traj_id", "level").agg(F.count_if(is_open(True)).alias("na"), F.count(F.lit(1)).alias("nb"))
    return n.select("traj_id", "level", (F.col("na") == F.col("nb")).alias("same"))


def prune(terms: DataFrame, keys: Sequence[str] = ("run_id", "eq"), absolute: float = 1e-6, relative: float = 1e-3) -> DataFrame:
    """Terms whose |coef| reaches max(absolute, relative * largest |coef| of the equation)."""
    top = F.max(F.abs("coef")).over(Window.partitionBy(*keys))
    return terms.withColumn("__top", top).where(F.abs("coef") >= F.greatest(F.lit(absolute), relative * F.col("__top"))).drop("__top")


def support_match(fitted: DataFrame, truth: DataFrame) -> DataFrame:
    """run_id, matched: every equation has the same set of terms on both sides, and both have the same equations."""
    side = lambda d, n: d.groupBy("run_id", "eq").agg(F.array_sort(F.collect_set("term")).alias(n))
    j = side(fitted, "a").join(side(truth, "b"), ["run_id", "eq"], "full")
    return j.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("matched"))


def classify_terms(df: DataFrame) -> DataFrame:
    """df (with a string column term) plus basis_term, stage and reason: one rule list, no shuffle."""
    core = core_term(F.col("term"))
    pair = F.concat(F.lit("u"), F.concat_ws("*u", F.transform(F.array_sort(F.transform(F.regexp_extract_all(core, F.lit(r"u(\d+)"), F.lit(1)), lambda x: x.cast("int"))), lambda x: x.cast("string"))))
    stage = term_stage(core)
    return df.select("*", F.when(stage == 3, pair).when(stage.isNotNull(), core).alias("basis_term"), stage.alias("stage"), gap_reason(core).alias("reason"))


def classify_systems(terms: DataFrame) -> DataFrame:
    """system_id, representability, expected_stage: exact without any gap; then the largest stage."""
    g = terms.groupBy("system_id").agg(F.bool_and(F.col("reason").isNull()).alias("ok"), F.max("stage").alias("s"))
    return g.select("system_id", F.when(F.col("ok"), "exact").otherwise("surrogate").alias("representability"), F.when(F.col("ok"), F.coalesce("s", F.lit(0))).alias("expected_stage"))


def classification_summary(terms: DataFrame) -> DataFrame:
    """kind, value, n: systems by class and by expected stage, terms by gap reason."""
    s = classify_systems(terms)
    parts = [
        s.groupBy(F.col("representability").alias("value")).count().withColumn("kind", F.lit("class")),
        s.where("expected_stage is not null").groupBy(F.col("expected_stage").cast("string").alias("value")).count().withColumn("kind", F.lit("stage")),
        terms.where("reason is not null").groupBy(F.col("reason").alias("value")).count().withColumn("kind", F.lit("gap")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "value", F.col("count").alias("n"))


def class_breakdown(terms: DataFrame, dims: DataFrame) -> DataFrame:
    """dim, exact, surrogate: systems per dimension and class (dims: system_id, dim)."""
    return classify_systems(terms).join(dims, "system_id").groupBy("dim").agg(F.count_if(F.col("representability") == "exact").alias("exact"), F.count_if(F.col("representability") == "surrogate").alias("surrogate"))


def validate_truth(derived: DataFrame, truth: DataFrame) -> DataFrame:
    """system_id, agrees, missing, extra: derived support against hand-entered support (arrays of term names)."""
    j = derived.select("system_id", F.col("terms").alias("a")).join(truth.select("system_id", F.col("terms").alias("b")), "system_id", "full")
    a, b = F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>"))
    return j.select("system_id", (F.array_sort(a) == F.array_sort(b)).alias("agrees"), F.size(F.array_except(b, a)).alias("missing"), F.size(F.array_except(a, b)).alias("extra"))


def expected_stage(support: DataFrame, terms: DataFrame, per: Sequence[str] = ("run_id", "eq")) -> DataFrame:
    """Largest stage of the terms of each support."""
    return support.join(F.broadcast(terms.select("term", "stage")), "term").groupBy(*per).agg(F.max("stage").alias("expected_stage"))


def splits(traj: DataFrame) -> DataFrame:
    """traj_id, seq, split, role: A holds out the last 30 %, B the first, C the middle, D the second and fourth quarters."""
    n = F.count(F.lit(1)).over(Window.partitionBy("traj_id"))
    k, m, q = F.floor(n * 0.3), F.floor(n * 0.35), (F.floor(n * 0.25), F.floor(n * 0.5), F.floor(n * 0.75))
    s = F.col("seq")
    held = {"A": s > n - k, "B": s <= k, "C": (s > m) & (s <= n - m), "D": ((s > q[0]) & (s <= q[1])) | (s > q[2])}
    rows = traj.select("traj_id", "seq", *[h.alias(f"__{x}") for x, h in held.items()])
    pairs = F.array(*[F.struct(F.lit(x).alias("split"), F.when(F.col(f"__{x}"), "holdout").otherwise("fit").alias("role")) for x in held])
    return rows.select("traj_id", "seq", F.explode(pairs).alias("p")).select("traj_id", "seq", "p.split", "p.role")
