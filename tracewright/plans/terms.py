"""Queries over term libraries and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import structures as S
from tracewright.operators import terms as T

from .derivatives import r
from .views import Views, oracle

B2 = T.staged_basis(2)
NAMES = {t.idx: t.name for t in B2}
#: Expanded terms of all kinds, one per part by its key.
TERMS = ["u1", "2.5*u2^2", "u2*u1", "u1^3", "sin(u1)", "-3*cos(u2)", "4", "exp(u1)", "sin(2*u1)", "u1^2*u2", "u2^4", "u1*u2*u3", "u1*exp(u2)", "u3"]
#: Systems of two thirds of the sizes hold library terms only.
MONO_SQL = "SELECT p_size AS system_id, p_partkey % 3 + 1 AS eq, CASE CASE WHEN p_size % 3 = 0 THEN p_partkey % 14 ELSE p_partkey % 14 % 6 END " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TERMS)) + " END AS term FROM part"
NAME_SQL = "CASE term " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in NAMES.items()) + " END"
STAGE_SQL = "CASE " + " ".join(f"WHEN term IN ({', '.join(str(t.idx) for t in B2 if t.stage == s)}) THEN {s}" for s in range(1, 6)) + " END"


def monomials(v: Views) -> DataFrame:
    k = F.col("p_partkey") % len(TERMS)
    k = F.when(F.col("p_size") % 3 == 0, k).otherwise(k % 6)
    term = F.element_at(F.array(*[F.lit(t) for t in TERMS]), (k + 1).cast("int"))
    return v.part.select(F.col("p_size").alias("system_id"), (F.col("p_partkey") % 3 + 1).alias("eq"), term.alias("term"))


def libraries(v: Views) -> DataFrame:
    """The staged library of every cell, by the cell's dimension."""
    cells = v.level_events.select("cell", "dim").distinct()
    each = F.array(*[F.array(*[F.struct(F.lit(t.idx).alias("term"), F.lit(t.name).alias("name"), F.lit(t.stage).alias("stage")) for t in T.staged_basis(d)]) for d in range(1, 5)])
    return cells.select("cell", "dim", F.inline(F.element_at(each, F.col("dim").cast("int"))))


#: The same by rule: five stages over the variables 1 to dim.
LIBRARY_SQL = {
    "ce": "SELECT DISTINCT cell, dim FROM level_events",
    "vi": "SELECT cell, dim, unnest(range(1, dim + 1)) AS i FROM ce",
    "nm": "SELECT cell, dim, 1 AS stage, i AS a, 0 AS b, 'u' || i AS name FROM vi UNION ALL SELECT cell, dim, 2, i, 0, 'u' || i || '^2' FROM vi UNION ALL SELECT x.cell, x.dim, 3, x.i, y.i, 'u' || x.i || '*u' || y.i FROM vi x JOIN vi y ON x.cell = y.cell AND x.i < y.i "
    "UNION ALL SELECT cell, dim, 4, i, 0, 'u' || i || '^3' FROM vi UNION ALL SELECT cell, dim, 5, i, 1, 'sin(u' || i || ')' FROM vi UNION ALL SELECT cell, dim, 5, i, 2, 'cos(u' || i || ')' FROM vi",
}


def stages_of(v: Views) -> DataFrame:
    """An equation state per customer: two equations with stages and caps."""
    c = v.customer.select(F.col("c_custkey").alias("traj_id"))
    both = F.array(F.struct(F.lit(1).alias("eq"), (F.col("traj_id") % 5 + 1).cast("int").alias("stage"), F.when(F.col("traj_id") % 3 == 0, 2).alias("cap")), F.struct(F.lit(2).alias("eq"), (F.col("traj_id") % 4 + 1).cast("int").alias("stage"), F.when(F.col("traj_id") % 7 == 0, 1).alias("cap")))
    return c.select("traj_id", F.explode(both).alias("x")).select("traj_id", "x.*")


STATE_SQL = "SELECT c_custkey AS traj_id, 1 AS eq, c_custkey % 5 + 1 AS stage, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS cap FROM customer UNION ALL SELECT c_custkey, 2, c_custkey % 4 + 1, CASE WHEN c_custkey % 7 = 0 THEN 1 END FROM customer"
TERM_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({t.idx}, '{t.name}', {t.stage}, {list(t.vars)})" for t in B2) + ") x(term, name, tstage, vars)"


def rendered(v: Views) -> DataFrame:
    """run_id, eq, line: the structures as text."""
    named = v.structure_terms.join(F.broadcast(T.terms_table(v.spark, B2).select("term", "name")), "term")
    g = named.groupBy("run_id", "eq").agg(F.array_sort(F.collect_list(F.struct("term", "name", "coef"))).alias("t"))
    return g.select("run_id", "eq", S.format_equation(F.col("eq"), F.col("t")).alias("line"))


LINES = {"nm": f"SELECT run_id, eq, term, coef, {NAME_SQL} AS name FROM structure_terms", "ln": "SELECT run_id, eq, 'du_' || eq || ' = ' || string_agg(printf('(%.4f)*%s', coef, name), ' + ' ORDER BY term) AS line FROM nm GROUP BY run_id, eq"}
PRUNED = "SELECT run_id, eq, term, coef FROM (SELECT *, max(abs(coef)) OVER (PARTITION BY run_id, eq) AS m FROM structure_terms) x WHERE abs(coef) >= greatest(1e-6, 0.001e0 * m)"
SETS = "SELECT run_id, eq, list_sort(list(DISTINCT term)) AS s FROM {} GROUP BY run_id, eq"
CLASSED = (
    "SELECT *, regexp_replace(term, '^-?[0-9]+(\\.[0-9]+)?\\*', '') AS core FROM mo",
    "SELECT *, CASE WHEN core IN ('u1','u2','u3') THEN 1 WHEN core = 'u2^2' THEN 2 WHEN core = 'u2*u1' THEN 3 WHEN core = 'u1^3' THEN 4 WHEN core IN ('sin(u1)','cos(u2)') THEN 5 END AS stage, "
    "CASE core WHEN '4' THEN 'constant_offset' WHEN 'exp(u1)' THEN 'unsupported_function' WHEN 'u1*exp(u2)' THEN 'unsupported_function' WHEN 'sin(2*u1)' THEN 'unsupported_trigonometric_argument' WHEN 'u1^2*u2' THEN 'mixed_higher_order_term' "
    "WHEN 'u1*u2*u3' THEN 'mixed_higher_order_term' WHEN 'u2^4' THEN 'unsupported_power' END AS reason FROM c0",
)
CL = {"mo": MONO_SQL, "c0": CLASSED[0], "cl": CLASSED[1], "sy": "SELECT system_id, bool_and(reason IS NULL) AS ok, max(stage) AS s FROM cl GROUP BY system_id"}
SPLIT_SQL = (
    "SELECT traj_id, seq, n, unnest([{'split': 'A', 'h': seq > n - floor(n * 0.3e0)}, {'split': 'B', 'h': seq <= floor(n * 0.3e0)}, {'split': 'C', 'h': seq > floor(n * 0.35e0) AND seq <= n - floor(n * 0.35e0)}, "
    "{'split': 'D', 'h': (seq > floor(n * 0.25e0) AND seq <= floor(n * 0.5e0)) OR seq > floor(n * 0.75e0)}]) AS x FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM traj_events) y"
)
EQT = "FROM st JOIN tm ON tstage <= stage"
COHERENT = " AND NOT EXISTS (SELECT 1 FROM st o WHERE o.traj_id = st.traj_id AND len(vars) > 1 AND list_contains(vars, o.eq) AND o.eq <> st.eq AND o.stage < tstage AND NOT coalesce(o.cap < tstage, false))"
LEVELS = {
    "st0": STATE_SQL, "tm": TERM_ROWS, "tops": "SELECT traj_id, max(least(coalesce(cap, 5), 5)) AS top FROM st0 GROUP BY traj_id",
    "st": "SELECT traj_id || '-' || level AS traj_id, st0.traj_id AS tid, level, eq, least(level, least(coalesce(cap, 5), 5)) AS stage, cap FROM (SELECT traj_id, unnest(range(1, top + 1)) AS level FROM tops) l JOIN st0 USING (traj_id)",
}


def _pruned_match(v: Views) -> DataFrame:
    """Pruned supports against the unpruned ones of the run before."""
    t = v.structure_terms
    return T.support_match(T.prune(t), t.where("coef <> 0"))


QUERIES = {
    "p01_staged_basis": (libraries, oracle("SELECT cell, dim, CAST(row_number() OVER (PARTITION BY cell ORDER BY stage, a, b) AS INT) AS term, name, stage FROM nm", "level_events", **LIBRARY_SQL)),
    "p02_flat_basis": (
        lambda v: r(v.traj_events.select("traj_id", "seq", *[t.column().alias(f"f{t.idx}") for t in T.flat_basis(0, ["u1", "u2"])]), n=9),
        oracle("SELECT traj_id, seq, round(u1, 9) AS f1, round(u2, 9) AS f2, round(u1 * u1, 9) AS f3, round(u2 * u2, 9) AS f4, round(u1 * u2, 9) AS f5 FROM traj_events", "traj_events"),
    ),
    "p03_design": (
        lambda v: T.design(v.traj_events, B2).groupBy("traj_id").agg(*[F.round(F.sum(F.col("phi")[i]), 6).alias(f"s{i + 1}") for i in range(11)]),
        oracle("SELECT traj_id, " + ", ".join(f"round(sum({e}), 6) AS s{i + 1}" for i, e in enumerate(["u1", "u2", "u1*u1", "u2*u2", "u1*u2", "u1*u1*u1", "u2*u2*u2", "sin(u1)", "cos(u1)", "sin(u2)", "cos(u2)"])) + " FROM traj_events GROUP BY traj_id", "traj_events"),
    ),
    "p04_eval_rhs": (
        lambda v: r(T.eval_rhs(v.traj_events, B2, v.structure_terms.withColumnRenamed("run_id", "traj_id"))),
        oracle("SELECT traj_id, seq, eq, round(sum(coef * list_extract([u1, u2, u1*u1, u2*u2, u1*u2, u1*u1*u1, u2*u2*u2, sin(u1), cos(u1), sin(u2), cos(u2)], term)), 6) + 0e0 AS rhs FROM traj_events JOIN structure_terms ON run_id = traj_id GROUP BY traj_id, seq, eq", "traj_events", "structure_terms"),
    ),
    "p05_allowed_terms": (
        lambda v: v.structure_terms.join(F.broadcast(T.allowed_terms(T.terms_table(v.spark, B2), 2)), "term").groupBy("name").agg(F.count(F.lit(1)).alias("n")),
        oracle(f"SELECT {NAME_SQL} AS name, count(*) AS n FROM structure_terms WHERE {STAGE_SQL} <= 2 GROUP BY 1", "structure_terms"),
    ),
    "p05_current_terms": (
        lambda v: v.structure_terms.join(F.broadcast(T.current_terms(T.terms_table(v.spark, B2), 5)), "term").groupBy("name").agg(F.count(F.lit(1)).alias("n")),
        oracle(f"SELECT {NAME_SQL} AS name, count(*) AS n FROM structure_terms WHERE {STAGE_SQL} = 5 GROUP BY 1", "structure_terms"),
    ),
    "p06_equation_terms": (lambda v: T.equation_terms(stages_of(v), T.terms_table(v.spark, B2)), oracle(f"SELECT st.traj_id, st.eq, term {EQT}{COHERENT}", st=STATE_SQL, tm=TERM_ROWS)),
    "p07_term_vars": (lambda v: monomials(v).groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", "n", F.array_join(F.transform(S.term_vars(F.col("term")), lambda x: x.cast("string")), ",").alias("vars")), oracle("SELECT term, count(*) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(term, 'u(\\d+)', 1))), ',') AS vars FROM mo GROUP BY term", mo=MONO_SQL)),
    "p08_uses_terms": (
        lambda v: v.structure_terms.groupBy("run_id").agg(F.collect_list("term").alias("t")).select("run_id", S.uses_terms(F.array("t"), [8, 9, 10, 11]).alias("uses")),
        oracle("SELECT run_id, bool_or(term IN (8, 9, 10, 11)) AS uses FROM structure_terms GROUP BY run_id", "structure_terms"),
    ),
    "p09_format_structure": (rendered, oracle("SELECT run_id, eq, line FROM ln", "structure_terms", **LINES)),
    "p10_parse_structure": (
        lambda v: rendered(v).select("run_id", S.equation_number(F.col("line")).alias("eq"), F.explode(S.parse_equation(F.col("line"))).alias("x")).select("run_id", "eq", "x.name", "x.coef"),
        oracle("SELECT run_id, eq, name, CAST(printf('%.4f', coef) AS DOUBLE) AS coef FROM nm", "structure_terms", **LINES),
    ),
    "p11_prune": (lambda v: T.prune(v.structure_terms).select("run_id", "eq", "term", "coef"), oracle(PRUNED, "structure_terms")),
    "p12_support_match": (
        lambda v: T.support_match(v.structure_terms, v.structure_terms.withColumn("run_id", F.col("run_id") - 1)),
        oracle("SELECT coalesce(a.run_id, b.run_id) AS run_id, bool_and(coalesce(a.s = b.s, false)) AS matched FROM a FULL JOIN b ON a.run_id = b.run_id AND a.eq = b.eq GROUP BY 1", "structure_terms", a=SETS.format("structure_terms"), t2="SELECT run_id - 1 AS run_id, eq, term FROM structure_terms", b=SETS.format("t2")),
    ),
    "p13_support_match_pruned": (
        _pruned_match,
        oracle("SELECT coalesce(a.run_id, b.run_id) AS run_id, bool_and(coalesce(a.s = b.s, false)) AS matched FROM a FULL JOIN b ON a.run_id = b.run_id AND a.eq = b.eq GROUP BY 1", "structure_terms", pr=PRUNED, nz="SELECT * FROM structure_terms WHERE coef <> 0", a=SETS.format("pr"), b=SETS.format("nz")),
    ),
    "p14_classify_terms": (lambda v: T.classify_terms(monomials(v)), oracle("SELECT system_id, eq, term, CASE WHEN stage = 3 THEN 'u1*u2' WHEN stage IS NOT NULL THEN core END AS basis_term, stage, reason FROM cl", **CL)),
    "p15_classify_systems": (lambda v: T.classify_systems(T.classify_terms(monomials(v))), oracle("SELECT system_id, CASE WHEN ok THEN 'exact' ELSE 'surrogate' END AS representability, CASE WHEN ok THEN coalesce(s, 0) END AS expected_stage FROM sy", **CL)),
    "p16_classification_summary": (
        lambda v: T.classification_summary(T.classify_terms(monomials(v))),
        oracle("SELECT 'class' AS kind, CASE WHEN ok THEN 'exact' ELSE 'surrogate' END AS value, count(*) AS n FROM sy GROUP BY 2 UNION ALL SELECT 'stage', CAST(s AS VARCHAR), count(*) FROM sy WHERE ok GROUP BY 2 UNION ALL SELECT 'gap', reason, count(*) FROM cl WHERE reason IS NOT NULL GROUP BY 2", **CL),
    ),
    "p16_class_breakdown": (
        lambda v: T.class_breakdown(T.classify_terms(monomials(v)), v.part.select(F.col("p_size").alias("system_id"), (F.col("p_size") % 4 + 1).alias("dim")).distinct()),
        oracle("SELECT system_id % 4 + 1 AS dim, count(*) FILTER (ok) AS exact, count(*) FILTER (NOT ok) AS surrogate FROM sy GROUP BY 1", **CL),
    ),
    "p17_validate_truth": (
        lambda v: T.validate_truth(T.classify_terms(monomials(v)).groupBy("system_id").agg(F.collect_set("basis_term").alias("terms")), T.classify_terms(monomials(v)).where("eq < 3").groupBy("system_id").agg(F.collect_set("basis_term").alias("terms"))),
        oracle("SELECT system_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS agrees, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS missing, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS extra FROM (SELECT system_id, coalesce(list(DISTINCT t) FILTER (t IS NOT NULL), []) AS a, coalesce(list(DISTINCT t) FILTER (eq < 3 AND t IS NOT NULL), []) AS b FROM (SELECT *, CASE WHEN stage = 3 THEN 'u1*u2' WHEN stage IS NOT NULL THEN core END AS t FROM cl) q GROUP BY system_id) z", **CL),
    ),
    "p18_expected_stage": (lambda v: T.expected_stage(v.structure_terms, T.terms_table(v.spark, B2)), oracle(f"SELECT run_id, eq, max({STAGE_SQL}) AS expected_stage FROM structure_terms GROUP BY run_id, eq", "structure_terms")),
    "p18_expected_stage_run": (lambda v: T.expected_stage(v.structure_terms, T.terms_table(v.spark, B2), ["run_id"]), oracle(f"SELECT run_id, max({STAGE_SQL}) AS expected_stage FROM structure_terms GROUP BY run_id", "structure_terms")),
    "p19_splits": (lambda v: T.splits(v.traj_events), oracle("SELECT traj_id, seq, x.split AS split, CASE WHEN x.h THEN 'holdout' ELSE 'fit' END AS role FROM sp", "traj_events", sp=SPLIT_SQL)),
    "p20_coupling_audit": (
        lambda v: T.coupling_audit(stages_of(v), T.terms_table(v.spark, B2), 5),
        oracle("SELECT tid AS traj_id, level, coalesce(na, 0) = nb AS same FROM bb LEFT JOIN aa USING (tid, level)", **LEVELS, aa=f"SELECT st.tid, st.level, count(*) AS na {EQT}{COHERENT} GROUP BY 1, 2", bb=f"SELECT st.tid, st.level, count(*) AS nb {EQT} GROUP BY 1, 2"),
    ),
}
