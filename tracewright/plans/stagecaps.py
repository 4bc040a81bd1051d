"""Queries over look-ahead stage caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import stagecaps as C
from tracewright.operators import terms as T

from .derivatives import EV, r
from .views import Views, oracle

B2 = T.staged_basis(2)
POL = C.CapPolicy(tau_rel=1e-3, tau_abs=1e-5)
INF = "'Infinity'::DOUBLE"


def table(v: Views) -> DataFrame:
    """Stage residuals as a stage table with one equation; stages that are missing are empty."""
    return v.stage_residuals.select("traj_id", F.lit(1).alias("eq"), "split", "stage", "residual", "floor_ms", "usable")


def decisions(v: Views) -> DataFrame:
    return C.decide(table(v), C.policy_struct(POL))


def stored(v: Views) -> DataFrame:
    """Made decisions for votes that any engine can repeat."""
    k = F.col("traj_id") * 7 + F.col("split") * 3
    kind = F.when(k % 5 == 0, "invalid").when(k % 7 == 0, "undecidable").otherwise("positive")
    d = v.stage_residuals.select("traj_id", "split").distinct().select("traj_id", F.lit(1).alias("eq"), "split", kind.alias("kind"), ((F.col("traj_id") + F.floor(F.col("split") / 3)) % 3 + 1).cast("int").alias("stage"))
    return d.withColumn("cap", F.when(F.col("kind") == "positive", F.col("stage")))


STORED = "SELECT *, CASE WHEN kind = 'positive' THEN stage END AS cap FROM (SELECT DISTINCT traj_id, 1 AS eq, split, CASE WHEN (traj_id * 7 + split * 3) % 5 = 0 THEN 'invalid' WHEN (traj_id * 7 + split * 3) % 7 = 0 THEN 'undecidable' ELSE 'positive' END AS kind, CAST((traj_id + floor(split / 3)) % 3 + 1 AS INT) AS stage FROM stage_residuals) q"
VOTE = {
    "majority": "SELECT g.traj_id, 1 AS eq, (SELECT min(c.cap) FROM (SELECT cap, count(*) AS k FROM d WHERE d.traj_id = g.traj_id AND cap IS NOT NULL GROUP BY cap) c WHERE c.k > g.n / 2 AND (g.b IS NULL OR g.b > c.cap)) AS cap FROM g",
    "unanimous": "SELECT traj_id, 1 AS eq, CASE WHEN pos = n AND (b IS NULL OR b > med) THEN med END AS cap FROM g",
    "any_positive": "SELECT traj_id, 1 AS eq, CASE WHEN b IS NULL OR b > lo THEN lo END AS cap FROM g",
}
G = {"d": STORED, "g": "SELECT traj_id, count(*) FILTER (kind <> 'invalid') AS n, count(*) FILTER (kind = 'positive') AS pos, min(stage) FILTER (kind = 'undecidable') AS b, min(cap) AS lo, quantile_disc(cap, 0.5) AS med FROM d GROUP BY traj_id"}
NXT = "SELECT *, lead(stage) OVER w AS ns, lead(residual) OVER w AS nr, lead(usable) OVER w AS nu FROM stage_residuals WINDOW w AS (PARTITION BY traj_id, split ORDER BY stage)"
GRID = [(a, b) for a in (1e-4, 1e-3, 1e-2, 1e-1) for b in (1e-8, 1e-6, 1e-4, 1e-3, 1e-2)]
GRID_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in GRID) + ") x(tau_rel, tau_abs)"
TG = {"nx": NXT, "gr": GRID_SQL, "tg": f"SELECT traj_id, split, tau_rel, tau_abs, coalesce(max(ns) FILTER (usable AND nu AND residual - nr > tau_abs AND CASE WHEN residual = 0 THEN {INF} ELSE (residual - nr) / residual END > tau_rel), 1) AS useful FROM nx, gr GROUP BY 1, 2, 3, 4"}
EXP = "SELECT DISTINCT traj_id, CAST(traj_id % 5 + 1 AS INT) AS expected FROM stage_residuals"
#: Caps by horizon made from keys: what an audit reads.
CAPS_SQL = "SELECT h AS horizon, s_suppkey AS traj_id, 1 AS eq, CASE WHEN (s_suppkey + h) % 4 = 0 THEN NULL ELSE CAST((s_suppkey * h) % 5 + 1 AS INT) END AS cap, CAST(s_suppkey % 3 + 1 AS INT) AS true_stage FROM supplier, (VALUES (1), (2), (3), (5)) v(h)"
GAIN = "isfinite(residual) AND isfinite(nr) AND residual > floor_ms AND residual - nr > floor_ms AND CASE WHEN residual = 0 THEN 'Infinity'::DOUBLE ELSE (residual - nr) / residual END > 1e-3 AND (nr <= floor_ms OR residual - nr > 1e-5)"


def grid(v: Views) -> DataFrame:
    return C.threshold_grid(v.stage_residuals, v.spark.createDataFrame(GRID, "tau_rel double, tau_abs double"))


def expected(v: Views) -> DataFrame:
    return v.stage_residuals.select("traj_id", (F.col("traj_id") % 5 + 1).cast("int").alias("expected")).distinct()


def caps(v: Views) -> DataFrame:
    h = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 5)]))
    s = v.supplier.select(h.alias("horizon"), F.col("s_suppkey").alias("traj_id"))
    return s.select("horizon", "traj_id", F.lit(1).alias("eq"), F.when((F.col("traj_id") + F.col("horizon")) % 4 != 0, (F.col("traj_id") * F.col("horizon") % 5 + 1).cast("int")).alias("cap"), (F.col("traj_id") % 3 + 1).cast("int").alias("true_stage"))


def at(v: Views, h: int) -> DataFrame:
    return caps(v).where(F.col("horizon") == h)


def pair(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("traj_id", "split").orderBy("stage")
    return v.stage_residuals.select("*", F.lead("residual").over(w).alias("nr"), F.lead("stage").over(w).alias("ns"))


def arrays(v: Views) -> DataFrame:
    g = v.stage_residuals.groupBy("traj_id", "split").agg(F.array_sort(F.collect_list(F.struct("stage", "residual", "floor_ms"))).alias("s"))
    return g.select("traj_id", "split", F.col("s.residual").alias("res"), F.transform("s.residual", lambda x: x * 1.05).alias("fl"), F.posexplode("s.stage").alias("p", "stage")).withColumn("p", F.col("p") + 1)


CLASS = "CASE WHEN cap IS NULL THEN '{}' WHEN cap < true_stage THEN '{}' WHEN cap = true_stage THEN '{}' ELSE '{}' END"
DERIVED = {
    "t": "SELECT *, stage % 4 = 3 AND residual > 0.03 AS deficient FROM stage_residuals",
    "u": "SELECT *, usable AND NOT deficient AS good FROM t",
    "x": "SELECT *, min(CAST(good AS INT)) OVER w AS pre, lead(stage) OVER w AS ns, lead(residual) OVER w AS nr, lead(good) OVER w AS ng FROM u WINDOW w AS (PARTITION BY traj_id, split ORDER BY stage)",
    "s": "SELECT traj_id, split, max(ns) FILTER (pre = 1 AND ng AND residual > floor_ms AND residual - nr > 1e-5 AND CASE WHEN residual = 0 THEN 'Infinity'::DOUBLE ELSE (residual - nr) / residual END > 1e-3 AND residual - nr > floor_ms) AS m, bool_or(stage = 1 AND good) AS starts, bool_or(stage = 1 AND deficient) AS poor FROM x GROUP BY 1, 2",
    "pr": "SELECT traj_id, CASE WHEN count(*) FILTER (starts) > 0 THEN CAST(quantile_disc(coalesce(m, 1), 0.5) FILTER (starts) AS VARCHAR) WHEN bool_or(poor) THEN 'rank_deficient' ELSE 'invalid_or_inconclusive' END AS predicted FROM s GROUP BY 1",
    "ex": EXP,
}


def derived(v: Views) -> DataFrame:
    t = v.stage_residuals.withColumn("deficient", (F.col("stage") % 4 == 3) & (F.col("residual") > 0.03))
    return C.derived_stage(t, 1e-3, 1e-5, "floor_gated")


def loso(v: Views) -> DataFrame:
    p = v.part.select((F.col("p_size") % 6).alias("grp"), (F.col("p_partkey") % 4 / 4).alias("drop_ratio"), (F.col("p_partkey") % 3 / 10).alias("floor_ratio"), F.when((F.col("p_partkey") % 4 == 3) & (F.col("p_size") % 5 == 0), "wrong_commit").when(F.col("p_size") % 4 == 0, "abstain").otherwise("correct_commit").alias("verdict"))
    return C.loso_thresholds(p)


LOSO = {
    "p": "SELECT p_size % 6 AS grp, p_partkey % 4 / 4 AS drop_ratio, p_partkey % 3 / 10 AS floor_ratio, CASE WHEN p_partkey % 4 = 3 AND p_size % 5 = 0 THEN 'wrong_commit' WHEN p_size % 4 = 0 THEN 'abstain' ELSE 'correct_commit' END AS verdict FROM part",
    "h": "SELECT DISTINCT grp FROM p",
    "c": "SELECT h.grp, drop_ratio, floor_ratio, count(*) FILTER (verdict = 'wrong_commit') AS w, count(*) FILTER (verdict = 'abstain') AS a, count(*) FILTER (verdict = 'correct_commit') AS k FROM h JOIN p ON p.grp <> h.grp GROUP BY 1, 2, 3",
    "o": "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY a, k DESC, drop_ratio, floor_ratio) AS rn FROM c WHERE w = 0",
}


def walk(factors: tuple[float, ...] = (1.0,), pairs: list[tuple[float, float]] | None = None, policy: C.CapPolicy = POL) -> dict[str, str]:
    """Steps that follow every split's exits: mv has where each position leads, wk the walk, one per scaled threshold (or
    pair of thresholds)."""
    grid = ", ".join(f"({i}, {policy.tau_rel * a!r}::DOUBLE, {policy.tau_abs * b!r}::DOUBLE)" for i, (a, b) in enumerate(pairs or [(f, f) for f in factors]))
    gain = "cur > f AND cur - res[q] > f AND CASE WHEN cur = 0 THEN 'Infinity'::DOUBLE ELSE (cur - res[q]) / cur END > tr AND (res[q] <= f OR cur - res[q] > ta)"
    return {
        "ls": "SELECT traj_id, split, list(residual ORDER BY stage) AS res, list(floor_ms ORDER BY stage) AS fl, list(usable ORDER BY stage) AS us, list(stage ORDER BY stage) AS st FROM stage_residuals GROUP BY ALL",
        "ps": "SELECT *, len(st) AS m, unnest(range(1, len(st) + 1)) AS p FROM ls",
        "pc": "SELECT *, res[p] AS cur, fl[p] AS f, list_min(res[p + 1:]) AS later, p = m OR us[p + 1] AS succ FROM ps",
        "pf": f"SELECT *, CASE WHEN cur > f THEN 'not_applicable' WHEN cur <= 0 OR f <= 0 OR cur / f < {POL.floor_ratio!r}::DOUBLE OR p = m THEN 'no_clear_drop' WHEN later / cur <= {POL.drop_ratio!r}::DOUBLE THEN 'clear_drop' ELSE 'no_clear_drop' END AS after FROM pc",
        "fx": f"SELECT pf.*, x.policy, x.ta, list_min([q FOR q IN range(p + 1, least(p + {POL.horizon}, m) + 1) IF NOT us[q] OR ({gain})]) AS nxt, list_max([abs(r) FOR r IN res[p:]]) <= ta AS faint FROM pf, (VALUES {grid}) x(policy, tr, ta)",
        "mv": "SELECT traj_id, split, policy, p, st, gained, CASE WHEN NOT us[p] THEN {'q': 0, 'kind': 'invalid', 'stage': st[p], 'branch': 'usability'} "
        "WHEN cur <= f THEN CASE WHEN gained AND after = 'clear_drop' THEN {'q': p + 1, 'kind': '', 'stage': 0, 'branch': ''} WHEN gained AND after = 'no_clear_drop' AND succ THEN {'q': 0, 'kind': 'positive', 'stage': st[p], 'branch': 'floor_after_gain'} "
        "ELSE {'q': 0, 'kind': 'undecidable', 'stage': st[p], 'branch': 'floor_doubt_band'} END "
        "WHEN p = m THEN {'q': 0, 'kind': CASE WHEN gained THEN 'positive' ELSE 'undecidable' END, 'stage': st[p], 'branch': 'horizon_exhausted'} "
        "WHEN nxt IS NULL THEN CASE WHEN NOT gained AND faint THEN {'q': 0, 'kind': 'undecidable', 'stage': st[p], 'branch': 'uninformative_without_gain'} WHEN succ THEN {'q': 0, 'kind': 'positive', 'stage': st[p], 'branch': 'gain_search_exhausted'} "
        "ELSE {'q': 0, 'kind': 'invalid', 'stage': st[p + 1], 'branch': 'successor_usability'} END "
        "WHEN NOT us[nxt] THEN {'q': 0, 'kind': 'invalid', 'stage': st[nxt], 'branch': 'usability'} ELSE {'q': nxt, 'kind': '', 'stage': 0, 'branch': ''} END AS x FROM fx, (VALUES (false), (true)) g(gained)",
        "wk": "SELECT traj_id, split, policy, CAST(1 AS BIGINT) AS p, false AS gained, '' AS kind, 0 AS stage, '' AS branch FROM ls, (SELECT DISTINCT policy FROM mv) o UNION ALL "
        "SELECT w.traj_id, w.split, w.policy, x.q, x.q > 0, x.kind, x.stage, x.branch FROM wk w JOIN mv USING (traj_id, split, policy, p, gained) WHERE w.kind = ''",
        "dc": "SELECT traj_id, 1 AS eq, split, policy, kind, CASE WHEN kind = 'positive' THEN stage END AS cap, stage, branch FROM wk WHERE kind <> ''",
    }


TRACE = "SELECT traj_id, split, string_agg('stage ' || st[p] || ': ' || fresh || ', after a gain: ' || late, '; ' ORDER BY p) AS trace FROM (SELECT traj_id, split, p, st, max(w) FILTER (NOT gained) AS fresh, max(w) FILTER (gained) AS late FROM (SELECT *, CASE WHEN x.q > 0 THEN 'to ' || st[x.q] ELSE x.kind || ' at ' || x.stage END AS w FROM mv) y GROUP BY ALL) z GROUP BY ALL"
EVENTS = "SELECT traj_id, 1 AS eq, split, st[p] AS stage, CASE WHEN cur > 0 THEN later / cur END AS later_ratio, CASE WHEN f > 0 THEN cur / f END AS floor_ratio, after AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, split ORDER BY p) AS rn FROM pf WHERE cur <= f) q WHERE rn = 1"
SENSE = {
    "gs": "SELECT traj_id, policy, count(*) FILTER (kind <> 'invalid') AS n, min(stage) FILTER (kind = 'undecidable') AS b FROM dc GROUP BY ALL",
    "cs": "SELECT traj_id, policy, cap, count(*) AS k FROM dc WHERE cap IS NOT NULL GROUP BY ALL",
    "vs": "SELECT g.traj_id, g.policy, (SELECT min(c.cap) FROM cs c WHERE c.traj_id = g.traj_id AND c.policy = g.policy AND c.k > g.n / 2 AND (g.b IS NULL OR g.b > c.cap)) AS cap FROM gs g",
}

PAIRS = [(a, b) for a in (0.1, 1.0, 100.0) for b in (0.1, 10.0, 1000.0)]
#: Caps and the branch of most splits under each pair of scaled thresholds.
GRIDDED = {
    **walk(pairs=PAIRS), **SENSE,
    "pp": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(PAIRS)) + ") x(policy, rel_factor, abs_factor)",
    "br": "SELECT traj_id, policy, branch FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, policy ORDER BY n DESC, branch) AS rn FROM (SELECT traj_id, policy, branch, count(*) AS n FROM dc GROUP BY ALL) q) z WHERE rn = 1",
    "sg": "SELECT traj_id, 1 AS eq, rel_factor, abs_factor, cap, branch FROM vs JOIN br USING (traj_id, policy) JOIN pp USING (policy)",
}


def gridded(v: Views) -> DataFrame:
    return C.sensitivity(table(v), (0.1, 1.0, 100.0), (0.1, 10.0, 1000.0), POL)


QUERIES = {
    "c01_stage_table": (lambda v: r(C.stage_table(v.traj_events, B2, EV, C.CapPolicy()).select("traj_id", "eq", "split", "stage", F.when(F.col("usable"), F.col("residual")).alias("residual"), "floor_ms", "usable", "rank"), n=4), None),
    "c02_counts_gain": (
        lambda v: pair(v).select("traj_id", "split", "stage", F.coalesce(C.counts_gain(F.col("residual"), F.col("nr"), F.col("floor_ms"), F.lit(1e-3), F.lit(1e-5)), F.lit(False)).alias("gain")),
        oracle(f"SELECT traj_id, split, stage, coalesce({GAIN}, false) AS gain FROM nx", "stage_residuals", nx=NXT),
    ),
    "c03_counts_gain_rules": (
        lambda v: pair(v).where("nr is not null").select("traj_id", "split", "stage", *[C.counts_gain_rule(F.lit(x), F.col("residual"), F.col("nr"), F.col("floor_ms"), F.lit(0.05), F.lit(1e-3)).alias(x) for x in ("threshold_only", "floor_gated")]),
        oracle("SELECT traj_id, split, stage, g AS threshold_only, g AND residual > floor_ms AND residual - nr > floor_ms AS floor_gated FROM (SELECT *, residual - nr > 1e-3 AND (residual - nr) / residual > 0.05e0 AS g FROM nx WHERE nr IS NOT NULL) q", "stage_residuals", nx=NXT),
    ),
    "c04_post_floor": (
        lambda v: arrays(v).select("traj_id", "split", "stage", C.post_floor(F.col("res"), F.col("fl"), F.col("p"), F.lit(0.35), F.lit(0.1)).alias("outcome")),
        oracle("SELECT traj_id, split, stage, CASE WHEN lo IS NULL THEN 'no_clear_drop' WHEN lo / residual <= 0.35e0 THEN 'clear_drop' ELSE 'no_clear_drop' END AS outcome FROM (SELECT *, min(residual) OVER (PARTITION BY traj_id, split ORDER BY stage ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo FROM stage_residuals) q", "stage_residuals"),
    ),
    "c05_uninformative": (
        lambda v: arrays(v).select("traj_id", "split", "stage", C.uninformative(F.col("res"), F.col("p"), F.lit(0.02)).alias("flat")),
        oracle("SELECT traj_id, split, stage, max(abs(residual)) OVER (PARTITION BY traj_id, split ORDER BY stage ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 0.02e0 AS flat FROM stage_residuals", "stage_residuals"),
    ),
    "c06_split_decision": (decisions, oracle("SELECT traj_id, eq, split, kind, cap, stage FROM dc", "stage_residuals", **walk())),
    **{f"c07_vote_{m}": ((lambda v, m=m: C.vote(stored(v), m)), oracle(sql, "stage_residuals", **G)) for m, sql in VOTE.items()},
    "c08_estimate_stage_caps": (lambda v: C.estimate_stage_caps(v.traj_events, B2, EV), None),
    "c08_flat_library": (lambda v: C.estimate_stage_caps(v.traj_events, T.flat_basis(2), EV), oracle("SELECT DISTINCT traj_id, eq, NULL AS cap FROM traj_events, (VALUES (1), (2)) e(eq)", "traj_events")),
    "c09_effective_stages": (
        lambda v: C.effective_stages(v.customer.select(F.col("c_custkey").alias("traj_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("eq")).select("traj_id", "eq", ((F.col("traj_id") + F.col("eq")) % 5 + 1).cast("int").alias("stage"), F.when(F.col("traj_id") % 3 == 0, (F.col("eq") + 1).cast("int")).alias("cap")), 5),
        oracle("SELECT c_custkey AS traj_id, eq, least((c_custkey + eq) % 5 + 1, CASE WHEN c_custkey % 3 = 0 THEN eq + 1 ELSE 5 END) AS stage, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 5 END AS run_limit FROM customer, (VALUES (1), (2)) e(eq)"),
    ),
    "c10_stage_gains": (
        lambda v: r(C.stage_gains(v.stage_residuals), n=9),
        oracle(f"SELECT traj_id, split, stage, round(CASE WHEN usable AND nu THEN residual - nr END, 9) + 0e0 AS gain_abs, round(CASE WHEN usable AND nu THEN CASE WHEN residual = 0 THEN {INF} ELSE (residual - nr) / residual END END, 9) + 0e0 AS gain_rel, CASE WHEN usable AND nu IS NULL THEN 'no_potential' WHEN usable AND nu AND residual > nr THEN 'potential_detected' WHEN usable AND nu THEN 'no_potential' ELSE 'invalid_or_inconclusive' END AS verdict FROM nx", "stage_residuals", nx=NXT),
    ),
    "c11_threshold_grid": (grid, oracle("SELECT * FROM tg", "stage_residuals", **TG)),
    "c12_grid_summary": (
        lambda v: C.grid_summary(grid(v), expected(v)),
        oracle("SELECT tau_rel, tau_abs, count(*) FILTER (m < expected) AS under, count(*) FILTER (m = expected) AS exact, count(*) FILTER (m > expected) AS over FROM (SELECT traj_id, tau_rel, tau_abs, quantile_disc(useful, 0.5) AS m FROM tg GROUP BY 1, 2, 3) a JOIN ex USING (traj_id) GROUP BY 1, 2", "stage_residuals", **TG, ex=EXP),
    ),
    "c13_separation": (
        lambda v: C.separation(grid(v), 2, 6, 4),
        oracle("SELECT tau_rel, tau_abs, count(*) AS splits_apart FROM (SELECT tau_rel, tau_abs, split, max(useful) FILTER (traj_id = 2) AS lo, max(useful) FILTER (traj_id = 6) AS hi FROM tg GROUP BY 1, 2, 3) q WHERE lo < 4 AND hi >= 4 GROUP BY 1, 2", "stage_residuals", **TG),
    ),
    "c14_derived_stage": (derived, oracle("SELECT * FROM pr", "stage_residuals", **DERIVED)),
    "c14_stage_confusion": (
        lambda v: C.stage_confusion(derived(v), expected(v)),
        oracle("SELECT CASE WHEN try_cast(predicted AS INT) IS NULL THEN predicted WHEN try_cast(predicted AS INT) < expected THEN 'under' WHEN try_cast(predicted AS INT) > expected THEN 'over' ELSE 'exact' END AS category, count(*) AS n FROM pr JOIN ex USING (traj_id) GROUP BY 1", "stage_residuals", **DERIVED),
    ),
    "c15_identifiability": (
        lambda v: C.identifiability(v.stage_residuals.withColumn("floor_ms", F.col("floor_ms") * 3), expected(v)),
        oracle("SELECT traj_id, k // 10 AS stage, k % 10 AS split, u AS usable_at_expected FROM (SELECT traj_id, min(stage * 10 + split) FILTER (stage < expected AND usable AND residual <= floor_ms * 3) AS k, coalesce(bool_or(stage = expected AND usable), false) AS u FROM stage_residuals JOIN ex USING (traj_id) GROUP BY 1) q", "stage_residuals", ex=EXP),
    ),
    "c16_split_exclusions": (
        lambda v: C.split_exclusions(v.stage_residuals),
        oracle("SELECT split, CASE WHEN NOT usable THEN 'unusable' WHEN residual <= floor_ms THEN 'at_floor' ELSE 'kept' END AS reason, count(*) AS n FROM stage_residuals GROUP BY 1, 2", "stage_residuals"),
    ),
    "c17_classify_cap": (
        lambda v: caps(v).select("horizon", "traj_id", *[C.classify_cap(F.col("cap"), F.col("true_stage"), k).alias(f"k_{k}") for k in ("audit", "grid", "commit")]),
        oracle(f"SELECT horizon, traj_id, {CLASS.format('uncapped', 'truncated', 'ok', 'ok')} AS k_audit, {CLASS.format('nothing', 'violation', 'correct', 'conservative')} AS k_grid, {CLASS.format('abstain', 'wrong_commit', 'correct_commit', 'correct_commit')} AS k_commit FROM cp", cp=CAPS_SQL),
    ),
    "c18_horizon_audit": (
        lambda v: C.horizon_audit(caps(v)),
        oracle("SELECT a.horizon, count(*) FILTER (a.cap < a.true_stage) AS truncated, count(*) FILTER (a.cap >= a.true_stage) AS ok, count(*) FILTER (a.cap IS NULL) AS uncapped, count(DISTINCT CASE WHEN a.cap < a.true_stage THEN a.traj_id END) AS truncated_series, count(*) FILTER (a.cap IS DISTINCT FROM b.cap) AS changed, count(*) FILTER (a.cap IS NULL AND b.cap IS NOT NULL) AS lost, count(*) FILTER (a.cap IS NOT NULL AND b.cap IS NULL) AS gained FROM cp a JOIN cp b ON a.traj_id = b.traj_id AND b.horizon = 2 GROUP BY 1", cp=CAPS_SQL),
    ),
    "c18_first_horizon": (
        lambda v: C.first_acceptable_horizon(C.horizon_audit(caps(v)), 20),
        oracle("SELECT min(horizon) AS horizon FROM (SELECT horizon, count(*) FILTER (cap < true_stage) AS t FROM cp GROUP BY 1) q WHERE t <= 20", cp=CAPS_SQL),
    ),
    "c19_compare_caps": (
        lambda v: C.compare_caps(at(v, 2), at(v, 3).where("traj_id % 9 <> 0").unionByName(at(v, 3).where("traj_id % 10 = 0"))),
        oracle("SELECT traj_id, eq, n = 1 AND cap IS NOT DISTINCT FROM c3 AS same, n = 1 AS ok FROM (SELECT a.traj_id, a.eq, a.cap, b.cap AS c3, CASE WHEN a.traj_id % 9 <> 0 THEN 1 ELSE 0 END + CASE WHEN a.traj_id % 10 = 0 THEN 1 ELSE 0 END AS n FROM cp a JOIN cp b ON a.traj_id = b.traj_id AND b.horizon = 3 WHERE a.horizon = 2) q", cp=CAPS_SQL),
    ),
    "c20_low_signal_overlap": (
        lambda v: C.low_signal_overlap(v.supplier.select((F.col("s_suppkey") % 20 / 20).alias("active"), (F.col("s_suppkey") % 3 == 0).alias("failing"))),
        oracle("SELECT count(*) FILTER (s_suppkey % 20 / 20 <= 0.1e0) AS low_activity, count(*) FILTER (s_suppkey % 3 = 0) AS failing, count(*) FILTER (s_suppkey % 20 / 20 <= 0.1e0 AND s_suppkey % 3 = 0) AS both FROM supplier"),
    ),
    "c21_loso_thresholds": (loso, oracle("SELECT grp, drop_ratio, floor_ratio, a AS abstains, k AS correct FROM o WHERE rn = 1", **LOSO)),
    "c22_reliability_matrix": (
        lambda v: C.reliability_matrix(at(v, 2).select("traj_id", "eq", "cap"), at(v, 5), at(v, 2).select("traj_id", "eq", "true_stage")),
        oracle("SELECT count(*) FILTER (a.cap >= a.true_stage) AS correct_commit, count(*) FILTER (a.cap < a.true_stage) AS wrong_commit, count(*) FILTER (a.cap IS NULL AND coalesce(b.cap >= b.true_stage, false)) AS unnecessary_abstain, count(*) FILTER (a.cap IS NULL AND NOT coalesce(b.cap >= b.true_stage, false)) AS correct_abstain FROM cp a JOIN cp b ON a.traj_id = b.traj_id AND b.horizon = 5 WHERE a.horizon = 2", cp=CAPS_SQL),
    ),
    "c23_trace_decisions": (lambda v: C.trace_decisions(table(v), C.policy_struct(POL)), oracle("SELECT traj_id, eq, split, kind, cap, stage, trace FROM dc JOIN tr USING (traj_id, split)", "stage_residuals", **walk(), tr=TRACE)),
    "c24_cap_changes": (
        lambda v: C.cap_changes(at(v, 3), at(v, 2), at(v, 2).where("traj_id % 2 = 0")),
        oracle("SELECT a.traj_id, a.eq, b.cap AS old, a.cap AS new, a.traj_id % 2 = 0 AS allowed FROM cp a JOIN cp b ON a.traj_id = b.traj_id AND b.horizon = 2 WHERE a.horizon = 3 AND a.cap IS DISTINCT FROM b.cap", cp=CAPS_SQL),
    ),
    "c25_cap_sensitivity": (
        lambda v: C.cap_sensitivity(table(v), (0.1, 1.0, 10.0, 1000.0), POL).select("traj_id", "eq", F.concat_ws(",", F.transform("caps", lambda x: x.cast("string"))).alias("caps"), "n_caps"),
        oracle("SELECT traj_id, 1 AS eq, array_to_string(list_sort(list(DISTINCT coalesce(cap, 0))), ',') AS caps, count(DISTINCT coalesce(cap, 0)) AS n_caps FROM vs GROUP BY traj_id", "stage_residuals", **walk((0.1, 1.0, 10.0, 1000.0)), **SENSE),
    ),
    "c25_sensitivity": (gridded, oracle("SELECT * FROM sg", "stage_residuals", **GRIDDED)),
    "c25_sensitivity_summary": (
        lambda v: C.sensitivity_summary(gridded(v), 3),
        oracle("SELECT traj_id, eq, string_agg(DISTINCT c, ', ' ORDER BY c) AS caps, count(*) AS n, count(*) FILTER (cap = 3) AS at_stage FROM (SELECT *, coalesce(CAST(cap AS VARCHAR), 'none') AS c FROM sg) q GROUP BY 1, 2", "stage_residuals", **GRIDDED),
    ),
    "c24_cap_audit": (
        lambda v: C.cap_audit(at(v, 3), at(v, 2), at(v, 2).where("traj_id % 2 = 0"), at(v, 5).where("traj_id % 5 = 0").select(F.when(F.col("traj_id") % 15 == 0, -1 - F.col("traj_id")).otherwise(F.col("traj_id")).alias("traj_id"), "eq", F.col("cap").alias("expected"))),
        oracle(
            "SELECT * FROM (SELECT count(*) AS rows, count(*) FILTER (ch) AS changed, count(*) FILTER (ch AND traj_id % 2 <> 0) AS violations, count(old) AS finite_before, count(cap) AS finite_after FROM (SELECT a.traj_id, a.cap, b.cap AS old, a.cap IS DISTINCT FROM b.cap AS ch FROM cp a JOIN cp b ON a.traj_id = b.traj_id AND b.horizon = 2 WHERE a.horizon = 3) q), "
            "(SELECT count(*) AS targets, count(*) FILTER (c.traj_id % 15 <> 0 AND a.cap IS NOT DISTINCT FROM c.cap) AS targets_met, count(*) FILTER (c.traj_id % 15 = 0) AS targets_missing FROM cp c LEFT JOIN cp a ON a.traj_id = c.traj_id AND a.horizon = 3 WHERE c.horizon = 5 AND c.traj_id % 5 = 0)", cp=CAPS_SQL),
    ),
    "c26_post_floor_events": (lambda v: r(C.post_floor_events(table(v), POL), n=9), oracle("SELECT traj_id, eq, split, stage, round(later_ratio, 9) AS later_ratio, round(floor_ratio, 9) AS floor_ratio, outcome FROM ev", "stage_residuals", **{k: q for k, q in walk().items() if k in ("ls", "ps", "pc", "pf")}, ev=EVENTS)),
    "c26_nearest_event": (lambda v: r(C.nearest_event(C.post_floor_events(table(v), POL)), n=9), oracle("SELECT traj_id, eq, split, stage, round(later_ratio, 9) AS later_ratio, outcome FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, eq ORDER BY coalesce(abs(later_ratio - 0.5e0), 'Infinity'::DOUBLE), split) AS rn FROM ev) q WHERE rn = 1", "stage_residuals", **{k: q for k, q in walk().items() if k in ("ls", "ps", "pc", "pf")}, ev=EVENTS)),
}
