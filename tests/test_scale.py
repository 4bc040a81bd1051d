"""Quantiles in passes, state with a lifetime, compaction and rankings before the shuffle."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import levels as L
from tracewright.operators.quantiles import exact_quantiles
from tracewright.streaming import heartbeats as H

PS = (0.0, 0.25, 0.5, 0.777, 1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group over sixteen decades, one that is nearly all one value, a small one, one under a null key, one of a single
    row, and values that don't count."""
    g = np.random.default_rng(1)
    rows = []
    for k, n in (("hot", 9000), ("same", 5000), ("small", 300), (None, 4000), ("one", 1)):
        v = g.standard_normal(n) * 10.0 ** g.integers(-8, 8, n) if k != "same" else np.where(g.random(n) < 0.9, 3.5, g.integers(0, 9, n))
        rows += [(k, float(x)) for x in v]
    rows += [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double"), pd.DataFrame([r for r in rows if r[1] is not None and np.isfinite(r[1])], columns=["k", "v"])


@pytest.mark.parametrize("kind,hot", [("cont", 400), ("disc", 400), ("cont", 10**6)])
def test_exact_quantiles(skewed, kind, hot):
    df, plain = skewed
    got = {r["k"]: (r["n"], r["q"]) for r in exact_quantiles(df, "v", PS, ["k"], kind, hot).collect()}
    assert len(got) == 5
    for k, x in plain.groupby("k", dropna=False)["v"]:
        a = np.sort(x.to_numpy())
        want = [np.quantile(a, p) if kind == "cont" else a[max(int(np.ceil(p * len(a) - 1e-12)), 1) - 1] for p in PS]
        n, q = got[None if k != k else k]
        assert n == len(a) and np.allclose(q, want, rtol=1e-12, atol=0)


def test_quantiles_without_rows(spark, skewed):
    empty = skewed[0].where("v > 1e300")
    assert exact_quantiles(empty, "v", (0.5,), ["k"]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(empty, "v", (1.5,))
    r = A.distribution(skewed[0].where("k = 'same'"), "v", ["k"], hot=100).first()
    assert r["median"] == 3.5 and r["n"] == 5000


def test_eta_limits_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, "a").otherwise(None).alias("grp"), (F.col("id") * 10**6).alias("us"), "id")
    got = {r["grp"]: r for r in L.progress_eta(rows, 6000).collect()}
    assert got["a"]["done"] == 4285 and got[None]["done"] == 715 and got[None]["mean_gap_s"] == pytest.approx(7.0)
    plan = L.progress_eta(rows, 6000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def heartbeat(cell, level, loss, event="level"):
    return json.dumps({"cell": cell, "event": event, "level": level, "stage": 1, "best_loss": loss, "timestamp": f"2024-01-01T00:{level % 60:02d}:00Z"})


def test_progress_from_history(spark, tmp_path):
    """A stream that starts from a batch's state goes on as if it had seen the batch; state ends with the cells."""
    losses = {c: [float(x) for x in np.random.default_rng(c).integers(1, 30, 12)] for c in range(1, 7)}
    whole = [(c, i + 1, x) for c, v in losses.items() for i, x in enumerate(v)]
    history = H.cell_progress(spark.createDataFrame([r for r in whole if r[1] <= 5], "cell long, level int, best_loss double"))
    (tmp_path / "in").mkdir()
    lines = [heartbeat(*r) for r in whole if r[1] > 5] + [heartbeat(c, 13, 0.0, "complete") for c in (1, 2, 3, 4)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    kept = []
    live = H.running_progress(H.stream_heartbeats(spark, str(tmp_path / "in"))[0], history)
    out = H.run_to_table(live, str(tmp_path / "run"), "update", 120, H.STATE_STORE, lambda q: kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])).collect()
    want = {r["cell"]: (r["level"], r["best"], r["silent"]) for r in H.cell_progress(spark.createDataFrame(whole, "cell long, level int, best_loss double")).collect()}
    assert {r["cell"]: (r["level"], r["best"], r["silent"]) for r in out} == want
    assert {r["cell"] for r in out if r["finished"]} == {1, 2, 3, 4} and kept[-1] <= 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_compaction(spark, tmp_path):
    """One file a bucket whatever the number of batches; a reader sees a compaction wholly or not at all; leftovers of one
    that failed don't count; expired folders are not missed."""
    path, schema = str(tmp_path / "h"), "k long, v string"
    for n in range(7):
        spark.range(n * 10, n * 10 + 10).select(F.col("id").alias("k"), F.lit("x").alias("v"), (F.col("id") % 3).cast("int").alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/batch={n}")
    s = spark.createDataFrame([], schema).schema
    keys = lambda: sorted(r["k"] for r in H.read_history(spark, path, s).collect())
    assert keys() == list(range(70))
    assert H.compact(spark, path, s, 4) and keys() == list(range(70)) and H._folders(spark, path) == (3, [4, 5, 6])
    files = lambda n: {b.name: len(list(b.glob("*.parquet"))) for b in (tmp_path / "h" / f"_base={n}").glob("bucket=*")}
    assert files(3) == {f"bucket={i}": 1 for i in range(3)}
    (tmp_path / "h" / "_base=6" / "bucket=0").mkdir(parents=True)
    assert H._folders(spark, path)[0] == 3 and keys() == list(range(70))
    assert H.expire(spark, path) == 4 and keys() == list(range(70))
    assert H.compact(spark, path, s, 6) and files(5) == {f"bucket={i}": 1 for i in range(3)} and keys() == list(range(70))
    assert not H.compact(spark, path, s, 6)
    # a batch that is run again overwrites its own folder
    spark.range(60, 70).select(F.col("id").alias("k"), F.lit("x").alias("v"), (F.col("id") % 3).cast("int").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch=6")
    assert keys() == list(range(70))
    assert H.read_history(spark, str(tmp_path / "nothing"), s).count() == 0
