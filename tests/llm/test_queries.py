"""Registered queries of the operators against their SQL, and the pipeline against a brute-force version of its stages."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import check_packing, classes, fill, plain_judgement, words
from tests.test_queries import rows
from tracewright.llm import packing
from tracewright.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(SQL[name]).df())


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def plain_mixture(rows):
    """How often each row is taken: exact targets, then whole documents in the order of their hashes."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    targets, out = fill(sizes), []
    h = lambda d: int(hashlib.md5(f"0:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
    for source, n in sizes.items():
        whole = int(targets[source] // n) if n else 0
        need, before = float(targets[source] - whole * n), 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (h(r["doc_id"]), r["doc_id"], len(words(r["text"])))):
            size = len(words(r["text"]))
            out += [r] * (whole + (need > 0 and before + size / 2 <= need))
            before += size
    return out


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """A folder with short documents of the test table, copies, repeated rows and nulls, and their labels."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.where("length(text) < 600").orderBy("doc_id").limit(60).collect()
    more = [Row(**{**r.asDict(), "doc_id": 10**6 + r["doc_id"], "source": None}) for r in rows[:6]] + [rows[3], rows[3]]
    more += [Row(**{**rows[0].asDict(), **x}) for x in ({"doc_id": 2 * 10**6, "text": None}, {"doc_id": 2 * 10**6 + 1, "text": ""}, {"doc_id": 2 * 10**6 + 2, "lang": None, "text": "the the of and to in that is"}, {"doc_id": 2 * 10**6 + 3, "text": " \n"})]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows + more, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, small):
    """Every stage against a brute-force version of it on what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: Counter(tuple(r) for r in rows)
    rows = docs.collect()
    good = stages["quality classifier"](spark, docs, small).cache()
    kept = [r for r, k in zip(rows, plain_judgement(rows, spark.read.parquet(f"{small}/labels.parquet").collect())) if k]
    assert good.columns == docs.columns and key(good.collect()) == key(kept) and 0 < len(kept) < len(rows)
    one = stages["near duplicates"](spark, good, small).cache()
    want = classes([(r["doc_id"], r["text"]) for r in kept], 5)
    first = {r["doc_id"]: r for r in kept}
    left = [first[d] for d, (_, c) in want.items() if d == c]
    assert one.columns == docs.columns and key(one.collect()) == key(left) and len(left) < len(kept)
    mixed = stages["mixing"](spark, one, small).cache()
    assert mixed.columns == docs.columns and key(mixed.collect()) == key(plain_mixture(left))
    check_packing(mixed, packing.pack(mixed, packing.tokenizer_file()))
    last = stages["packing"](spark, mixed, small).toPandas()
    pieces = packing.pack(mixed, packing.tokenizer_file()).toPandas()
    crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in pieces["ids"]]
    assert np.all(last["length"] <= 1024) and sorted(zip(last["sequence_id"], last["offset"], last["ids_crc32"])) == sorted(zip(pieces["sequence_id"], pieces["offset"], crc))
    assert corpus_pipeline.run(spark, small).count() == len(last)


def test_pipeline_without_rows(spark, small, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_other_columns(spark, small):
    """Columns whose names operators use inside pass through every stage but the last."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("*", *[F.lit("x").alias(c) for c in ("perplexity", "block", "k1", "shard", "target", "bucket", "component", "rep", "n", "size", "part", "rid", "curve")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns and {r["bucket"] for r in got.collect()} == {"x"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0
