"""Approximate nearest neighbours by an inverted multi-index: two vector halves, each with its own codebook."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowest, materialize, table

SAMPLE, ROUNDS, SALT_ROWS, QUERY_ROWS = 20_000, 12, 32_768, 1024
#: Queries whose cells one task looks up.
PROBED = 64
#: Recall that the traversal's length is set for, and how many rows of the sample ask for that.
RECALL, ASKED = 0.96, 256


def codes_for(n: int) -> int:
    """Codes a half for n rows: about a quarter of the root, 16 to 256, so that cells hold tens of rows."""
    return int(2 ** np.clip(round(np.log2(max(n, 2)) / 2 - 2), 4, 8))


def usable(df: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of rows whose vector isn't null, empty or zero and has only finite components."""
    ok = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k means (fewer if x has fewer distinct rows) from a seeded start; a mean without rows stays where it is."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(5).choice(len(distinct), min(k, len(distinct)), False)].copy()
    for _ in range(ROUNDS):
        at = _square(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of first[i] + second[j], until they hold `wanted` rows: one heap, each pair pushed once."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb, cells, held = first[a].tolist(), second[b].tolist(), [], 0
    ai, bi = a.tolist(), b.tolist()
    heap = [(fa[0] + sb[0], 0, 0)]
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = counts[ai[i], bi[j]]
        if n:
            cells.append((ai[i], bi[j]))
            held += int(n)
        if j + 1 < len(sb):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(fa):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    return cells


def nearest(x: np.ndarray, ids: np.ndarray, c2: np.ndarray, q: np.ndarray, own: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, entry number, distance) of the k nearest entries of each query q among those whose code is in codes
    (queries x codes) and whose id is not own. Products choose, differences in double precision decide."""
    out: list[tuple] = []
    norm = (x * x).sum(1)
    for i in range(0, len(q), 256):
        d = norm - 2 * q[i : i + 256] @ x.T
        d[~codes[i : i + 256][:, c2] | (own[i : i + 256, None] == ids)] = np.inf
        for r, row in enumerate(d):
            at = np.flatnonzero(row < np.inf)
            if len(at) > k:
                v = row[at]
                edge = np.partition(v, k - 1)[k - 1]
                at = at[v <= edge + 1e-9 * (1 + abs(edge) + norm.max())]
            exact = np.sqrt(((x[at] - q[i + r]) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            out.append((np.full(len(best), i + r), at[best], exact[best]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


class MultiIndex:
    """Codebooks from a bounded sample (the SAMPLE distinct rows of the lowest hashes); every usable row is indexed.

    Rows whose vectors have another length than most (the shortest, if lengths are equally frequent) have no distance to
    the others and take no part.
    """

    def __init__(self, vectors: DataFrame, codes: int | None = None):
        self.spark = vectors.sparkSession
        length = usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.dim = length["d"] if length else 0
        rows = usable(vectors).where(F.size("v") == self.dim)
        key = F.xxhash64("vec_id", "v").alias("key")
        chosen = lowest(rows.select(key), SAMPLE)
        # at most SAMPLE keys, so safe to broadcast
        sample = rows.select("v", key).join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"]).orderBy("key").select("v").toPandas()
        self.sample = np.array(sample["v"].tolist(), float).reshape(-1, max(1, self.dim))
        half = max(1, self.dim // 2)
        self.halves = (slice(0, half), slice(half, None)) if self.dim > 1 else (slice(0, 1), slice(0, 1))
        k = codes or codes_for(length["count"] if length else 0)
        self.books = [codebook(self.sample[:, h], k) for h in self.halves] if len(self.sample) else [np.zeros((1, 1))] * 2
        halves, books = self.halves, self.books

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = np.stack(b["v"].to_numpy())
                    yield b.assign(c1=_square(v[:, halves[0]], books[0]).argmin(1).astype("int32"), c2=_square(v[:, halves[1]], books[1]).argmin(1).astype("int32"))

        self.rows = materialize(rows.mapInPandas(assign, "vec_id long, v array<double>, c1 int, c2 int"), "imi")
        # codes * codes counts at most
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        for r in self.rows.groupBy("c1", "c2").count().collect():
            self.counts[r["c1"], r["c2"]] = r["count"]

    def needed_share(self, k: int, recall: float = RECALL) -> float:
        """Part of the rows that traversal must meet so that `recall` of the true neighbours are among them.

        Measured on the sample: ASKED rows of it against the others. In a larger table the k nearest lie nearer, so the
        same part holds more of them.
        """
        x, n = self.sample, len(self.sample)
        if n <= k + 1:
            return 1.0
        c = [_square(x[:, h], b) for h, b in zip(self.halves, self.books, strict=True)]
        cell = c[0].argmin(1) * len(self.books[1]) + c[1].argmin(1)
        held, met = np.bincount(cell, minlength=self.counts.size), []
        for i in range(min(ASKED, n)):
            order = np.argsort((c[0][i][:, None] + c[1][i]).ravel(), kind="stable")
            seen = np.empty(len(order), np.int64)
            seen[order] = np.cumsum(held[order])
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            met.append(seen[cell[np.argpartition(d, k - 1)[:k]]])
        return float(np.quantile(np.concatenate(met), recall, method="higher") / n)

    def search(self, queries: DataFrame, k: int = 10, share: float | None = None) -> DataFrame:
        """query_id, rank, vec_id, score: each query's k nearest rows among those of its cells, itself left out.

        queries has vec_id and embedding; equal rows ask once, rows of one id with different vectors ask each for itself.
        Cells are met in the order of summed distance until they hold `share` of all rows (measured on the sample, if not
        given) and 50 * k rows. A query goes once to each first-half list that it probes (with its second-half codes),
        not once per cell; long lists are salted and queries are dealt to blocks, so a group is at most about SALT_ROWS
        entries and QUERY_ROWS queries. Distances are exact, in double precision; ties go to the smaller vec_id. Rows with
        the query's id are no candidates; other rows that repeat an id are candidates each. Fewer than k: all of them.
        """
        schema = "query_id long, rank int, vec_id long, score double"
        total = int(self.counts.sum())
        if not total:
            return self.spark.createDataFrame([], schema)
        halves, books, counts = self.halves, self.books, self.counts
        share = self.needed_share(k) if share is None else share
        wanted = max(int(np.ceil(share * total)), min(50 * k, total))
        salts = np.maximum(1, -(-counts.sum(1) // SALT_ROWS))
        asking = materialize(usable(queries).where(F.size("v") == self.dim).dropDuplicates(["vec_id", "v"]), "imi-queries")
        n_queries = asking.count()
        blocks = max(1, -(-n_queries // QUERY_ROWS))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for q, key, v, block in b[["vec_id", "qkey", "v", "block"]].itertuples(index=False):
                    v = np.asarray(v)
                    lists: dict[int, list[int]] = {}
                    for i, j in traverse(_square(v[None, halves[0]], books[0])[0], _square(v[None, halves[1]], books[1])[0], counts, wanted):
                        lists.setdefault(i, []).append(j)
                    out += [(q, key, v, i, s, block, js) for i, js in lists.items() for s in range(int(salts[i]))]
                yield pd.DataFrame(out, columns=["query_id", "qkey", "q", "c1", "salt", "block", "codes"])

        def rank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(entries) or not len(asked):
                return pd.DataFrame(columns=["query_id", "qkey", "vec_id", "score"])
            x, ids = np.stack(entries["v"].to_numpy()), entries["vec_id"].to_numpy()
            codes = np.zeros((len(asked), len(books[1])), bool)
            for i, js in enumerate(asked["codes"]):
                codes[i, js] = True
            q, own = np.stack(asked["q"].to_numpy()), asked["query_id"].to_numpy()
            a, e, d = nearest(x, ids, entries["c2"].to_numpy(), q, own, codes, k)
            return pd.DataFrame({"query_id": own[a], "qkey": asked["qkey"].to_numpy()[a], "vec_id": ids[e], "score": d})

        block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
        asked = asking.withColumns({"block": block, "qkey": F.xxhash64("v")}).repartition(max(1, -(-n_queries // PROBED)), "vec_id", "qkey").mapInPandas(probe, "query_id long, qkey long, q array<double>, c1 int, salt int, block int, codes array<int>")
        n = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), F.col("c1") + 1)
        entries = self.rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        group = ["c1", "salt", "block"]
        near = entries.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(rank, "query_id long, qkey long, vec_id long, score double")
        order = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id"))
        return near.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, zero and non-finite vectors take no part; rows that repeat a vec_id are never each other's neighbours."""
    vectors = table(spark, sf_dir, "embeddings")
    return MultiIndex(vectors).search(vectors.where("vec_id % 100 = 0"))
