"""Least squares in derivative space on triangular factors of row blocks.

A block's rows [terms | derivatives] are reduced to their R factor, at most (p + dim) square whatever the block's length;
factors of blocks stack and reduce again, so a series of any length is a tree of small reductions. Term order is stage
order, so one factor serves every cumulative stage (a column prefix) and every candidate structure (a column subset).
Normal equations are avoided on purpose: they square the condition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.sources.scratch import cut

from .derivatives import whole_in_order
from .terms import Term

#: Rows of one elementary piece; a longer block is several pieces.
PIECE = 4096
#: Series whose factors are unpacked and solved together.
SERIES = 256
#: Candidates of a series that meet its factors in one group.
SLICE = 4096
SENTINEL = 1e6
INF = float("inf")
#: Elementary blocks cut at these parts of a series; every fit and holdout set of the four splits is a union of them.
N_BLOCKS = 8


def block_of(seq: Column, n: Column) -> Column:
    """Number 0..7 of the elementary block of a row."""
    fl = lambda p: F.floor(n * p)
    cuts = [fl(0.25), fl(0.3), fl(0.35), fl(0.5), n - fl(0.35), n - fl(0.3), fl(0.75)]
    return sum((F.when(seq > c, 1).otherwise(0) for c in cuts), F.lit(0))


def roles(n: int) -> dict[str, tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """split -> (fit, holdout) as ranges (first, last] of rows."""
    k, m, q = int(np.floor(0.3 * n)), int(np.floor(0.35 * n)), [int(np.floor(x * n)) for x in (0.25, 0.5, 0.75)]
    return {"A": ([(0, n - k)], [(n - k, n)]), "B": ([(k, n)], [(0, k)]), "C": ([(0, m), (n - m, n)], [(m, n - m)]), "D": ([(0, q[0]), (q[1], q[2])], [(q[0], q[1]), (q[2], n)])}


def triangle(a: np.ndarray) -> np.ndarray:
    """Square R factor of a, padded with zero rows if a has fewer rows than columns."""
    r = np.linalg.qr(a, mode="r") if len(a) else np.zeros((0, a.shape[1]))
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))]) if len(r) < a.shape[1] else r


def factor_schema(rows: DataFrame, by: Sequence[str]) -> T.StructType:
    ints = [T.StructField(c, T.IntegerType()) for c in ("block", "first", "last", "n")]
    return T.StructType([rows.schema[c] for c in by] + ints + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("plain", "weighted", "sums")])


def _starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin a new combination of values."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(t: pa.Table, by: Sequence[str]) -> list[np.ndarray]:
    """Numbers that tell keys apart, whatever their types."""
    return [pc.dictionary_encode(pc.fill_null(pc.cast(t[c].combine_chunks(), pa.string()), "\0null")).indices.to_numpy() for c in by]


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    values = t[name].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def triangles(a: np.ndarray) -> np.ndarray:
    """Square R factors of a stack of matrices, padded with zero rows."""
    m, n = a.shape[-2:]
    r = np.linalg.qr(a, mode="r") if m else np.zeros((*a.shape[:-2], 0, n))
    return np.concatenate([r, np.zeros((*a.shape[:-2], n - r.shape[-2], n))], -2) if r.shape[-2] < n else r


class Factors:
    """Factors of many pieces at once: arrays over pieces."""

    names = ("block", "first", "last", "n", "plain", "weighted", "sums")

    def __init__(self, *parts: np.ndarray):
        self.block, self.first, self.last, self.n, self.plain, self.weighted, self.sums = parts

    def take(self, at) -> Factors:
        return Factors(*[getattr(self, x)[at] for x in self.names])

    @classmethod
    def of_rows(cls, block: np.ndarray, seq: np.ndarray, x: np.ndarray, d: np.ndarray, w: np.ndarray, rich: np.ndarray, start: np.ndarray) -> Factors:
        """Of the rows from each start to the next: pieces of one length are factored together."""
        n, (p, dim) = np.diff(np.r_[start, len(seq)]), (x.shape[1], d.shape[1])
        plain, weighted, root = np.zeros((len(start), p + dim, p + dim)), np.zeros((len(start), dim, p + 1, p + 1)), np.sqrt(np.maximum(w, 0))
        for m in np.unique(n):
            at = np.flatnonzero(n == m)
            rows = start[at][:, None] + np.arange(m)
            xs, ds = x[rows], d[rows]
            plain[at] = triangles(np.concatenate([xs, ds], 2))
            for e in range(dim):
                weighted[at, e] = triangles(np.concatenate([xs, ds[:, :, e : e + 1]], 2) * root[rows, e][..., None])
        sums = np.stack([np.add.reduceat(v, start, axis=0) for v in (d, d * d, rich * rich)], 1) if len(start) else np.zeros((0, 3, dim))
        return cls(block[start], np.minimum.reduceat(seq, start) - 1 if len(start) else seq[:0], np.maximum.reduceat(seq, start) if len(start) else seq[:0], n, plain, weighted, sums)

    def merged(self, start: np.ndarray) -> Factors:
        """One factor for the pieces from each start to the next."""
        n = np.diff(np.r_[start, len(self.block)])
        if (n == 1).all():
            return self
        out = self.take(start)
        for i in np.flatnonzero(n > 1):
            part = slice(start[i], start[i] + n[i])
            out.first[i], out.last[i], out.n[i], out.sums[i] = self.first[part].min(), self.last[part].max(), self.n[part].sum(), self.sums[part].sum(0)
            out.plain[i] = triangle(self.plain[part].reshape(-1, self.plain.shape[-1]))
            for e in range(self.weighted.shape[1]):
                out.weighted[i, e] = triangle(self.weighted[part, e].reshape(-1, self.weighted.shape[-1]))
        return out


def _lists(a: np.ndarray) -> pa.Array:
    flat = a.reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1] if len(flat) else np.zeros(1, np.int32)), pa.array(flat.ravel()))


def _whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str], most: int | None = None) -> Iterator[pa.Table]:
    """The batches of a sorted partition as tables that end where a combination of `by` ends, of at most so many of them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        start = _starts(_codes(t, by)) if len(t) else []
        if len(start) < 2:
            rest = t
            continue
        ends = start[:-1:most] if most else start[:1]
        for a, b in zip(ends, [*ends[1:], start[-1]], strict=True):
            yield t.slice(a, b - a).combine_chunks()
        rest = t.slice(start[-1]).combine_chunks()
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _keyed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their blocks, in order within partitions. Without __n a window counts them, so a series is one partition's; it
    goes in the same order, so that both share one sort."""
    if "__n" not in rows.columns:
        rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole_in_order(by)))
    keyed = rows.withColumns({"block": block_of(F.col("seq"), F.col("__n")).cast("int"), "__piece": F.floor((F.col("seq") - 1) / PIECE).cast("int"), "seq": F.col("seq").cast("int")})
    return keyed.select(*by, "block", "__piece", "seq", "phi", "d", "w", "rich").sortWithinPartitions(*by, "seq")


def _factored(batches: Iterator[pa.RecordBatch], by: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Factors of a partition's sorted rows; of one series at most PIECE rows are held at a time."""
    for t in _whole_groups(batches, [*by, "__piece"]):
        block, codes = t["block"].to_numpy(), _codes(t, by)
        start = _starts([*codes, t["__piece"].to_numpy(), block])
        f = Factors.of_rows(block, t["seq"].to_numpy(), *[_matrix(t, c) for c in ("phi", "d", "w", "rich")], start)
        again = _starts([c[start] for c in codes] + [block[start]])
        f, at = f.merged(again), pa.array(start[again])
        yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(at) for c in by] + [pa.array(getattr(f, c).astype(np.int32)) for c in Factors.names[:4]] + [_lists(getattr(f, c)) for c in Factors.names[4:]], names=names)


def block_factors(rows: DataFrame, p: int, dim: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Factors per (series, elementary block, stretch). rows: by, seq, phi, d, w, rich (arrays; w and rich per equation).

    A task factors what lies in its partition, in sorted order and at most PIECE rows of one series at a time; factors of
    any parts of a block add up to the block's, so a series of any length can be spread over tasks, and what moves on does
    not depend on its length. Rows of series that are spread bring the series' length as __n.
    """
    keyed = _keyed(rows, by)
    schema = factor_schema(keyed, by)
    return keyed.mapInArrow(lambda batches: _factored(batches, by, schema.names), schema)


class Many:
    """The factors of several series, one a block: arrays (series, N_BLOCKS, ...)."""

    def __init__(self, t: pa.Table, by: Sequence[str], p: int, dim: int):
        self.p, self.dim, self.by = p, dim, list(by)
        codes, block = _codes(t, by), t["block"].to_numpy()
        each = [t[c].to_numpy().copy() for c in ("block", "first", "last", "n")]
        f = Factors(*each, _matrix(t, "plain").reshape(-1, p + dim, p + dim).copy(), _matrix(t, "weighted").reshape(-1, dim, p + 1, p + 1).copy(), _matrix(t, "sums").reshape(-1, 3, dim).copy())
        start = _starts([*codes, block])
        f, first = f.merged(start), _starts(codes)
        series = np.searchsorted(first, start, side="right") - 1
        self.keys = t.select(self.by).take(pa.array(first))
        size = (len(first), N_BLOCKS)
        put = lambda a, shape: _put(np.zeros((*size, *shape)), series, f.block, a)
        self.plain, self.weighted, self.sums = put(f.plain, f.plain.shape[1:]), put(f.weighted, f.weighted.shape[1:]), put(f.sums, f.sums.shape[1:])
        self.count = put(f.n, ()).astype(np.int64)
        self.first, self.last = put(f.first, ()).astype(np.int64), put(f.last, ()).astype(np.int64)
        self.n = self.count.sum(1)

    def __len__(self) -> int:
        return len(self.n)

    def roles(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """split -> (fit, holdout): which blocks of each series belong to them."""
        out = {x: (np.zeros(self.count.shape, bool), np.zeros(self.count.shape, bool)) for x in "ABCD"}
        for n in np.unique(self.n):
            at = np.flatnonzero(self.n == n)
            for split, parts in roles(int(n)).items():
                for mask, ranges in zip(out[split], parts, strict=True):
                    mask[at] = np.any([(self.first[at] >= a) & (self.last[at] <= b) & (self.count[at] > 0) for a, b in ranges], axis=0)
        return out

    def every(self) -> np.ndarray:
        return self.count > 0

    def plain_of(self, mask: np.ndarray) -> np.ndarray:
        a = self.plain * mask[:, :, None, None]
        return triangles(a.reshape(len(a), -1, a.shape[-1]))

    def weighted_of(self, mask: np.ndarray, eq: int) -> np.ndarray:
        a = self.weighted[:, :, eq] * mask[:, :, None, None]
        return triangles(a.reshape(len(a), -1, a.shape[-1]))

    def rows_of(self, mask: np.ndarray) -> np.ndarray:
        return (self.count * mask).sum(1)

    def mean_of(self, mask: np.ndarray, kind: int, eq: int) -> np.ndarray:
        """Mean over the masked blocks' rows of d (0), d^2 (1) or r^2 (2); nan without rows."""
        n = self.rows_of(mask)
        return np.where(n > 0, (self.sums[:, :, kind, eq] * mask).sum(1) / np.maximum(n, 1), np.nan)


def _put(out: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray) -> np.ndarray:
    out[i, j] = a
    return out


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solutions of a stack of systems a x = b."""
    if not a.shape[-1]:
        return np.zeros((len(a), 0))
    u, s, v = np.linalg.svd(a, full_matrices=False)
    small = s <= np.finfo(float).eps * max(a.shape[-2:]) * s[:, :1]
    return np.einsum("mkj,mk->mj", v, np.einsum("mik,mi->mk", u, b) * np.where(small, 0, 1 / np.where(small, 1, s)))


def ranks(a: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, condition number) of a stack of factors of so many rows."""
    if not a.shape[-1]:
        return np.zeros(len(a), int), np.full(len(a), np.inf)
    s = np.linalg.svd(a, compute_uv=False)
    top = s[:, :1]
    rank = ((s > np.minimum(rows, a.shape[-1])[:, None] * np.finfo(float).eps * top) & (top > 0)).sum(1)
    return rank, np.where(s[:, -1] > 0, s[:, 0] / np.where(s[:, -1] > 0, s[:, -1], 1), np.inf)


def residuals(r: np.ndarray, cols: Sequence[int], y: int, coef: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean squared residuals over the n rows behind each factor; Infinity without rows."""
    v = np.einsum("mij,mj->mi", r[:, :, list(cols)], coef) - r[:, :, y] if len(cols) else -r[:, :, y]
    return np.where(n > 0, (v * v).sum(1) / np.maximum(n, 1), np.inf)


def in_batches(src: DataFrame, p: int, dim: int, fn: Callable[[Many], dict[str, np.ndarray]], schema: str, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """The keys of each series with what fn(Many) tells of it: arrays over (series, ...) by name, one row an element.

    src: block factors, which are brought together by series, or rows for block_factors. Of rows without __n the series
    are factored and solved in one go, where their rows lie. Series come many at a time (at most SERIES), so that small
    systems of many series are solved together and memory does not depend on how many series a batch holds.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    plain_rows = "phi" in src.columns
    if plain_rows and "__n" in src.columns:
        src, plain_rows = block_factors(src, p, dim, by), False
    dealt = _keyed(src, by) if plain_rows else src.repartition(*by).sortWithinPartitions(*by, "block", "first")
    inner = factor_schema(dealt, by).names
    out = T.StructType([dealt.schema[c] for c in by] + list(T._parse_datatype_string(schema).fields))
    kinds = [to_arrow_type(f.dataType) for f in out.fields[len(by) :]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(_factored(batches, by, inner) if plain_rows else batches, by, SERIES):
            m = Many(t, by, p, dim)
            found = fn(m)
            shape = np.broadcast_shapes(*[np.shape(x) for x in found.values()])
            if not np.prod(shape):
                continue
            who = pa.array(np.repeat(np.arange(len(m)), int(np.prod(shape[1:]))))
            yield pa.RecordBatch.from_arrays([m.keys[c].combine_chunks().take(who) for c in by] + [pa.array(np.broadcast_to(found[c], shape).ravel().tolist(), kind) for c, kind in zip(names, kinds, strict=True)], names=out.names)

    return dealt.mapInArrow(work, out)


class Stack:
    """The factors of one series, by block."""

    def __init__(self, g: pd.DataFrame, p: int, dim: int):
        # a fixed order: sums and factors don't depend on how pieces arrive
        g = g.sort_values("first")
        self.p, self.dim = p, dim
        self.first, self.last = g["first"].to_numpy(), g["last"].to_numpy()
        self.count = g["n"].to_numpy()
        self.plain = np.stack(g["plain"].to_numpy()).reshape(-1, p + dim, p + dim)
        self.weighted = np.stack(g["weighted"].to_numpy()).reshape(-1, dim, p + 1, p + 1)
        self.sums = np.stack(g["sums"].to_numpy()).reshape(-1, 3, dim)
        self.n = int(self.count.sum())

    def rows(self, ranges: list[tuple[int, int]]) -> np.ndarray:
        return np.flatnonzero(np.any([(self.first >= a) & (self.last <= b) for a, b in ranges], axis=0))

    def plain_of(self, at: np.ndarray) -> np.ndarray:
        return triangle(self.plain[at].reshape(-1, self.p + self.dim))

    def weighted_of(self, at: np.ndarray, eq: int) -> np.ndarray:
        return triangle(self.weighted[at, eq].reshape(-1, self.p + 1))


def series_factors(factors: DataFrame, p: int, dim: int) -> DataFrame:
    """Block factors reduced to one plain factor a series: what a search over whole series needs, a few kB each."""

    def reduce(m: Many) -> dict:
        r = m.plain_of(m.every())
        first = lambda values: _objects(values.reshape(len(m), -1))
        # weights belong to splits, which are gone here
        nothing = np.zeros((len(m), dim, p + 1, p + 1))
        return {"block": np.zeros(len(m), int), "first": np.zeros(len(m), int), "last": m.n, "n": m.n, "plain": first(r), "weighted": first(nothing), "sums": first(m.sums.sum(1))}

    return in_batches(factors, p, dim, reduce, "block int, first int, last int, n int, plain array<double>, weighted array<double>, sums array<double>")


def _objects(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), object)
    out[:] = list(rows.tolist())
    return out


def solve(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares of a factor's columns."""
    return np.linalg.lstsq(r, y, rcond=None)[0] if r.shape[1] else np.zeros(0)


def rank_and_cond(r: np.ndarray, rows: int) -> tuple[int, float]:
    s = np.linalg.svd(r, compute_uv=False)
    if not len(s) or s[0] == 0:
        return 0, np.inf
    return int((s > min(rows, r.shape[1]) * np.finfo(float).eps * s[0]).sum()), float(s[0] / s[-1]) if s[-1] > 0 else np.inf


def residual(r: np.ndarray, cols: list[int], y: int, coef: np.ndarray, n: int) -> float:
    """Mean squared residual over the n rows behind a factor."""
    v = r[:, cols] @ coef - r[:, y] if cols else -r[:, y]
    return float(v @ v / n) if n else np.inf


def prepare(traj: DataFrame, basis: Sequence[Term], cols: Sequence[str], estimator: str = "central", weighting: str = "richardson_wls", by: Sequence[str] = ("traj_id",), rows: int | None = None, exact: Sequence[str] = ()) -> DataFrame:
    """Rows for block_factors: term values, derivatives, weights and error bounds of each state.

    exact: columns of known derivatives, which follow the estimated ones as further right-hand sides (bound 0, weight 1).
    One chain of windows by series. With `rows`, series are spread over tasks in ranges of so many rows: lengths and
    medians then come from grouped aggregates over the written error bounds (medians of longer series in passes), and the
    result brings __n.
    """
    from .derivatives import EPS, joined, medians, weight, with_errors

    out = with_errors(traj, cols, estimator, by, rows)
    weighted = weighting == "richardson_wls"
    if rows is not None:
        out = cut(out, "error-bounds")
        whole = medians(out, cols, by, max(rows, PIECE)) if weighted else out.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        out = joined(out, whole, by)
    elif weighted:
        over = Window.partitionBy(*by)
        out = out.select("*", *[F.percentile(F.col(f"r_{c}") * F.col(f"r_{c}"), F.lit(0.5)).over(over).alias(f"m_{c}") for c in cols])
    w = [weight(c, EPS) if weighted else F.lit(1.0) for c in cols]
    known = [F.col(c).cast("double") for c in exact]
    d, rich = [F.col(f"d_{c}") for c in cols] + known, [F.col(f"r_{c}") for c in cols] + [F.lit(0.0) for _ in known]
    return out.select(*by, "seq", *(["__n"] if rows is not None else []), F.array(*[t.column() for t in basis]).alias("phi"), F.array(*d).alias("d"), F.array(*rich).alias("rich"), F.array(*w, *[F.lit(1.0) for _ in known]).alias("w"))


def prepare_given(traj: DataFrame, basis: Sequence[Term], given: Sequence[str], by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Rows for block_factors with derivatives that are known (the columns `given`): no error bound, so no floor, and
    equal weights."""
    dim = len(given)
    return traj.select(*by, "seq", F.array(*[t.column() for t in basis]).alias("phi"), F.array(*[F.col(c).cast("double") for c in given]).alias("d"), F.array(*[F.lit(0.0)] * dim).alias("rich"), F.array(*[F.lit(1.0)] * dim).alias("w"))


def fit_ols(factors: DataFrame, p: int, dim: int, cols: Sequence[int] | None = None, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """by, eq, term (1-based), coef, mse, r2, rank: unweighted fit of the given columns (all) over whole series.

    factors: block factors, or rows for them."""
    use = list(cols if cols is not None else range(p))

    def fit(m: Many) -> dict:
        r, out = m.plain_of(m.every()), {}
        rank = ranks(r[:, :, use], m.n)[0]
        coef, mse, r2 = (np.zeros((len(m), dim, len(use))) for _ in range(3))
        for e in range(dim):
            coef[:, e] = least_squares(r[:, :, use], r[:, :, p + e])
            mse[:, e] = residuals(r, use, p + e, coef[:, e], m.n)[:, None]
            total, sq = m.sums[:, :, 0, e].sum(1), m.sums[:, :, 1, e].sum(1)
            sst = sq - total * total / m.n
            r2[:, e] = np.where(sst > 0, 1 - mse[:, e, 0] * m.n / np.where(sst > 0, sst, 1), np.nan)[:, None]
        out = {"eq": np.arange(1, dim + 1)[None, :, None], "term": np.array(use)[None, None, :] + 1, "coef": coef, "mse": mse, "r2": np.where(np.isnan(r2), None, r2), "rank": rank[:, None, None]}
        return out

    return in_batches(factors, p, dim, fit, "eq int, term int, coef double, mse double, r2 double, rank int", by)


def fit_ols_grouped(rows: DataFrame, p: int, dim: int) -> DataFrame:
    """The same fit on whole series gathered in one group each: the plain form for series that fit a task."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x, d = np.stack(g["phi"].to_numpy()), np.stack(g["d"].to_numpy())
        c = np.linalg.lstsq(x, d, rcond=None)[0]
        return pd.DataFrame([(int(key[0]), e + 1, t + 1, float(c[t, e])) for e in range(dim) for t in range(p)], columns=["traj_id", "eq", "term", "coef"])

    return rows.groupBy("traj_id").applyInPandas(run, "traj_id long, eq int, term int, coef double")


def fit_ridge(factors: DataFrame, p: int, dim: int, alpha: float = 1e-8, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Ridge coefficients from R'R + alpha I."""

    def fit(m: Many) -> dict:
        r = m.plain_of(m.every())
        x = r[:, :, :p]
        gram = np.einsum("mki,mkj->mij", x, x) + alpha * np.eye(p)
        coef = np.stack([least_squares(gram, np.einsum("mki,mk->mi", x, r[:, :, p + e])) for e in range(dim)], 1)
        return {"eq": np.arange(1, dim + 1)[None, :, None], "term": np.arange(1, p + 1)[None, None, :], "coef": coef}

    return in_batches(factors, p, dim, fit, "eq int, term int, coef double", by)


def warm_start(coefs: DataFrame, limit: float = 1e6) -> DataFrame:
    """Coefficients by (traj_id, eq), all zero if any is missing or not finite or their norm exceeds the limit."""
    w = Window.partitionBy("traj_id", "eq")
    ok = F.bool_and(F.coalesce(F.abs("coef") < INF, F.lit(False))).over(w) & (F.sqrt(F.sum(F.col("coef") * F.col("coef")).over(w)) <= limit)
    return coefs.withColumn("coef", F.when(F.coalesce(ok, F.lit(False)), F.col("coef")).otherwise(0.0))


def solve_stack(a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum-norm coefficients, mean squared residuals over n rows) of a stack of systems a x = b."""
    if not a.shape[-1]:
        return np.zeros((len(b), 0)), (b * b).sum(1) / n
    u, s, v = np.linalg.svd(a, full_matrices=False)
    small = s <= np.finfo(float).eps * max(a.shape[1:]) * s[:, :1]
    c = np.einsum("mkj,mk->mj", v, np.einsum("mik,mi->mk", u, b) * np.where(small, 0, 1 / np.where(small, 1, s)))
    e = np.einsum("mik,mk->mi", a, c) - b
    return c, (e * e).sum(1) / n


def solve_many(r: np.ndarray, cols: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum-norm coefficients, mean squared residuals) of the column sets cols (sets x k) against columns y, at once."""
    return solve_stack(r[:, cols].transpose(1, 0, 2), r[:, y].T, n)


#: (r, cols, y, n) -> (coefficients, residuals): how term sets of one size are fitted on a series' factor r of n rows. cols
#: (sets x k) are column numbers of r, y its right-hand columns.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _meeting(rows: DataFrame, factors: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's factors (first, n, plain) and then its rows in order, one after the other in one partition."""
    own = [c for c in rows.columns if c not in keys]
    above = factors.select(*keys, F.lit(0).alias("__kind"), "first", "n", "plain", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own])
    below = rows.select(*keys, F.lit(1).alias("__kind"), *[F.lit(None).cast(factors.schema[c].dataType).alias(c) for c in ("first", "n", "plain")], *own)
    return above.unionByName(below).repartition(*keys).sortWithinPartitions(*keys, "__kind", "first", *order)


def _met(batches: Iterator[pa.RecordBatch], keys: Sequence[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table, np.ndarray]]:
    """(whole factors, their rows, table, its rows' places among the factors) of many keys at a time; a key without factors
    or without rows is left out."""
    for t in _whole_groups(batches, keys):
        group = np.zeros(len(t), int)
        group[_starts(_codes(t, keys))[1:]] = 1
        group, above = np.cumsum(group), t["__kind"].to_numpy() == 0
        f, rows = t.filter(pa.array(above)), t.filter(pa.array(~above))
        if not len(f) or not len(rows):
            continue
        start = _starts([group[above]])
        known, count = group[above][start], np.diff(np.r_[start, len(f)])
        plain, r = _matrix(f, "plain").reshape(-1, size, size), np.zeros((len(start), size, size))
        for m in np.unique(count):
            at = np.flatnonzero(count == m)
            r[at] = triangles(plain[start[at][:, None] + np.arange(m)].reshape(len(at), -1, size))
        ours = np.isin(group[~above], known)
        yield r, np.add.reduceat(f["n"].to_numpy().astype(np.int64), start), rows.filter(pa.array(ours)), np.searchsorted(known, group[~above][ours])


def _term_sets(structures: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, columns): equation e of structure i has the columns[starts[i, e] : starts[i, e] + sizes[i, e]]."""
    each = structures.flatten()
    outer, inner = pc.list_value_length(structures).to_numpy(zero_copy_only=False), pc.list_value_length(each).to_numpy(zero_copy_only=False)
    # an equation that a structure doesn't name has no terms
    inner, eqs = np.r_[inner, 0].astype(np.int64), np.arange(dim)
    place = np.where(eqs < outer[:, None], (np.cumsum(outer) - outer)[:, None] + eqs, len(inner) - 1)
    return inner[place], (np.cumsum(inner) - inner)[place], each.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - 1


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct row, in the rows' order; the distinct row of each) of rows of small whole numbers."""
    most = [int(x) + 1 for x in rows.max(0)]
    code = rows[:, 0].astype(np.int64)
    if np.prod([float(x) for x in most]) < 2.0**62:
        for i in range(1, rows.shape[1]):
            code = code * most[i] + rows[:, i]
        return np.unique(code, return_index=True, return_inverse=True)[1:]
    _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


#: Reasons of a term set by 1 (coefficients not finite) or 2 (their norm), plus 3 (residual not finite).
_REASONS = pa.array(["", "non_finite_coefficients", "norm_limit", "non_finite_residual", "non_finite_coefficients;non_finite_residual", "norm_limit;non_finite_residual"])


def screen_sets(candidates: DataFrame, factors: DataFrame, p: int, dim: int, norm_limit: float = 1e6, most: int | None = None, solver: Solver = solve_many) -> DataFrame:
    """traj_id, cand_id, structure, n, and by equation n_params, residuals, reasons of candidates (cand_id, traj_id, structure);
    fits and shared: the candidate's term sets that were solved for it, and those that another one had asked for before.

    structure holds the term numbers of each equation. All term sets of one size are solved at once, of many series
    together (by a solver of one's own series by series), equal ones once. A set's terms are solved in ascending order, so
    that sets of the same terms tie exactly. Series meet their candidates in sorted partitions, in slices of SLICE
    candidates; with most, a known bound on the candidates of a series that is no larger, there is one slice.
    """
    if most is not None and most <= SLICE:
        slices, dealt = candidates.withColumn("__slice", F.lit(0).cast("long")), factors.withColumn("__slice", F.lit(0).cast("long"))
    else:
        slices = candidates.withColumn("__slice", F.floor(F.row_number().over(Window.partitionBy("traj_id").orderBy("cand_id")) / SLICE))
        wanted = candidates.groupBy("traj_id").agg(F.floor(F.count(F.lit(1)) / SLICE).alias("__most"))
        dealt = factors.join(wanted, "traj_id").withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__most")))).drop("__most")
    slices = slices.select(F.col("traj_id").cast("long").alias("traj_id"), "__slice", F.col("cand_id").cast("long").alias("cand_id"), F.col("structure").cast("array<array<int>>").alias("structure"))
    keys = ("traj_id", "__slice")
    names = ["traj_id", "cand_id", "structure", "n", "n_params", "residuals", "reasons", "fits", "shared"]

    def solved(r: np.ndarray, n: np.ndarray, who: np.ndarray, cols: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if solver is solve_many:
            return solve_stack(np.take_along_axis(r[who], cols[:, None, :], 2), r[who, :, y], n[who])
        c, mse, start = np.zeros(cols.shape), np.zeros(len(cols)), _starts([who])
        for i, j in zip(start, np.r_[start[1:], len(who)], strict=True):
            c[i:j], mse[i:j] = solver(r[who[i]], cols[i:j], y[i:j], int(n[who[i]]))
        return c, mse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, n, t, series in _met(batches, keys, p + dim):
            structures = t["structure"].combine_chunks()
            sizes, starts, terms = _term_sets(structures, dim)
            finite = np.isfinite(r).all((1, 2))
            residual, why, fits = np.full(sizes.size, INF), np.full(sizes.size, 4), np.zeros(len(t), np.int32)
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes.ravel() == k)
                who, eq, cols = series[at // dim], at % dim, terms[starts.ravel()[at][:, None] + np.arange(k)]
                first, which = _distinct(np.column_stack([who, eq, cols]))
                np.add.at(fits, at[first] // dim, 1)
                mse, code = np.full(len(first), INF), np.full(len(first), 4)
                good = np.flatnonzero(finite[who[first]])
                if len(good):
                    f = first[good]
                    c, m = solved(r, n, who[f], np.sort(cols[f], 1), p + eq[f])
                    with np.errstate(over="ignore", invalid="ignore"):
                        norm = np.sqrt((c * c).sum(1))
                    code[good] = np.where(~np.isfinite(norm), 1, np.where(norm > norm_limit, 2, 0)) + np.where(np.isfinite(m), 0, 3)
                    mse[good] = np.where(code[good] > 0, INF, m)
                residual[at], why[at] = mse[which], code[which]
            offsets = pa.array(np.arange(len(t) + 1, dtype=np.int32) * dim)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(sizes.ravel().astype(np.int32)), pa.array(residual), _REASONS.take(pa.array(why)))]
            yield pa.RecordBatch.from_arrays([t["traj_id"].combine_chunks(), t["cand_id"].combine_chunks(), structures, pa.array(n[series].astype(np.int32)), *lists, pa.array(fits), pa.array((dim - fits).astype(np.int32))], names=names)

    schema = "traj_id long, cand_id long, structure array<array<int>>, n int, n_params array<int>, residuals array<double>, reasons array<string>, fits int, shared int"
    return _meeting(slices, dealt.withColumn("traj_id", F.col("traj_id").cast("long")), keys, ["cand_id"]).mapInArrow(run, schema)


def screen(candidates: DataFrame, factors: DataFrame, p: int, dim: int, norm_limit: float = 1e6) -> DataFrame:
    """cand_id, traj_id, eq, n, n_params, residual, valid, reasons for candidates (cand_id, traj_id, structure)."""
    per = F.posexplode(F.arrays_zip("n_params", "residuals", "reasons")).alias("at", "x")
    rows = screen_sets(candidates, factors, p, dim, norm_limit).select("cand_id", "traj_id", "n", per)
    return rows.select("cand_id", "traj_id", (F.col("at") + 1).alias("eq"), "n", F.col("x.n_params").alias("n_params"), F.col("x.residuals").alias("residual"), (F.col("x.reasons") == "").alias("valid"), F.col("x.reasons").alias("reasons"))


def pool(screened: DataFrame) -> DataFrame:
    """One row per candidate: mean residual over equations (Infinity if any is invalid), parameters, distinct reasons."""
    ok = F.bool_and("valid")
    return screened.groupBy("traj_id", "cand_id").agg(
        F.max("n").alias("n"), F.sum("n_params").alias("n_params"), F.when(ok, F.avg("residual")).otherwise(F.lit(INF)).alias("residual"), ok.alias("valid"),
        F.concat_ws(";", F.array_sort(F.collect_set(F.when(F.col("reasons") != "", F.col("reasons"))))).alias("reasons"),
    )


def nmse(rows: DataFrame, keys: Sequence[str], obs: str, pred: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean squared error over the variance about the mean; Infinity for a variance of at most eps."""
    g = rows.groupBy(*keys).agg(F.avg((F.col(obs) - F.col(pred)) * (F.col(obs) - F.col(pred))).alias("mse"), F.var_pop(obs).alias("var"))
    return g.select(*keys, F.when(F.col("var") > eps, F.col("mse") / F.col("var")).otherwise(F.lit(INF)).alias("nmse"))


def eq_residual(rhs: DataFrame, deriv: DataFrame) -> DataFrame:
    """traj_id, eq, residual, ok: mean squared derivative residual of a fitted model; null and false if not finite.

    rhs: traj_id, seq, eq, rhs; deriv: traj_id, seq, eq, d.
    """
    g = rhs.join(deriv, ["traj_id", "seq", "eq"]).groupBy("traj_id", "eq").agg(F.avg((F.col("d") - F.col("rhs")) * (F.col("d") - F.col("rhs"))).alias("m"))
    ok = F.coalesce(F.abs("m") < INF, F.lit(False))
    return g.select("traj_id", "eq", F.when(ok, F.col("m")).alias("residual"), ok.alias("ok"))


def derivative_metrics(rows: DataFrame, edge: int = 2) -> DataFrame:
    """RMSE, MAE and MSE pooled over components, without `edge` rows at both ends of series long enough.

    rows: traj_id, seq, eq, d, rhs.
    """
    n = F.max("seq").over(Window.partitionBy("traj_id"))
    inner = rows.withColumn("__n", n).where((F.col("__n") <= 2 * edge) | ((F.col("seq") > edge) & (F.col("seq") <= F.col("__n") - edge)))
    e = F.col("d") - F.col("rhs")
    return inner.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def mse_loss(rows: DataFrame, keys: Sequence[str], obs: str, pred: str) -> DataFrame:
    """Mean squared error, or the sentinel if a prediction is missing or not finite."""
    e = F.col(obs) - F.col(pred)
    bad = F.bool_or(F.coalesce(~(F.abs(pred) < INF), F.lit(True)))
    return rows.groupBy(*keys).agg(F.when(bad, SENTINEL).otherwise(F.coalesce(F.avg(e * e), F.lit(SENTINEL))).alias("loss"))


def r2(rows: DataFrame, keys: Sequence[str], obs: str, pred: str, eq: str = "eq") -> DataFrame:
    """Mean R2 over dimensions; null if any dimension has no spread or the loss is at the sentinel."""
    mean = F.avg(obs).over(Window.partitionBy(*keys, eq))
    e, c = F.col(obs) - F.col(pred), F.col(obs) - F.col("__m")
    per = rows.withColumn("__m", mean).groupBy(*keys, eq).agg(F.sum(e * e).alias("sse"), F.sum(c * c).alias("sst"), F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    g = per.select(*keys, one.alias("one"), "sse", "n").groupBy(*keys).agg(F.every(F.col("one").isNotNull()).alias("all"), F.avg("one").alias("m"), (F.sum("sse") / F.sum("n")).alias("loss"))
    return g.select(*keys, F.when(F.col("all") & (F.col("loss") < SENTINEL), F.col("m")).alias("r2"), "loss")


def null_baseline(traj: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Loss of the constant prediction u(t) = u(first)."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    rows = traj.select("traj_id", *cols, *[F.first(c).over(w).alias(f"__{c}") for c in cols])
    pairs = rows.select("traj_id", F.explode(F.array(*[F.struct(F.col(c).alias("obs"), F.col(f"__{c}").alias("pred")) for c in cols])).alias("x")).select("traj_id", "x.*")
    return mse_loss(pairs, ["traj_id"], "obs", "pred")


def derive_support(factors: DataFrame, p: int, dim: int, absolute: float = 1e-9, relative: float = 1e-9, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """traj_id, eq, status, support: terms left after dropping them in ascending |coef| while the fit stays exact.

    factors: block factors, or rows for them.
    Exact: the RMS residual is within absolute + relative * RMS derivative. status: ok, or not_representable.
    """

    def fit(m: Many) -> dict:
        whole = m.plain_of(m.every())
        status, support = np.full((len(m), dim), "ok", object), np.empty((len(m), dim), object)
        for i in range(len(m)):
            r, n = whole[i], int(m.n[i])
            for e in range(dim):
                limit = absolute + relative * np.sqrt(m.sums[i, :, 1, e].sum() / n)
                good = lambda cols, c: np.sqrt(residual(r, cols, p + e, c, n)) <= limit  # noqa: B023, E731
                cols = list(range(p))
                c = solve(r[:, cols], r[:, p + e])
                if not good(cols, c):
                    status[i, e], support[i, e] = "not_representable", []
                    continue
                for t in np.argsort(np.abs(c), kind="stable").tolist():
                    less = [x for x in cols if x != t]
                    if good(less, solve(r[:, less], r[:, p + e])):
                        cols = less
                support[i, e] = [x + 1 for x in cols]
        return {"eq": np.arange(1, dim + 1)[None, :], "status": status, "support": support}

    return in_batches(factors, p, dim, fit, "eq int, status string, support array<int>", by)


def noise_floor(factors_true: DataFrame, exact: DataFrame) -> DataFrame:
    """traj_id, eq, split, role, floor: mean squared difference of estimated and exact derivatives per split role.

    factors_true: traj_id, seq, split, role; exact: traj_id, seq, eq, d, d_exact.
    """
    e = F.col("d") - F.col("d_exact")
    return factors_true.join(exact, ["traj_id", "seq"]).groupBy("traj_id", "eq", "split", "role").agg(F.avg(e * e).alias("floor"))
