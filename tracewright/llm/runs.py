"""Periodic runs of words: suffix automaton of a text, with link-cut access recolouring last occurrences along link paths.

The automaton's link tree holds every substring at a node; its path from the root to the node of a prefix holds that
prefix's suffixes. Words are appended one by one: access to the node of the prefix gives the whole path the colour of the
new end. Each segment of another colour that is met on the way says that its longest string ended there before. If the
distance of both ends is within that length, the text holds a square; its run is followed until it ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, table
from .words import chunks

#: A run repeats its period at least so often, and has at least so many words.
TIMES, SHORTEST = 4, 6
#: Rounds of thinning out words that no run can hold; it only saves work, so stopping early loses nothing.
ROUNDS = 12
#: Bytes of text whose words are numbered together.
PART = 4_000_000

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
#: (words, key) -> words
Edit = Callable[[list[bytes], object], list[bytes]]


def link_tree(codes: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length) of the states of the automaton of codes, and the state of each prefix."""
    link, length, to, ends, last = [-1], [0], [{}], [], 0
    for c in codes:
        new = len(link)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(to[q].copy())
                link[q] = link[new] = clone
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
        ends.append(new)
        last = new
    return link, length, ends


def runs_of(codes: Sequence[int], times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least max(shortest, times * period) symbols, sorted.

    times is at least 3: then the longest repeated suffix at a run's end last occurred exactly one period before, so the
    segment that access meets there gives period and start exactly. Preferred paths are splay trees, ordered by depth; a
    path has one colour, kept at its splay root. Accesses cost O(log n) amortised; memory grows with the length.
    """
    if times < 3:
        raise ValueError("times must be at least 3")
    link, length, ends = link_tree(codes)
    n = len(link)
    up, left, right, colour = [-1, *[x for x in link[1:]]], [-1] * n, [-1] * n, [0] * n
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        """x becomes the root of its path's tree and takes over the colour."""
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if not inner:
                colour[x] = colour[p]
                turn(x, p, g)
                return
            if not (up[g] >= 0 and (left[up[g]] == g or right[up[g]] == g)):
                colour[x] = colour[g]
            if (left[g] == p) == (left[p] == x):
                turn(p, g, up[g])
                turn(x, p, up[p])
            else:
                turn(x, p, g)
                turn(x, g, up[g])

    def turn(x: int, p: int, g: int) -> None:
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    for i, v in enumerate(ends, 1):
        below, x = -1, v
        while x > 0:
            splay(x)
            before, deep = colour[x], right[x]
            if deep >= 0:
                colour[deep] = before
            if before:
                d, reach = i - before, length[x]
                if reach >= (times - 1) * d and reach + d >= shortest:
                    found[(i - d - reach, d)] = i
            right[x] = below
            below, x = x, up[x]
        if below >= 0:
            colour[below] = i
    return sorted((start, end - start, d) for (start, d), end in found.items())


def segments(doc: np.ndarray, code: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that may hold runs, of words numbered alike (code) in documents numbered in order (doc).

    Every word of a run occurs `times` times in it, so other words of a stretch part it; the parts are looked at again.
    """
    alive = np.arange(len(code))
    for _ in range(ROUNDS):
        if not len(alive):
            return
        seg = np.cumsum(np.r_[True, (np.diff(alive) != 1) | (np.diff(doc[alive]) != 0)]) - 1
        _, at, n = np.unique(seg * (int(code.max()) + 1) + code[alive], return_inverse=True, return_counts=True)
        keep = (n[at] >= times) & (np.bincount(seg)[seg] >= shortest)
        if keep.all():
            break
        alive = alive[keep]
    if len(alive):
        cut = np.flatnonzero((np.diff(alive) != 1) | (np.diff(doc[alive]) != 0)) + 1
        for part in np.split(alive, cut):
            if len(part) >= shortest:
                yield int(part[0]), int(part[-1]) + 1


def _many(docs: list[list[bytes]], times: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = np.array([len(x) for x in docs], np.int64)
    first, out = np.r_[0, np.cumsum(sizes)], [[] for _ in docs]
    if not first[-1]:
        return out
    flat = np.empty(int(first[-1]), object)
    flat[:] = [w for x in docs for w in x]
    code, _ = pd.factorize(flat)
    doc = np.repeat(np.arange(len(docs)), sizes)
    for i, j in segments(doc, code.astype(np.int64), times, shortest):
        d = int(doc[i])
        out[d] += [(s + i - int(first[d]), n, q) for s, n, q in runs_of(code[i:j].tolist(), times, shortest)]
    return [sorted(x) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that some run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None, edit: Edit | None = None, times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """The columns `keep` of docs (default: all but text) with n_words long, runs array<start, length, period> and collapsed string.

    Words are maximal stretches without ASCII white space, compared byte by byte and numbered from 0. A run is a maximal
    stretch of at least max(shortest, times * period) words with that smallest period; runs are sorted. collapsed joins by
    one space the words that no run holds after its first period. edit, if given, changes a text's words first.
    Null or blank text: no words, no runs, empty string. Repeated rows each get their result; empty table: empty result.
    Columns of docs named n_words, runs or collapsed are replaced. Rows are worked on where they are read, without a
    shuffle; one text is one task's work, in memory proportional to it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed") and (keep is not None or c != text)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{key}`").alias("__tw_key"), F.col(f"`{text}`").cast("binary").alias("__tw_text"))
    kind = pa.list_(pa.struct([pa.field(n, pa.int64(), nullable=False) for n in RUN.names]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(len(keep) + 1).to_pylist()]
            ids = b.column(len(keep)).to_pylist() if edit else []
            for i, j in chunks(texts, PART):
                words = [x.split() for x in texts[i:j]]
                if edit:
                    words = [edit(w, k) for w, k in zip(words, ids[i:j])]
                runs = _many(words, times, shortest)
                told = pa.array([[dict(zip(RUN.names, r)) for r in x] for x in runs], kind)
                short = pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary())
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([len(w) for w in words], pa.int64()), told, short], names=names)
        release()

    out = T.StructType([*src.schema.fields[: len(keep)], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, True)), T.StructField("collapsed", T.BinaryType())])
    names = out.names
    return src.mapInArrow(work, out).withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(words: list[bytes], key: object) -> list[bytes]:
    """One document in ten ends in repetitions of a stretch of its own, placed by the checksum of its key (null: empty)."""
    g, tenth = divmod(zlib.crc32(str("" if key is None else key).encode()), 10)
    n = len(words)
    if tenth or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and checksums of find_runs' result."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    longest = [(-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"), F.floor(F.lit(1000) * F.col("b.length") / (-F.col("b.p"))).cast("long").alias("exponent_milli")]
    return one.select("doc_id", "n_runs", *longest, "runs_sha256", "collapsed_sha256")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], edit=looped))
