"""Near-duplicate documents by b-bit MinHash: bands give candidates, packed low bits filter, full sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table
from .components import connected_components
from .words import as_bytes, chunks, hash_words, mix64

#: 24 bands of 4 minima: a pair of similarity 0.8 meets in no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS, LOW_BITS = 24, 4, 4
HASHES = BANDS * ROWS
LONGS = HASHES * LOW_BITS // 64
#: A pair goes on to the exact check from this estimate on: five standard deviations under 0.8.
MARGIN = 0.2
#: Members of a bucket that are compared with as many outsiders in one group, and members that share a copy of their centre.
TILE, FAN = 256, 256
#: Rows of the groups that small tiles and stars share.
CROWD = 1024
_rng = np.random.default_rng(1597)
_MUL = _rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
SIGS = [f"s{i}" for i in range(LONGS)]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; with fewer words, of the whole sequence."""
    h, n = hash_words(texts)
    if not len(h):
        return [h] * len(texts)
    s = h.copy()
    for j in range(1, k):
        s[: len(s) - j] = mix64(s[: len(s) - j] * np.uint64(0x2545F4914F6CDD1D) + h[j:])
    out, at = [], 0
    for c in n.tolist():
        if c >= k:
            out.append(np.unique(s[at : at + c - k + 1]))
        elif c:
            x = np.array([c], np.uint64)
            for v in h[at : at + c]:
                x = mix64(x * np.uint64(0x2545F4914F6CDD1D) + v)
            out.append(x)
        else:
            out.append(h[:0])
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of sets that aren't empty: int64 arrays of LONGS and BANDS columns."""
    x = mix64(np.concatenate(sets)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    minima = np.empty((len(sets), HASHES), np.uint64)
    for j in range(HASHES):
        minima[:, j] = np.minimum.reduceat(x * _MUL[j] + _ADD[j], at)
    low = mix64(minima + np.uint64(1)) & np.uint64((1 << LOW_BITS) - 1)
    per = 64 // LOW_BITS
    packed = np.zeros((len(sets), LONGS), np.uint64)
    for j in range(HASHES):
        packed[:, j // per] |= low[:, j] << np.uint64(LOW_BITS * (j % per))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.broadcast_to(keys, (len(sets), BANDS))
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(3) + minima[:, r::ROWS])
    return packed.view(np.int64), np.ascontiguousarray(keys).view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), as_bytes(b["text"])
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j], k)
                full = [x for x in sets if len(x)]
                sig, bands = signatures(full) if full else (np.zeros((0, LONGS), np.int64), np.zeros((0, BANDS), np.int64))
                n = np.array([len(x) for x in sets])
                out = pd.DataFrame({"doc_id": ids[i:j], "n": n, "set_id": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]})
                row = np.cumsum(n > 0) - 1
                for c in range(LONGS):
                    out[SIGS[c]] = sig[row, c] if len(full) else 0
                out["bands"] = [bands[r].tolist() if m else [] for r, m in zip(row.tolist(), n.tolist(), strict=True)]
                yield out
        release()

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), set_id (null if none), packed low bits s0.., bands."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return src.mapInPandas(_sketch(k), "doc_id long, n long, set_id binary, " + ", ".join(f"{s} long" for s in SIGS) + ", bands array<long>")


def estimate(left: str, right: str) -> Column:
    """Similarity from equal low-bit groups, corrected for groups that are equal by chance."""
    ones = F.lit(sum(1 << (LOW_BITS * i) for i in range(64 // LOW_BITS)))
    differ = F.lit(0)
    for s in SIGS:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        y = x
        for r in range(1, LOW_BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, r))
        differ = differ + F.bit_count(y.bitwiseAND(ones))
    chance = 2.0**-LOW_BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _links(sets: list[np.ndarray], i: int, j: int, percent: int) -> bool:
    inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return bool(inter) and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter)


def _parts(g: pd.DataFrame, *by: str) -> Iterator[np.ndarray]:
    """Row numbers of the groups by the integer columns `by`: many small groups come to a task as one frame."""
    cols = [g[c].to_numpy() for c in reversed(by)]
    order = np.lexsort(cols)
    new = np.any([np.diff(c[order]) != 0 for c in cols], axis=0)
    yield from np.split(order, np.flatnonzero(new) + 1)


def _verify(k: int, percent: int):
    """The members of a part of a star whose full sets reach the similarity with the centre's, whose text is the row a = b."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b, texts, keep = g["a"].to_numpy(), g["b"].to_numpy(), as_bytes(g["text"]), []
        for at in _parts(g, "b", "part"):
            at = at[np.argsort(a[at] != b[at], kind="stable")]
            own = [texts[i] for i in at]
            sets = [x for i, j in chunks(own) for x in shingle_sets(own[i:j], k)]
            keep += [int(at[i]) for i in range(1, len(sets)) if _links(sets, 0, i, percent)]
        release()
        return pd.DataFrame({"a": a[keep], "b": b[keep]})

    return run


def similar(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Corrected estimates of the similarity of each row of packed bits with one."""
    ones, chance = np.uint64(sum(1 << (LOW_BITS * i) for i in range(64 // LOW_BITS))), 2.0**-LOW_BITS
    x = sig ^ one
    y = x.copy()
    for s in range(1, LOW_BITS):
        y |= x >> np.uint64(s)
    return (1 - np.bitwise_count(y & ones).sum(axis=1) / HASHES - chance) / (1 - chance)


class Rows:
    """The columns of tile rows as arrays."""

    def __init__(self, g: pd.DataFrame):
        self.comp, self.rep, self.bucket = (g[c].to_numpy() for c in ("component", "rep", "bucket"))
        self.asks, self.own, self.outer = (g[c].to_numpy(bool) for c in ("asks", "own", "outer"))
        self.sig, self.bands = g[SIGS].to_numpy(np.int64).view(np.uint64), np.stack(g["bands"].to_numpy())

    def pairs(self, at: np.ndarray, cut: float) -> list[tuple[float, int, int]]:
        """(estimate, outsider, other) of the rows `at` of one tile that may be linked, best first.

        A pair of members is looked at in the first band that both share, so in one bucket only; of two outsiders the
        smaller one asks.
        """
        comp, rep, sig, bands, out = self.comp[at], self.rep[at], self.sig[at], self.bands[at], []
        band = int((bands[0] == self.bucket[at[0]]).argmax())
        for r in np.flatnonzero(self.asks[at]):
            est = similar(sig, sig[r])
            hit = np.flatnonzero(self.own[at] & (comp != comp[r]) & ~(self.outer[at] & (rep < rep[r])) & (est >= cut))
            hit = hit[(bands[hit] == bands[r]).argmax(axis=1) == band] if len(hit) else hit
            out += zip(est[hit].tolist(), [int(at[r])] * len(hit), at[hit].tolist())
        return sorted(out, key=lambda x: (-x[0], self.rep[x[1]], self.rep[x[2]]))


TILE_KEY = ("bucket", "chunk", "slice")


def _likely(cut: float):
    """Rows of tiles that have a likely partner in another component: only their texts are fetched."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, keep = Rows(g), []
        for at in _parts(g, *TILE_KEY):
            keep += sorted({i for _, r, o in rows.pairs(at, cut) for i in (r, o)})
        return g.iloc[keep]

    return run


def _tile(cut: float, k: int, percent: int):
    """Confirmed links between components within each tile; enough of them to join what is linked.

    Likely pairs are confirmed on full sets, best estimates first; a pair whose members were joined meanwhile needs no
    check.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, texts, found = Rows(g), as_bytes(g["text"]), []
        comp, rep = rows.comp, rows.rep
        for at in _parts(g, *TILE_KEY):
            root = {c: c for c in comp[at].tolist()}

            def find(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = c = root[root[c]]  # noqa: B023
                return c

            sets: dict[int, np.ndarray] = {}
            for _, i, j in rows.pairs(at, cut):
                a, b = find(comp[i]), find(comp[j])
                if a == b:
                    continue
                for m in (i, j):
                    if m not in sets:
                        sets[m] = shingle_sets([texts[m]], k)[0]
                if _links(sets, i, j, percent):
                    root[a] = b
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        release()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


class NearDuplicates:
    """One run over docs (doc_id, text); attributes are written tables that later steps read."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80):
        self.docs, self.k, self.percent = docs, k, percent
        self.cut = percent / 100 - MARGIN
        self.sketch = materialize(sketches(docs, k), "near-sketch")
        ids = self.sketch.where("set_id is not null and doc_id is not null")
        same = ids.groupBy("set_id").agg(F.min("doc_id").alias("rep"), *[F.first(s).alias(s) for s in SIGS], F.first("bands").alias("bands"))
        self.sets = materialize(same, "near-sets")
        keys = self.sets.select("rep", F.explode("bands").alias("bucket"))
        # a bucket's centre is its smallest document; buckets of one leave here
        shared = materialize(keys.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
        self.members = materialize(keys.join(shared, "bucket"), "near-members")

    def texts_of(self, named: DataFrame) -> DataFrame:
        """doc_id and text of the named documents, written: only these texts are shuffled on."""
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        return materialize(texts.join(materialize(named.distinct(), "near-named"), "doc_id", "left_semi"), "near-texts")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of members and centres whose full sets reach the similarity.

        A centre's text goes once to every FAN of its members, not once to each.
        """
        sizes = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts")), "near-stars")
        dealt = materialize(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), "near-pairs")
        both = dealt.unionByName(dealt.select(F.col("b").alias("a"), "b", "part").distinct())
        texts = self.texts_of(both.select(F.col("a").alias("doc_id")))
        rows = both.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
        crowd = F.pmod(F.xxhash64("b", "part"), F.lit(1 + dealt.count() // CROWD)).alias("crowd")
        return materialize(rows.select("*", crowd).groupBy("crowd").applyInPandas(_verify(self.k, self.percent), "a long, b long"), "near-links")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose packed bits say that they may reach the similarity."""
        sig = self.sets.select("rep", *SIGS)
        rows = pairs.join(sig.select(F.col("rep").alias("a"), F.struct(*SIGS).alias("x")), "a")
        rows = rows.join(sig.select(F.col("rep").alias("b"), F.struct(*SIGS).alias("y")), "b")
        return rows.where(estimate("x", "y") >= self.cut).select("a", "b")

    def links(self) -> DataFrame:
        """Links (a, b) between set representatives with the same components as all links.

        First every member of a bucket is compared with the bucket's centre. Then each bucket whose members lie in more
        than one component is searched in full, with no cap: its outsiders, who are not in its largest component, meet
        all its members in tiles of TILE outsiders and TILE members. Tiles hold packed bits; texts are fetched only for
        rows that have a likely partner there. Links inside one component are not needed and not listed.
        """
        star = self.members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
        first = self.confirmed(self.likely(star))
        comp = materialize(connected_components(first), "near-components")
        # two members were compared above
        named = materialize(self.members.where("size > 2").join(comp, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "near-named")
        parts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = F.max_by("component", F.struct("n", F.negate("component")))
        open_ = parts.groupBy("bucket").agg(largest.alias("most"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outsiders")).where("outsiders > 0")
        open_ = materialize(open_.select("bucket", "most", F.ceil(F.col("members") / TILE).cast("int").alias("slices"), F.ceil(F.col("outsiders") / TILE).cast("int").alias("chunks")), "near-open")
        rows = named.join(open_, "bucket").withColumns({"outer": F.col("component") != F.col("most"), "h": F.xxhash64("rep")})
        rows = rows.withColumns({"c": F.pmod("h", F.col("chunks")).cast("int"), "s": F.pmod(F.xxhash64("h"), F.col("slices")).cast("int")})
        # a member stands once in the tiles of its slice; an outsider asks in the tiles of its chunk
        asked = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.col("c").alias("chunk"), s.alias("slice"), F.lit(True).alias("asks"), (s == F.col("s")).alias("own")))
        given = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.col("s").alias("slice"), F.lit(False).alias("asks"), F.lit(True).alias("own")))
        given = F.when(F.col("outer"), F.filter(given, lambda x: x["chunk"] != F.col("c"))).otherwise(given)
        places = F.when(F.col("outer"), F.concat(asked, given)).otherwise(given)
        rows = rows.select("bucket", "rep", "component", "outer", F.explode(places).alias("p")).select("bucket", "rep", "component", "outer", "p.*")
        rows = materialize(rows, "near-tiles")
        crowd = F.pmod(F.xxhash64(*TILE_KEY), F.lit(1 + rows.count() // CROWD))
        schema = "bucket long, chunk int, slice int, rep long, component long, outer boolean, asks boolean, own boolean, crowd long, " + ", ".join(f"{s} long" for s in SIGS) + ", bands array<long>"
        full = rows.withColumn("crowd", crowd).join(self.sets.select("rep", "bands", *SIGS), "rep").select(*[c.split()[0] for c in schema.split(", ")])
        likely = materialize(full.groupBy("crowd").applyInPandas(_likely(self.cut), schema), "near-likely")
        texts = self.texts_of(likely.select(F.col("rep").alias("doc_id")))
        second = likely.join(texts.withColumnRenamed("doc_id", "rep"), "rep").groupBy("crowd").applyInPandas(_tile(self.cut, self.k, self.percent), "a long, b long")
        return first.unionByName(second)

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: one row per row of docs."""
        comp = connected_components(self.links())
        named = self.sets.join(comp, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
        rows = self.sketch.select("doc_id", "n", "set_id").join(materialize(named, "near-classes"), "set_id", "left")
        rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their k-word shingle sets.

    Texts with equal sets are one class member before any pair is formed. Null, empty and blank texts have no shingle
    and no link. Rows with a null doc_id link with nothing, keep a null component and are kept. doc_id is taken to name a
    document: rows that repeat it share its class. Empty table: empty result. Other columns are not read.
    """
    return NearDuplicates(docs, k, percent).components()


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that near_duplicates doesn't keep, and with one row of each repeated doc_id.

    Null and empty texts are linked with nothing and stay; so do rows without a doc_id. Of rows that repeat a doc_id any one
    stays. Empty table: empty result. All columns of docs pass through under their names.
    """
    found = NearDuplicates(docs, k, percent)
    gone = materialize(found.components().where("not kept").select("doc_id").distinct(), "near-gone")
    rest = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = materialize(found.sketch.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-twice")
    if twice.isEmpty():
        return rest
    return rest.join(twice, "doc_id", "left_anti").unionByName(rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
