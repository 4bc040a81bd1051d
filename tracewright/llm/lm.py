"""Language-model scoring with a log-frequency Bloom filter of quantised 1- and 2-gram counts.

Training counts meet in shards, ranges of the n-gram hash. A shard writes the bits of its own segment of the filter, sized
by what it stores, and forgets its counts; from then on levels come from membership probes of segments alone. Where the
filter's size is proven small from the texts' bytes it is broadcast, and workers probe it for the texts that they hold.
Beyond that each segment is probed where it lies: blocks (hashed groups of about BLOCK bytes of text) send their distinct
n-grams, and segments answer levels. Blocks and shards exchange rows over a butterfly of FAN ways a step, so rows grow as
the text times its number of steps (one up to FAN blocks), and every node of it holds about a block's n-grams.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .words import as_bytes, chunks, hash_words, mix64

BLOCK, SHARD = 16 << 20, 32 << 20
#: A filter goes to all workers if it can't have more bytes than this (it mostly has a tenth of what it could have).
BROADCAST = 128 << 20
#: Ways that one step of the exchange of blocks and shards may have.
FAN = 512
END = np.uint64(0xE2D0FE2D0FE2D0FE)
#: Counts are stored as 1 + floor(log_QBASE count); a filter has PROBES bits per stored level.
QBASE, PROBES = 1.5, 4
#: Bits of a segment for each stored level of a key: 1 - exp(-PROBES / LOAD) are set, so that about 6 of 10,000 absent
#: levels are hit by chance.
LOAD = 24
#: Keys that a filter works on at once.
STEP = 1 << 19
#: Bits of the keys, and what an answer to a key takes.
BITS, WIDTH = {"uni": 64, "bi": 48}, {"exact": "<i8", "level": "u1"}
#: Weight of the unigram estimate, in occurrences of the context.
PRIOR = 2.0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of each text): the words and then END."""
    h, n = hash_words(texts)
    ends = np.cumsum(n)
    return np.insert(h, ends, END), n + 1


def bigrams(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """48 bits for each token after the one before; END comes before the first."""
    before = np.r_[END, t[:-1]]
    before[np.cumsum(n)[:-1]] = END
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + t) >> np.uint64(16)


def shard_of(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The shard of sorted keys: equal ranges of their top 24 bits."""
    return (keys >> np.uint64(bits - 24)).astype(np.int64) * n >> 24


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte plane by byte plane, so that the leading zeros compress."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(QBASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    c = np.maximum((QBASE ** (level - 1) + QBASE**level - 1) / 2, 1)
    return np.where(level > 0, c, 0)


class Filter:
    """Bits of one segment; membership of (key, level) is told by PROBES of them."""

    def __init__(self, n_bits: int):
        self.seg = max(64, n_bits // 8 * 8)

    def places(self, keys: np.ndarray, level: int) -> list[np.ndarray]:
        h = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level))
        g = mix64(h) | np.uint64(1)
        return [((h + np.uint64(i) * g) % np.uint64(self.seg)).astype(np.int64) for i in range(PROBES)]

    def segment(self, keys: np.ndarray, counts: np.ndarray) -> bytes:
        on = np.zeros(self.seg, bool)
        for i in range(0, len(keys), STEP):
            k, q = keys[i : i + STEP], level_of(counts[i : i + STEP])
            for level in range(1, int(q.max(initial=0)) + 1):
                k, q = k[q >= level], q[q >= level]
                for p in self.places(k, level):
                    on[p] = True
        return np.packbits(on, bitorder="little").tobytes()

    def counts(self, data: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(data, keys))

    def levels(self, data: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Each key's level from membership probes of level 1, 2, ... until one is absent."""
        return np.concatenate([self._levels(data, keys[i : i + STEP]) for i in range(0, max(1, len(keys)), STEP)])

    def _levels(self, data: np.ndarray, keys: np.ndarray) -> np.ndarray:
        level, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, 200):
            here = np.ones(len(at), bool)
            for p in self.places(keys[at], q):
                here &= (data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            at = at[here]
            if not len(at):
                break
            level[at] = q
        return level


def filter_for(counts: np.ndarray) -> Filter:
    """A filter for keys of these counts."""
    return Filter(LOAD * int(level_of(counts).sum()))


def probe(segment: bytes, keys: np.ndarray) -> np.ndarray:
    """The levels of keys by a written segment alone."""
    return Filter(8 * len(segment)).levels(np.frombuffer(segment, np.uint8), keys)


def most_bytes(n_bytes: int, n_docs: int) -> int:
    """No filter of such texts has more bytes: a text of n bytes has at most (n + 1) / 2 words and an end, a key's level
    is at most its count, and both kinds of n-grams are stored."""
    return 2 * LOAD // 8 * ((n_bytes + n_docs) // 2 + n_docs)


def steps_for(blocks: int, shards: int) -> tuple[int, int]:
    """(steps, ways of each) of an exchange between blocks and shards."""
    n, steps, ways = max(blocks, shards), 1, 1
    while FAN**steps < n:
        steps += 1
    while ways**steps < n:
        ways += 1
    return steps, max(ways, 2)


PIECE = "kind string, grp int, rng int, part int, keys binary, counts binary"
ANSWER = "what string, kind string, part int, rng int, data binary, n long, distinct long"


def _cut(kind: str, keys: np.ndarray, counts: np.ndarray, part: int, *, shards: int, ways: int, width: int) -> list[tuple]:
    """Pieces of one part's keys for the nodes that hold its group's ranges, each of width shards."""
    n = -(-shards // width)
    at = np.searchsorted(shard_of(keys, BITS[kind], shards) // width, np.arange(n + 1))
    return [(kind, part // ways, r, part, pack_keys(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "grp", "rng", "part", "keys", "counts"])


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["what", "kind", "part", "rng", "data", "n", "distinct"])


def _gather(ask: bool, **to: int) -> Callable:
    """A block's distinct n-grams with their counts in training texts; without ask only 2-grams that training texts hold."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        texts, train = as_bytes(g["text"]), ~g["held_out"].to_numpy(bool)
        seen: dict[str, list] = {"uni": [], "bi": []}
        for i, j in chunks(texts):
            t, n = tokens(texts[i:j])
            learn = np.repeat(train[i:j], n)
            u, inv = np.unique(t, return_inverse=True)
            seen["uni"].append((u, np.bincount(inv, learn, len(u)).astype(np.int64)))
            b = np.sort(bigrams(t, n) << np.uint64(1) | learn)
            first = np.flatnonzero(np.diff(b >> np.uint64(1), prepend=~np.uint64(0)))
            seen["bi"].append((b[first] >> np.uint64(1), np.add.reduceat(b & np.uint64(1), first).astype(np.int64)))
        rows, block = [], int(g["block"].iloc[0])
        for kind, parts in seen.items():
            keys, counts = add_up(parts)
            if kind == "bi" and not ask:
                keys, counts = keys[counts > 0], counts[counts > 0]
            rows += _cut(kind, keys, counts, block, **to)
        return _pieces(rows)

    return run


def _unpack(g: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each piece; the distinct keys of all and their summed counts."""
    parts = [(unpack_keys(k), np.frombuffer(c, "<u4").astype(np.int64)) for k, c in zip(g["keys"], g["counts"], strict=True)]
    return [k for k, _ in parts], *add_up(parts)


def _pass_on(**to: int) -> Callable:
    """A node's pieces added up and cut for the next step."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        kind, grp, _ = key
        _, keys, counts = _unpack(g)
        return _pieces(_cut(kind, keys, counts, int(grp), **to))

    return run


def _hand_down(key: tuple, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Answers to a node's distinct keys dealt out to the parts that its pieces came from."""
    kind, _, rng = key
    pieces, keys, _ = _unpack(g)
    rows = []
    for what, a in answers.sort_values("rng").groupby("what"):
        data = np.frombuffer(b"".join(a["data"]), WIDTH[what])
        rows += [(what, kind, int(part), int(rng), data[np.searchsorted(keys, k)].tobytes(), 0, 0) for part, k in zip(g["part"], pieces, strict=True)]
    return _answers(rows)


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with their summed counts."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    if len(parts) == 1:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """A shard's segment with its totals, and exact counts of the 1-grams that each part asked for."""
    kind, _, shard = key
    pieces, keys, counts = _unpack(g)
    known = counts > 0
    segment = filter_for(counts[known]).segment(keys[known], counts[known])
    rows = [("segment", kind, -1, int(shard), segment, int(counts.sum()), int(known.sum()))]
    if kind == "uni":
        rows += [("exact", kind, int(part), int(shard), counts[np.searchsorted(keys, k)].astype("<i8").tobytes(), 0, 0) for part, k in zip(g["part"], pieces, strict=True)]
    return _answers(rows)


def _probe(key: tuple, g: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
    """Levels of the keys of each piece by the shard's segment."""
    kind, _, shard = key
    pieces = [unpack_keys(k) for k in g["keys"]]
    segment = segments["data"].iloc[0]
    return _answers([("level", kind, int(part), int(shard), probe(segment, k).astype(np.uint8).tobytes(), 0, 0) for part, k in zip(g["part"], pieces, strict=True)])


def _score(total: int, distinct: int, shards: int, told: Broadcast | None) -> Callable:
    floor = total + 0.5 * (distinct + 1)

    def run(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        answers = answers.sort_values("rng")

        def answer(what: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(answers["data"][(answers["what"] == what) & (answers["kind"] == kind)]), WIDTH[what])

        def soft_counts(kind: str, keys: np.ndarray) -> np.ndarray:
            if told is None:
                return count_of(answer("level", kind).astype(np.int64))
            at = np.searchsorted(shard_of(keys, BITS[kind], shards), np.arange(shards + 1))
            none = bytes(8)
            return count_of(np.concatenate([probe(told.value.get((kind, s), none), keys[a:b]) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]))

        texts, out = as_bytes(g["text"]), []
        parts = []
        for i, j in chunks(texts):
            t, n = tokens(texts[i:j])
            parts.append((i, j, t, n, *np.unique(bigrams(t, n), return_inverse=True)))
        words = np.unique(np.concatenate([np.unique(p[2]) for p in parts]))
        pairs = np.unique(np.concatenate([p[4] for p in parts]))
        exact, soft, soft2 = answer("exact", "uni"), soft_counts("uni", words), soft_counts("bi", pairs)
        base = np.log10((exact + 0.5) / floor)
        for i, j, t, n, seen, inv in parts:
            w, at = np.searchsorted(words, t), np.cumsum(n) - n
            before = np.r_[0, w[:-1]]
            before[at] = np.searchsorted(words, END)
            both = np.minimum(soft2[np.searchsorted(pairs, seen)][inv], soft[w])
            p = (both + PRIOR * (soft[w] + 0.5) / floor) / (np.maximum(soft[before], both) + PRIOR)
            out.append(pd.DataFrame({
                "doc_id": g["doc_id"].iloc[i:j], "held_out": g["held_out"].iloc[i:j], "n_tokens": n, "n_known": np.add.reduceat((exact[w] > 0).astype(np.int64), at), "train_tokens": total,
                "base_score": np.add.reduceat(base[w], at), "score": np.add.reduceat(np.log10(p), at),
            }))
        return pd.concat(out)

    return run


def score_documents(docs: DataFrame, *, block_bytes: int | None = None, shard_bytes: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Texts with crc32(doc_id as text) mod 5 = 1 are held out; the others train. base_score uses exact counts (words are
    told apart by 64-bit hashes); score mixes quantised 2-gram counts with the unigram estimate, both read from the
    filter. Null or empty text: the end token alone. Null doc_id: hashed as the empty string. Repeated rows count each
    (rows alike in doc_id and text lie in one block). Empty table: empty result. Other columns are not read.
    Blocks and shards hold about block_bytes and shard_bytes of text (BLOCK and SHARD); a task needs some ten times that.
    A filter that cannot exceed broadcast_bytes (BROADCAST) is broadcast; a larger one is probed in its shards, with the
    same result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n_bytes, n_docs = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks, shards = max(1, -(-n_bytes // (block_bytes or BLOCK))), max(1, -(-n_bytes // (shard_bytes or SHARD)))
    steps, ways = steps_for(blocks, shards)
    small = most_bytes(n_bytes, n_docs) <= (BROADCAST if broadcast_bytes is None else broadcast_bytes)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    src = src.withColumns({"held_out": held, "block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")})

    node, to = ["kind", "grp", "rng"], {"shards": shards, "ways": ways}
    pieces = [src.groupBy("block").applyInPandas(_gather(not small, width=ways ** (steps - 1), **to), PIECE)]
    for step in range(2, steps + 1):
        pieces[-1] = materialize(pieces[-1], "lm-pieces")
        pieces.append(pieces[-1].groupBy(*node).applyInPandas(_pass_on(width=ways ** (steps - step), **to), PIECE))

    counted = at_shards = pieces[-1].groupBy(*node).applyInPandas(_count, ANSWER)
    if not small:
        segments = counted.where("what = 'segment'").select("kind", F.lit(0).alias("grp"), "rng", "data")
        probed = pieces[-1].groupBy(*node).cogroup(segments.groupBy(*node)).applyInPandas(_probe, ANSWER)
        at_shards = counted.withColumn("data", F.when(F.col("what") != "segment", F.col("data"))).unionByName(probed)
    at_shards = materialize(at_shards, "lm-counts")
    total, distinct = at_shards.where("what = 'segment' and kind = 'uni'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = None
    if small:
        told = spark.sparkContext.broadcast({(r["kind"], r["rng"]): bytes(r["data"]) for r in at_shards.where("what = 'segment'").collect()})

    answers = at_shards.where("what != 'segment'")
    for p in reversed(pieces[:-1]):
        above = answers.withColumns({"grp": F.col("part"), "over": F.floor(F.col("rng") / ways).cast("int")})
        answers = p.groupBy(*node).cogroup(above.groupBy("kind", "grp", "over")).applyInPandas(_hand_down, ANSWER)
    answers = answers.select("what", "kind", F.col("part").alias("block"), "rng", "data")
    scored = src.groupBy("block").cogroup(answers.groupBy("block"))
    return scored.applyInPandas(_score(int(total), int(distinct), shards, told), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
