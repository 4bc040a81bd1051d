"""Quality classifier: interpolated modified Kneser-Ney over character 5-grams, trained on trusted text.

Code points have symbols of their own up to the Indic scripts, later ones share 512 by hash. The model is bounded by its
sample of trusted documents and kept in SHARDS shards by a gram's second-last symbol, so that a gram, all its shorter
forms and all their contexts lie in one shard. Documents meet it in blocks: a block sends its distinct grams to the
shards, which answer log probabilities. Nothing of the corpus's size passes the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_size, hash32, lowest, materialize, release, table
from .lm import pack_keys, unpack_keys

ORDER, WIDTH = 5, 12
SYMBOLS = 1 << WIDTH
#: Code points under this one are symbols; 0 is also the edge of a text.
EXACT = SYMBOLS - 512
SHARDS = 16
#: Bytes of text in a block, and blocks that ask one copy of a shard.
BLOCK, ASKING = 8 << 20, 64
#: Most trusted rows that train the model, those of the lowest hashes of their ids; one in HELD of all is left out of it.
SAMPLE, HELD = 20_000, 5
#: Quantiles of trusted documents' perplexities, per language, outside which a document goes.
QUANTILES = (0.002, 0.995)
#: Languages with fewer trusted documents take the quantiles of all languages.
LEAST = 50
CHUNK = 500_000
OWN = ("qc_", "__tw_")


def mask(order: int) -> np.uint64:
    return np.uint64((1 << WIDTH * order) - 1)


def _packed(text: str) -> np.ndarray:
    """The gram that ends at each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(points < EXACT, points, EXACT + (points * np.uint32(2654435761) >> np.uint32(23))).astype(np.uint64)
    g = c.copy()
    for k in range(1, ORDER):
        g[k:] |= c[:-k] << np.uint64(WIDTH * k)
    return g & mask(ORDER)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram ending at each character and at the text's end, how many of each text)."""
    edge = "\0" * (ORDER - 1)
    g = _packed(edge + edge.join(texts) + edge)
    n = np.array([len(t) for t in texts])
    # texts stand ORDER - 1 edges apart; the first edge after a text is its end
    starts = np.cumsum(np.r_[0, n[:-1] + ORDER - 1]) + ORDER - 1
    keep = np.repeat(starts - np.cumsum(np.r_[0, n[:-1] + 1]), n + 1) + np.arange(int((n + 1).sum()))
    return g[keep], n + 1


def runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, their grams, how many of each) of runs of about CHUNK characters; a longer text comes in
    slices that overlap by a context."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= CHUNK:
            for at in range(0, len(t) + 1, CHUNK):
                lead = t[max(0, at - ORDER + 1) : at].rjust(ORDER - 1, "\0")
                g = _packed(lead + t[at : at + CHUNK] + ("\0" if at + CHUNK > len(t) else ""))[ORDER - 1 :]
                yield np.array([i]), g, np.array([len(g)])
            continue
        if size + len(t) > CHUNK:
            yield np.array(batch), *grams([texts[j] for j in batch])
            batch, size = [], 0
        batch.append(i)
        size += len(t) + 1
    if batch:
        yield np.array(batch), *grams([texts[j] for j in batch])


def shard_of(symbol: np.ndarray) -> np.ndarray:
    return (symbol * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(28)


def keyed(g: np.ndarray) -> np.ndarray:
    """The gram under its shard's number, so that sorted keys lie shard by shard."""
    return shard_of(g >> np.uint64(WIDTH) & mask(1)) << np.uint64(60) | g


def block_keys(texts: list[str]) -> np.ndarray:
    """Sorted distinct keys of a block's grams."""
    parts = [np.unique(keyed(g)) for _, g, _ in runs(texts)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, g, _ in runs([t or "" for t in b.column(0).to_pylist()]):
            u, n = np.unique(g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])
    release()


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of rows of labels that are of quality 1 and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def training_ids(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id of at most `most` trusted rows by the hash of their ids; one in HELD is never among them."""
    return lowest(trusted(labels).where(hash32(F.lit("held"), F.col("doc_id")) % HELD != 0), most)


class KneserNey:
    """Probabilities p of all seen grams and weights of their contexts by order, from joins of written count tables."""

    def __init__(self, texts: DataFrame):
        raw = texts.select("text").mapInArrow(_count, "g long, n long").groupBy("g").agg(F.sum("n").alias("a"))
        counts: dict[int, DataFrame] = {}
        self.discounts: dict[int, list[float]] = {}
        for order in range(ORDER, 0, -1):
            # below the top, a count is the number of distinct symbols seen before the gram
            counts[order] = materialize(raw, f"kn{order}")
            m = counts[order].agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)]).first()
            n1, n2, n3, n4 = (float(m[f"n{i}"]) for i in range(1, 5))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            self.discounts[order] = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            raw = counts[order].groupBy(F.col("g").bitwiseAND(int(mask(order - 1))).alias("g")).agg(F.count(F.lit(1)).alias("a"))
        self.grams: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        for order in range(1, ORDER + 1):
            context = F.shiftright("g", WIDTH).alias("c")
            left = self._discount(self.discounts[order])
            self.contexts[order] = materialize(counts[order].groupBy(context).agg(F.sum("a").alias("total"), (F.sum(left) / F.sum("a")).alias("weight")), f"kn{order}-context")
            rows = counts[order].select("g", context, (F.col("a") - left).alias("over")).join(self.contexts[order], "c")
            if order == 1:
                below = F.lit(1.0 / SYMBOLS)
            else:
                rows = rows.withColumn("k", F.col("g").bitwiseAND(int(mask(order - 1)))).join(self.grams[order - 1].select(F.col("g").alias("k"), F.col("p").alias("below")), "k")
                below = F.col("below")
            self.grams[order] = materialize(rows.select("g", (F.col("over") / F.col("total") + F.col("weight") * below).alias("p")), f"kn{order}-p")

    @staticmethod
    def _discount(over: list[float]) -> Column:
        a = F.col("a")
        return F.when(a == 1, over[0]).when(a == 2, over[1]).otherwise(over[2])

    def shards(self) -> DataFrame:
        """shard, kind (p or weight), order, keys and their logarithms, packed: at most 2 * ORDER rows a shard."""
        number = lambda symbol: F.shiftright((symbol * F.lit(0x9E3779B1)).bitwiseAND(0xFFFFFFFF), 28).cast("int").alias("shard")
        low = F.lit(SYMBOLS - 1)
        rows = self.grams[1].select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit("p").alias("kind"), F.lit(1).alias("order"), "g", F.log("p").alias("v"))
        rows = rows.unionByName(self.contexts[1].select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit("weight").alias("kind"), F.lit(1).alias("order"), F.col("c").alias("g"), F.log("weight").alias("v")))
        for order in range(2, ORDER + 1):
            last = F.shiftright("g", WIDTH).bitwiseAND(low)
            rows = rows.unionByName(self.grams[order].select(number(last), F.lit("p").alias("kind"), F.lit(order).alias("order"), "g", F.log("p").alias("v")))
            rows = rows.unionByName(self.contexts[order].select(number(F.col("c").bitwiseAND(low)), F.lit("weight").alias("kind"), F.lit(order).alias("order"), F.col("c").alias("g"), F.log("weight").alias("v")))
        return rows.groupBy("shard", "kind", "order").applyInPandas(_pack, "shard int, kind string, order int, g binary, v binary")


def _pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("g")
    return pd.DataFrame([(*key, pack_keys(g["g"].to_numpy(np.int64).astype(np.uint64)), g["v"].to_numpy(np.float32).tobytes())], columns=["shard", "kind", "order", "g", "v"])


def look_up(tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """Log probability of each gram: that of its longest seen form, times the weights of the longer contexts."""

    def find(kind: str, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, v = tables.get((kind, order), (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(k):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return k[at] == keys, v[at]

    out, left, weight = np.zeros(len(g)), np.arange(len(g)), np.zeros(len(g))
    for order in range(ORDER, 0, -1):
        part = g[left] & mask(order)
        seen, v = find("p", order, part)
        out[left[seen]] = weight[seen] + v[seen]
        left, weight, part = left[~seen], weight[~seen], part[~seen]
        known, v = find("weight", order, part >> np.uint64(WIDTH))
        weight = weight + np.where(known, v, 0)
    out[left] = weight - np.log(SYMBOLS)
    return out


def _ask(g: pd.DataFrame) -> pd.DataFrame:
    """A block's distinct grams, a row per shard."""
    keys, block = block_keys([t or "" for t in g["text"]]), int(g["block"].iloc[0])
    cut = np.append(np.searchsorted(keys, np.arange(SHARDS, dtype=np.uint64) << np.uint64(60)), len(keys))
    rows = [(s, block, pack_keys(keys[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    release()
    return pd.DataFrame(rows, columns=["shard", "block", "keys"])


def _answer(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Log probabilities for each block that asks a shard, in the order of its keys."""
    tables = {(r.kind, r.order): (unpack_keys(r.g), np.frombuffer(r.v, np.float32)) for r in model.itertuples(index=False)}
    rows = [(r.block, r.shard, look_up(tables, unpack_keys(r.keys) & mask(ORDER)).astype(np.float32).tobytes()) for r in asked.itertuples(index=False)]
    release()
    return pd.DataFrame(rows, columns=["block", "shard", "logp"])


SCORED = "doc_id long, lang string, k1 long, k2 long, perplexity double"


def _score(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(g):
        return pd.DataFrame(columns=["doc_id", "lang", "k1", "k2", "perplexity"])
    texts = [t or "" for t in g["text"]]
    keys, logp = block_keys(texts), np.concatenate([np.frombuffer(x, np.float32) for x in answers.sort_values("shard")["logp"]]).astype(np.float64)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for at, found, count in runs(texts):
        u, inverse = np.unique(keyed(found), return_inverse=True)
        total[at] += np.add.reduceat(logp[np.searchsorted(keys, u)][inverse], np.cumsum(count) - count)
        n[at] += count
    release()
    value = np.where([bool(t) for t in texts], np.exp(-total / n), np.nan)
    return pd.DataFrame({"doc_id": g["doc_id"], "lang": g["lang"], "k1": g["k1"], "k2": g["k2"], "perplexity": value})


def _keys(docs: DataFrame) -> dict[str, Column]:
    """Two hashes that name a row's id, language and text."""
    doc, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text")
    return {"k1": F.xxhash64(doc, lang, text), "k2": F.xxhash64(F.lit(1), text, lang, doc)}


def perplexities(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang, k1, k2 and perplexity per character (null for null and empty texts) of every row of docs."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", *[c.alias(k) for k, c in _keys(docs).items()])
    blocks = max(1, -(-byte_size(docs, "text") // BLOCK))
    src = src.withColumn("block", F.pmod("k1", F.lit(blocks)).cast("int"))
    shards = materialize(model.shards(), "kn-shards")
    crowd = F.expr(f"block div {ASKING}").cast("int").alias("crowd")
    # gathering and scoring read one shuffle of the texts
    asked = src.groupBy("block").applyInPandas(_ask, "shard int, block int, keys binary").withColumn("crowd", crowd)
    copies = shards.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // ASKING))))
    answers = asked.groupBy("shard", "crowd").cogroup(copies.groupBy("shard", "crowd")).applyInPandas(_answer, "block int, shard int, logp binary")
    scored = src.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score, SCORED)
    return scored.withColumn("perplexity", F.nanvl("perplexity", F.lit(None).cast("double")))


def judge(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """doc_id, lang, k1, k2, perplexity, lowest, highest and kept of every row of docs; see classify."""
    ids = training_ids(labels, sample)
    # the sample has at most `sample` ids, so it is safe to broadcast
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    scored = materialize(perplexities(docs, KneserNey(train)), "kn-scores")
    known = scored.where("perplexity is not null").join(trusted(labels), "doc_id", "left_semi").join(ids.withColumn("trained", F.lit(True)), "doc_id", "left")
    known = materialize(known.select(F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("lang"), "perplexity", F.when(F.col("trained").isNull(), F.col("perplexity")).alias("fresh")), "kn-trusted")
    q = lambda c, x: F.percentile_approx(c, F.lit(x), F.lit(100_000))
    pair = (q("perplexity", quantiles[0]).alias("lo"), q("fresh", quantiles[1]).alias("hi"))
    every = known.agg(*pair).first()
    limits = materialize(known.groupBy("lang").agg(*pair, F.count("fresh").alias("n")).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "lo", "hi"), "kn-limits")
    rows = scored.join(limits, F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")) == F.col("of"), "left")
    lo, hi = (F.coalesce(c, F.lit(e).cast("double"), F.lit(d)) for c, e, d in (("lo", every["lo"], 0.0), ("hi", every["hi"], float("inf"))))
    return rows.select("doc_id", "lang", "k1", "k2", "perplexity", lo.alias("lowest"), hi.alias("highest"), F.coalesce(F.col("perplexity").between(lo, hi), F.lit(False)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """docs with perplexity, lowest, highest and kept (prefix qc_).

    The model learns from a bounded sample of trusted documents. A document is kept if its perplexity lies between two
    quantiles of its language's trusted documents: the lower one over all of them, the upper one over those that didn't
    train the model (few of a language: over all languages). Null and empty texts have no perplexity and are not kept. A
    null language is one of its own. Without any trusted document nothing is judged and every text that isn't empty is
    kept. Repeated rows are judged alike. Empty table: empty result. Other columns pass through; input columns whose names
    start with qc_ or __tw_ are dropped.
    """
    judged = judge(docs, labels, sample=sample, quantiles=quantiles).dropDuplicates(["k1", "k2"])
    judged = judged.select(F.col("k1").alias("__tw_k1"), F.col("k2").alias("__tw_k2"), *[F.col(c).alias(f"qc_{c}") for c in ("perplexity", "lowest", "highest", "kept")])
    plain = docs.drop(*[c for c in docs.columns if c.lower().startswith(OWN)])
    rows = plain.withColumns({f"__tw_{k}": c for k, c in _keys(docs).items()}).join(judged, ["__tw_k1", "__tw_k2"])
    return rows.select(*[F.col(f"`{c}`") for c in plain.columns], "qc_perplexity", "qc_lowest", "qc_highest", "qc_kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "perplexity", "lowest", "highest", "kept")
