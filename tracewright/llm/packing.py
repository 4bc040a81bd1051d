"""Packing documents into sequences along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_size, materialize, release, table
from .words import chunks, hash_pieces

DIMS, BITS, FEATURES = 3, 10, 1024
#: Most pieces of text that a worker keeps with their ids (about 20 bytes each): the first ones met, so the frequent ones.
KEPT = 1_000_000
#: Pieces that go through the tokenizer in one text, a line each.
LINES = 200
#: What a tokenizer must cut at a space before a non-space and at a line end after one; else texts go through it whole.
PROBES = tuple("It's one small test of twelve words 12345 don't naïve ñandú 東京 x (y) [z] . a_b c-d A .5 \U0001f600 e".split())
CHUNK = 1_000_000
FIRST = np.uint64(0xA0761D6478BD642F)


class Ids:
    """Token ids of whole texts through a tokenizers file.

    A byte-level BPE with a leading-space pre-tokenizer never merges across the start of " x" (one space before a
    non-space), so a text's ids are those of its pieces cut there. Pieces are told apart by 64-bit hashes; each new one
    goes through the library, and known ones are gathered from one pool of ids. Texts with runs of white space after a
    space, with NUL or with the text of a special token go through the library whole; so do all texts if a tokenizer fails
    the PROBES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        encode = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.newline = (encode("\n") or [-1])[0]
        one = [encode(" " + x) for x in PROBES]
        lines = [i for x in one for i in [*x, self.newline]]
        self.cuts = len(encode("\n")) == 1 and encode(" " + " ".join(PROBES)) == [i for x in one for i in x] and encode("".join(f" {x}\n" for x in PROBES)) == lines == encode("\n".join([" " + x for x in PROBES])) + [self.newline]
        # a special token's text is that token, as the library has it; such texts go through it whole
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile("|".join([r" \s", r"\x00", *special]) if self.cuts else r"").search
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if not self.odd(t)]
        kept = set(plain)
        rest = [i for i in range(len(texts)) if i not in kept]
        for i, c in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(c.ids, "<u2").tobytes()
        raw = [texts[i].encode() for i in plain]
        for a, b in chunks(raw, CHUNK):
            for i, ids in zip(plain[a:b], self.chunk(raw[a:b]), strict=True):
                out[i] = ids
        return out

    def chunk(self, raw: list[bytes]) -> list[bytes]:
        data = b"\0".join(raw) + b"\0"
        h, start, end, first = hash_pieces(data)
        h = np.where(first, h ^ FIRST, h)
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[known], count[known] = self.at[at[known]], self.n[at[known]]
        pool, new = self.pool, np.flatnonzero(~known)
        if len(new):
            w = where[new]
            coded = self.encode([data[i:j].decode() for i, j in zip(start[w].tolist(), end[w].tolist(), strict=True)], first[w].tolist())
            count[new] = [len(c) // 2 for c in coded]
            begin[new] = len(pool) + np.cumsum(count[new]) - count[new]
            pool = np.concatenate([pool, np.frombuffer(b"".join(coded), "<u2")])
            if len(self.keys) < KEPT:
                self.pool = pool
                self.keys, self.at, self.n = (np.insert(x, at[new], y) for x, y in ((self.keys, keys[new]), (self.at, begin[new]), (self.n, count[new])))
        n = count[inverse]
        total = np.cumsum(n)
        ids = pool[np.repeat(begin[inverse] - (total - n), n) + np.arange(total[-1])].tobytes()
        # a text's last piece is the one before the next first piece
        ends = 2 * total[np.append(np.flatnonzero(first)[1:], len(first)) - 1]
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, pieces: list[str], first: list[bool]) -> list[bytes]:
        """Ids of pieces. Plain ones go many to a text, a line each: no id spans a line end after a non-space."""
        single = [f or len(x.split()) != 1 or x != x.strip() for x, f in zip(pieces, first, strict=True)]
        out = [b""] * len(pieces)
        odd = [i for i, s in enumerate(single) if s]
        for i, c in zip(odd, self.tok.encode_batch_fast([pieces[i] if first[i] else " " + pieces[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(c.ids, "<u2").tobytes()
        plain = [i for i, s in enumerate(single) if not s]
        parts = [plain[i : i + LINES] for i in range(0, len(plain), LINES)]
        for part, c in zip(parts, self.tok.encode_batch_fast(["".join([f" {pieces[i]}\n" for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(c.ids, "<u2")
            raw, at = ids.tobytes(), 0
            for i, end in zip(part, np.flatnonzero(ids == self.newline).tolist(), strict=True):
                out[i] = raw[2 * at : 2 * end]
                at = end + 1
        return out


_shared: dict[str, Ids] = {}


def shared_ids(path: str) -> Ids:
    """One cache for all tasks that a worker process runs."""
    if path not in _shared:
        _shared[path] = Ids(path)
    return _shared[path]


def _signs() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1]), (FEATURES, DIMS))


def document_points(ids: list[np.ndarray]) -> np.ndarray:
    """Each document's hashed token counts, projected by random signs, as DIMS integers of BITS bits."""
    signs, out = _signs(), np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        counts = np.bincount((x.astype(np.int64) * 2654435761 >> 7) % FEATURES, minlength=FEATURES)
        norm = np.sqrt((counts * counts).sum())
        out[i] = counts @ signs / (norm or 1)
    top = (1 << BITS) - 1
    return np.clip(np.rint((out / 6 + 0.5) * top), 0, top).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row: undo the excess rotations from the top bit down, then Gray-decode."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = shared_ids(path)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                coded = [c + b"\0\0" for c in ids([t if isinstance(t, str) else "" for t in part["text"]])]
                points = document_points([np.frombuffer(c, "<u2") for c in coded])
                yield pd.DataFrame({"doc_id": part["doc_id"], "rid": part["rid"], "curve": hilbert_key(points), "n": [len(c) // 2 for c in coded], "ids": coded})
        release()

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                rows = []
                for doc, begin, coded in b.iloc[i : i + 2000][["doc_id", "begin", "ids"]].itertuples(index=False):
                    n, at = len(coded) // 2, 0
                    while at < n:
                        seq, off = divmod(begin + at, length)
                        take = min(length - off, n - at)
                        rows.append((doc, at, take, n, seq, off, coded[2 * at : 2 * (at + take)]))
                        at += take
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024) -> DataFrame:
    """Pieces of documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (16-bit little-endian).

    Each text's ids are followed by one id 0. Documents are laid end to end in the order of their Hilbert key (ties by
    doc_id, then by row), and sequences are the stream cut every `length` ids: only the very last one is short. Ranges of
    the key are sorted in parallel; a range's place in the stream is a prefix sum over ranges. Equal keys (a large group
    of copies) are split over ranges, as the doc_id is part of the sort key.
    Null text: empty, so one id 0. Null doc_ids and repeated rows are packed row by row. Empty table: no piece.
    Vocabulary ids must fit in 16 bits.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    coded = materialize(src.mapInPandas(_encode(tokenizer_path), "doc_id long, rid long, curve long, n long, ids binary"), "pack-ids")
    parts = max(1, byte_size(coded, "ids") // (64 << 20)) * 4
    keys = coded.select("rid", "curve", "doc_id", "n")
    ranged = materialize(keys.repartitionByRange(parts, "curve", "doc_id", "rid").withColumn("part", F.spark_partition_id()), "pack-ranges")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("part_n"))  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_begin"))
    inside = Window.partitionBy("part").orderBy("curve", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    at = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part").select("rid", (F.col("part_begin") + F.col("inside")).alias("begin"))
    rows = coded.select("doc_id", "rid", "ids").join(materialize(at, "pack-begins").hint("shuffle_hash"), "rid")
    return rows.mapInPandas(_cut(length), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; a sequence is at most `length` ids, so a group is small."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["ids_crc32"] = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in b["ids"]]
        yield b.drop(columns="ids")
    release()


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32, of the ids as 32-bit little-endian, in place of the ids."""
    return pieces.mapInPandas(_digest, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), tokenizer_file()))
