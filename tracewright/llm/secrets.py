"""Secret scan: fixed patterns, and a convolutional network over the characters of every candidate and its surroundings.

A candidate is a maximal run of the characters that keys are made of. The network sees it whole, with what stands before
and after; it is trained on labelled findings (what the patterns find and don't find in a bounded sample, and drawn ones
of many formats), calibrated on findings that it was not trained on, and cut off by family of characters at the highest
probability that still keeps the wanted recall there. The patterns' findings always stay; the network adds to them.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash32, lowest, materialize, release, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of hexadecimal digits that are long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these holds no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
#: Runs of at least this many characters are candidates.
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
BEFORE, AFTER = 24, 8
#: Most documents (those of the lowest hashes of their ids) whose candidates train the network, and most of either label.
SAMPLE, FINDINGS = 4000, 1500
#: Drawn findings, half of them secrets.
DRAWN = 3000
RECALL = 0.95
SYMBOLS, WIDTH, EMBED, FILTERS, HIDDEN = 129, 7, 8, 40, 24
HALO = WIDTH // 2
#: Characters of a piece of a window; longer ones are pooled over pieces, which gives the same numbers.
PIECE = 128
STEP = 256
FINDING = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("score", T.DoubleType(), False)])


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the fixed patterns find, by start and kind."""
    low = text.lower()
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(n in low for n in NAMES) else []
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, without points and dashes at its ends."""
    out = []
    for m in CANDIDATE.finditer(text):
        whole = m[0]
        lead, tail = len(whole) - len(whole.lstrip(".-_/")), len(whole.rstrip(".-_/"))
        if tail - lead >= LEAST:
            out.append((m.start() + lead, m.start() + tail))
    return out


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


def family(candidate: str) -> str:
    """Which characters a candidate is made of; thresholds are set for each family."""
    if re.fullmatch(r"[0-9]+", candidate):
        return "digits"
    if re.fullmatch(r"[0-9a-fA-F-]+", candidate):
        return "hex"
    if re.fullmatch(r"[A-Za-z]+", candidate):
        return "letters"
    return "plain" if candidate.isalnum() else "marks"


FAMILIES = ("digits", "hex", "letters", "plain", "marks")


def symbols(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), SYMBOLS - 1).astype(np.int64)


@dataclass
class Pieces:
    """Windows cut into pieces of one length: symbols, marks of the candidate's characters and of those to pool over."""

    sym: np.ndarray
    inside: np.ndarray
    pool: np.ndarray
    of: np.ndarray


def pieces(windows: Sequence[tuple[str, str, str]]) -> Pieces:
    rows = []
    for i, (a, c, b) in enumerate(windows):
        s = symbols(a + c + b)
        for at in range(0, len(s), PIECE):
            rows.append((i, s, at, len(a), len(a) + len(c)))
    width = max((min(PIECE, len(s) - at) for _, s, at, _, _ in rows), default=1) + 2 * HALO
    out = Pieces(np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.float32), np.zeros((len(rows), width - 2 * HALO), bool), np.array([r[0] for r in rows], np.int64))
    for k, (_, s, at, start, end) in enumerate(rows):
        low, high = max(0, at - HALO), min(len(s), at + PIECE + HALO)
        to = low - (at - HALO)
        out.sym[k, to : to + high - low] = s[low:high][: width - to]
        lo, hi = max(low, start), min(high, end)
        if hi > lo:
            out.inside[k, lo - (at - HALO) : hi - (at - HALO)] = 1
        out.pool[k, : min(PIECE, len(s) - at)] = True
    return out


@dataclass
class Network:
    """Embedding, one convolution, largest and mean value of each filter, one hidden layer; all in float32."""

    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    cut: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int) -> Network:
        g = np.random.default_rng(seed)
        draw = lambda *s, by: (g.standard_normal(s) / by**0.5).astype(np.float32)
        fan = WIDTH * (EMBED + 1)
        return cls({"embed": draw(SYMBOLS, EMBED, by=1), "conv": draw(fan, FILTERS, by=fan / 2), "conv_b": np.zeros(FILTERS, np.float32), "hid": draw(2 * FILTERS, HIDDEN, by=FILTERS), "hid_b": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1, by=HIDDEN), "out_b": np.zeros(1, np.float32)})

    def columns(self, x: Pieces) -> np.ndarray:
        """The convolution's input: each place with its neighbours, as rows."""
        e = np.concatenate([self.p["embed"][x.sym], x.inside[:, :, None]], 2)
        n = x.sym.shape[1] - 2 * HALO
        return np.concatenate([e[:, k : k + n] for k in range(WIDTH)], 2)

    def pooled(self, x: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, filter values, largest by piece, weights of the mean over the candidate's characters)."""
        cols = self.columns(x)
        act = np.maximum(cols @ self.p["conv"] + self.p["conv_b"], 0)
        act *= x.pool[:, :, None]
        return cols, act, act.max(1), x.inside[:, HALO : act.shape[1] + HALO] * x.pool

    def logits(self, windows: Sequence[tuple[str, str, str]]) -> np.ndarray:
        out = np.zeros(len(windows))
        order = np.argsort([len(a) + len(c) + len(b) for a, c, b in windows], kind="stable")
        for k in range(0, len(order), STEP):
            part = order[k : k + STEP]
            high, total, n = np.zeros((len(part), FILTERS), np.float32), np.zeros((len(part), FILTERS), np.float32), np.zeros((len(part), 1), np.float32)
            x = pieces([windows[i] for i in part])
            for j in range(0, len(x.of), STEP):
                y = Pieces(x.sym[j : j + STEP], x.inside[j : j + STEP], x.pool[j : j + STEP], x.of[j : j + STEP])
                _, act, top, w = self.pooled(y)
                np.maximum.at(high, y.of, top)
                np.add.at(total, y.of, np.einsum("ijk,ij->ik", act, w))
                np.add.at(n, y.of, w.sum(1, keepdims=True))
            h = np.maximum(np.concatenate([high, total / np.maximum(n, 1)], 1) @ self.p["hid"] + self.p["hid_b"], 0)
            out[part] = (h @ self.p["out"] + self.p["out_b"])[:, 0]
        return out

    def probabilities(self, windows: Sequence[tuple[str, str, str]]) -> np.ndarray:
        a, b = self.scale
        return np.round(1 / (1 + np.exp(-np.clip(a * self.logits(windows) + b, -60, 60))), 6)

    def found(self, windows: Sequence[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, is at least its family's threshold)."""
        p = self.probabilities(windows)
        return p, p >= np.array([self.cut.get(family(c), 1.1) for _, c, _ in windows])

    def gradients(self, x: Pieces, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; every window is one piece."""
        p = self.p
        cols, act, top, w = self.pooled(x)
        w = w / np.maximum(w.sum(1, keepdims=True), 1)
        z = np.concatenate([top, np.einsum("ijk,ij->ik", act, w)], 1)
        pre = z @ p["hid"] + p["hid_b"]
        h = np.maximum(pre, 0)
        d = ((1 / (1 + np.exp(-np.clip((h @ p["out"] + p["out_b"])[:, 0], -60, 60))) - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": h.T @ d, "out_b": d.sum(0)}
        dh = (d @ p["out"].T) * (pre > 0)
        g["hid"], g["hid_b"] = z.T @ dh, dh.sum(0)
        dz = dh @ p["hid"].T
        da = dz[:, None, FILTERS:] * w[:, :, None]
        i, k = np.indices(top.shape)
        da[i, act.argmax(1), k] += dz[:, :FILTERS]
        da *= act > 0
        flat = da.reshape(-1, FILTERS)
        g["conv"], g["conv_b"] = cols.reshape(len(flat), -1).T @ flat, flat.sum(0)
        dc = (flat @ p["conv"].T).reshape(*act.shape[:2], WIDTH, EMBED + 1)[..., :EMBED]
        de, n = np.zeros((*x.sym.shape, EMBED), np.float32), act.shape[1]
        for k in range(WIDTH):
            de[:, k : k + n] += dc[:, :, k]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x.sym.ravel(), de.reshape(-1, EMBED))
        return g

    def fit(self, windows: Sequence[tuple[str, str, str]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 3e-3, seed: int = 0) -> None:
        """Adam over shuffled batches. Candidates longer than a piece train by their first characters only."""
        cut = [(a, c[: PIECE - BEFORE - AFTER], b if len(c) <= PIECE - BEFORE - AFTER else "") for a, c, b in windows]
        g, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = g.permutation(len(cut))
            for k in range(0, len(order), batch):
                part, t = order[k : k + batch], t + 1
                for name, d in self.gradients(pieces([cut[i] for i in part]), labels[part]).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, windows: Sequence[tuple[str, str, str]], labels: np.ndarray, recall: float = RECALL, least: int = 20) -> None:
        """Scale and shift of the logits by the log loss on findings that trained nothing, then the thresholds: by family
        the highest probability that keeps `recall` of its secrets, but none under one half. Of a family with fewer than
        `least` secrets nothing is reported, as no recall can be told (plain numbers and words, for one)."""
        z, a, b = self.logits(windows), 1.0, 0.0
        # targets a little inside (0, 1), so that separated classes don't drive the scale to infinity
        pos, neg = labels.sum(), (1 - labels).sum()
        y = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            r, w = p - y, np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(r * z).sum(), r.sum()]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale = (float(a), float(b))
        p, fam = self.probabilities(windows), np.array([family(c) for _, c, _ in windows])
        at = lambda q: max(0.5, float(np.sort(q)[int((1 - recall) * len(q))]))
        for f in FAMILIES:
            own = p[(labels > 0) & (fam == f)]
            self.cut[f] = at(own) if len(own) >= least else 1.1


def _text(g: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(g.choices(letters, k=g.randint(low, high)))


B62, B64, UPPER_HEX, LOWER_HEX = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", "0123456789abcdef"
SYLLABLES = "an ba con der el for ge heit in ka lo men ning or pre qui re sch tion um ver wer xi yon zen".split()


def _word(g: random.Random, low: int = 1, high: int = 3) -> str:
    return "".join(g.choices(SYLLABLES, k=g.randint(low, high)))


def _secret(g: random.Random) -> str:
    """A key, token or digest of some common format."""
    kind = g.randrange(8)
    if kind == 0:
        return _text(g, B62, 16, 64)
    if kind == 1:
        return _text(g, B64, 22, 86) + g.choice(["", "=", "=="])
    if kind == 2:
        return _text(g, UPPER_HEX, 20, 64)
    if kind == 3:
        return _text(g, LOWER_HEX, 16, 64)
    if kind == 4:
        return "-".join(_text(g, LOWER_HEX, n, n) for n in (8, 4, 4, 4, 12))
    if kind == 5:
        return _text(g, string.ascii_lowercase, 2, 4) + g.choice("_-") + g.choice(["", "live_", "test_"]) + _text(g, B62, 20, 48)
    if kind == 6:
        return ".".join(_text(g, B62 + "-_", n, n + 40) for n in (18, 30, 30))
    return _text(g, string.ascii_uppercase + string.digits, 16, 32)


def _harmless(g: random.Random) -> str:
    """What looks alike but isn't: long words, names, numbers, times, paths, rules of signs."""
    kind = g.randrange(11)
    if kind == 0:
        return _word(g, 5, 9)
    if kind == 10:
        return _word(g, 3, 4) + str(g.randint(1, 2030)) + _word(g, 1, 3).capitalize()
    if kind == 1:
        return _word(g, 5, 8).capitalize() + g.choice(["", "."])
    if kind == 2:
        return _text(g, string.digits, 12, 20)
    if kind == 3:
        return f"{g.randint(1950, 2030)}-{g.randint(1, 12):02d}-{g.randint(1, 28):02d}" + g.choice(["T", "-"]) + f"{g.randint(0, 23):02d}-{g.randint(0, 59):02d}"
    if kind == 4:
        return ".".join([g.choice(["www", "mail", "ftp"]) + str(g.randint(1, 9)), _word(g), g.choice(["com", "org", "example.com"])])
    if kind == 5:
        return "/".join(_word(g) for _ in range(g.randint(3, 6))) + g.choice(["", ".html", ".txt"])
    if kind == 6:
        return g.choice("-_").join(_word(g) for _ in range(g.randint(3, 6)))
    if kind == 7:
        return "".join(_word(g).capitalize() for _ in range(g.randint(3, 5)))
    if kind == 8:
        return g.choice("ax01=") * g.randint(12, 60)
    return _word(g, 5, 8).upper()


def drawn_findings(n: int, seed: int = 0, surroundings: Sequence[tuple[str, str]] = ()) -> list[tuple[tuple[str, str, str], int]]:
    """(window, label) of n drawn candidates, every second one a secret, in given or drawn surroundings; both labels stand
    in surroundings of both kinds, with or without a word that names a key."""
    g, out = random.Random(seed), []
    names = ["key", "Key ID", "auth", "Authorization: Bearer", "pwd", "credential", "signature", "client id", "access", "value", "id", "see", "file", "of"]
    for i in range(n):
        c = _secret(g) if i % 2 else _harmless(g)
        a, b = g.choice(surroundings) if surroundings and g.random() < 0.7 else (" ".join(_word(g) for _ in range(6)) + " ", " " + _word(g) + " " + _word(g))
        if g.random() < 0.4:
            a = a + g.choice(names) + g.choice([" ", ": ", "=", ' = "', "\n"])
        if len(c) >= LEAST:
            out.append(((a[-BEFORE:], c, b[:AFTER]), i % 2))
    return out


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = FINDINGS) -> list[tuple[tuple[str, str, str], int]]:
    """(window, label) of candidates of at most `sample` documents, those of the lowest hashes of their keys: 1 where a
    pattern finds the candidate, else 0; at most `most` of either label, again by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                spans = base_findings(t or "")
                for s, e in candidates(t or ""):
                    rows.append((*(x.encode("utf-8", "surrogatepass") for x in _short(window(t, s, e))), int(any(x[1] < e and s < x[2] for x in spans))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i < 3 else pa.int32()) for i in range(4)], names=["a", "c", "b", "y"])

    ids = lowest(docs.select(F.col(f"`{key}`").alias("k")), sample)
    some = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(ids, "k", "left_semi").select("t")
    seen = materialize(some.mapInArrow(work, "a binary, c binary, b binary, y int").distinct(), "secret-findings")
    out = []
    for y in (0, 1):
        rows = seen.where(F.col("y") == y).orderBy(hash32(F.hex("a"), F.hex("c"), F.hex("b")), "a", "c", "b").limit(most).collect()
        out += [(tuple(bytes(r[x]).decode("utf-8", "surrogatepass") for x in "acb"), y) for r in rows]
    return out


def _short(w: tuple[str, str, str]) -> tuple[str, str, str]:
    """A window as training uses it; findings that go to the driver are of bounded size."""
    return w[0], w[1][: PIECE - BEFORE - AFTER], w[2]


def train(findings: Sequence[tuple[tuple[str, str, str], int]], recall: float = RECALL, epochs: int = 5, seed: int = 0) -> Network:
    """A network trained on four fifths of the findings and calibrated on the rest."""
    order = np.random.default_rng(seed).permutation(len(findings))
    w, y = [findings[i][0] for i in order], np.array([findings[i][1] for i in order], np.float32)
    held = len(w) // 5
    net = Network.start(seed)
    net.fit(w[held:], y[held:], epochs, seed=seed)
    net.calibrate(w[:held], y[:held], recall)
    return net


def train_on(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = FINDINGS, drawn: int = DRAWN, recall: float = RECALL) -> Network:
    """Trained on the sample's findings and on drawn ones in the sample's surroundings; without rows, on drawn ones alone."""
    own = labelled(docs, key, text, sample, most)
    return train(own + drawn_findings(drawn, 1, [(a, b) for (a, _, b), y in own if not y]), recall)


def scan(docs: DataFrame, net: Network, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) with findings array<kind, start, end, score>.

    start and end count code points, end exclusive; by start, then kind in the order of KINDS. Findings of the patterns
    have score 1; kind model is a candidate that the network takes for a secret and that no pattern's finding touches.
    Null or empty text: none. Repeated rows each get theirs; empty table: empty result; a column named findings is
    replaced. Whole texts are scanned where they are read, without a shuffle; a candidate of any length is seen whole.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "findings"]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__tw_text"))
    kind = pa.list_(pa.struct([pa.field("kind", pa.string(), nullable=False), pa.field("start", pa.int64(), nullable=False), pa.field("end", pa.int64(), nullable=False), pa.field("score", pa.float64(), nullable=False)]))
    out = T.StructType([*src.schema.fields[: len(keep)], T.StructField("findings", T.ArrayType(FINDING, True))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, asked, spans = [], [], []
            for i, t in enumerate(x or "" for x in b.column(len(keep)).to_pylist()):
                base = base_findings(t)
                found.append([(k, s, e, 1.0) for k, s, e in base])
                for s, e in candidates(t):
                    asked.append(window(t, s, e))
                    spans.append((i, s, e))
            if asked:
                p, yes = net.found(asked)
                for j in np.flatnonzero(yes):
                    i, s, e = spans[j]
                    if not any(x[1] < e and s < x[2] for x in found[i] if x[0] != "model"):
                        found[i].append(("model", s, e, float(p[j])))
            told = [[dict(zip(FINDING.names, x)) for x in sorted(f, key=lambda x: (x[1], KINDS.index(x[0])))] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(told, kind)], names=out.names)
        release()

    return src.mapInArrow(work, out)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, checksum of the patterns' spans, and all spans as text."""
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.filter("findings", lambda x: x["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("findings", lambda x: x["kind"] != "model")
    return found.select("doc_id", *n, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan(docs, train_on(docs), keep=["doc_id"]))
