"""Media columns of MPEG audio: writing, resynchronising, tags and bitrate tables, checksums, durations, seek offsets.

A stored clip is an ID3v2 tag, one Xing frame (frame count, byte count, 100-entry seek table) and a payload frame for
every 576 payload bytes. Frames are MPEG-1 Layer III, 48 kHz, joint-free stereo with CRC; side information is zero, so
any decoder plays silence, and the payload lies in the frame's main-data area.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

UNIT = 576
# Fixed values of ISO/IEC 11172-3 and 13818-3: bitrates in kbit/s by index, sample rates in Hz by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
HEAD, SIDE = 4, 32
#: Bitrate indices that payload frames take in turn: 224 and 256 kbit/s, frames of 672 and 768 bytes.
TURNS = (12, 13)


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        t[i] = c
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's CRC (0x8005, from 0xFFFF) of every row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = (c << 8) ^ CRC[(c >> 8) ^ rows[:, j]]
    return c


class Frame(NamedTuple):
    size: int
    samples: int
    rate: int
    layer: int
    protected: bool
    #: Bytes of side information (layer III) and bytes that the checksum covers after the header (-1: not known).
    side: int
    covered: int


def header(h: int) -> Frame | None:
    """What a 32-bit frame header says, or None. Layer II checksums cover table-dependent bits and are not verified."""
    version, layer, rate, bits = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 10 & 3, h >> 12 & 15
    if h >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    kbps, hz, extra = BITRATES[1 if version == 3 else 2, layer][bits], RATES[version][rate], h >> 9 & 1
    mode, protected = h >> 6 & 3, not h >> 16 & 1
    if layer == 1:
        # 4 bits for each of 32 subbands and channel; joint stereo shares them from a bound on
        shared = {0: 32, 1: 4 * (h >> 4 & 3) + 4, 2: 32, 3: 0}[mode]
        return Frame((12000 * kbps // hz + extra) * 4, 384, hz, 1, protected, 0, 16 + shared // 2)
    samples = 576 if layer == 3 and version != 3 else 1152
    side = 0 if layer == 2 else (17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)
    return Frame(samples // 8 * 1000 * kbps // hz + extra, samples, hz, layer, protected, side, side if layer == 3 else -1)


def _frames(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bitrate indices of n payload frames."""
    bits = np.resize(np.array(TURNS), n)
    return np.where(bits == TURNS[0], 672, 768), bits


def pad(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A clip with the payload (a positive multiple of UNIT bytes); n_bytes goes into the tag."""
    n = len(payload) // UNIT
    sizes, bits = _frames(n)
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((n, HEAD + SIDE), np.uint8)
    head[:, 0], head[:, 1], head[:, 2] = 0xFF, 0xFA, bits << 4 | 1 << 2
    crc = crc16(head[:, 2:])
    for j in range(3):
        out[at + j] = head[:, j]
    out[at + 4], out[at + 5] = crc >> 8, crc & 255
    out[(at + HEAD + 2 + SIDE)[:, None] + np.arange(UNIT)] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = 672 + len(out)
    ends = np.append(at, len(out)) + 672
    toc = bytes(np.minimum(255, ends[np.arange(100) * n // 100] * 256 // total).astype(np.uint8))
    first = bytearray(672)
    first[:4] = bytes((0xFF, 0xFB, TURNS[0] << 4 | 1 << 2, 0))
    first[HEAD + SIDE : HEAD + SIDE + 116] = b"Xing" + struct.pack(">III", 7, n, total) + toc
    note = b"\x00payload_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _synchsafe(len(note)) + b"\x00\x00" + note
    return b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame + bytes(first) + out.tobytes()


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsynchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _bitrate_table(data: bytes, at: int, f: Frame) -> dict:
    """The Xing, Info or VBRI table that a clip's first frame holds instead of audio, else nothing."""
    side = at + HEAD + 2 * f.protected + f.side
    number = lambda i, n: int.from_bytes(data[i : i + n], "big")
    if data[side : side + 4] in (b"Xing", b"Info"):
        out, flags, i = {"kind": data[side : side + 4].decode()}, number(side + 4, 4), side + 8
        for bit, key, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[key], i = data[i : i + width] if key == "toc" else number(i, width), i + width
        if data[i : i + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO"):
            gap = number(i + 21, 3)
            out["delay"], out["padding"] = gap >> 12, gap & 4095
        return out
    # a VBRI table stands 32 bytes after the header whatever the side information
    i = at + HEAD + 32
    if data[i : i + 4] == b"VBRI":
        n, scale, width = number(i + 18, 2), number(i + 20, 2), number(i + 22, 2)
        entries = [number(i + 26 + width * k, width) * scale for k in range(n)]
        return {"kind": "VBRI", "delay": number(i + 6, 2), "padding": 0, "quality": number(i + 8, 2), "bytes": number(i + 10, 4), "frames": number(i + 14, 4), "entry_frames": number(i + 24, 2), "entries": entries}
    return {}


def _id3v2(data: bytes) -> tuple[dict, int]:
    """(tags, where the frames may begin) of an ID3v2 tag; broken ones give what can be read."""
    end, tags = len(data), {}
    if data[:3] != b"ID3" or end < 10:
        return tags, 0
    at, stop = 10, min(10 + _unsynchsafe(data[6:10]), end)
    while at + 10 <= stop and data[at : at + 4].strip(b"\0"):
        k, n = data[at : at + 4].decode("latin-1"), _unsynchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(at + 10 + n, stop)]
        text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0] if body else 0, "utf-16"), "replace")
        name, _, value = text.partition("\0") if k in ("TXXX", "COMM") else (k, "", text)
        tags[name], at = value, at + 10 + n
    return tags, stop


def parse(data: bytes) -> dict:
    """What a clip holds: tags, bitrate table, frame offsets, samples, checksums that fail, bytes skipped to find frames.

    A frame counts if its header is valid and the next frame's header (or the end, or an ID3v1 tag) follows it directly;
    otherwise one byte is skipped and the search goes on. Frames of another layer or sample rate than the first are
    skipped the same way. "TAG" at 128 bytes before the end is an ID3v1 tag unless a frame spans that position. Anything
    that holds no frame gives zero frames. played: samples without the encoder's delay and padding, if a table names them.
    """
    end = len(data)
    tags, at = _id3v2(data)
    tail = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else -1
    tagged = lambda i: 0 <= tail - i < 4
    known: dict[bytes, Frame | None] = {}
    look = lambda i: known[k] if (k := data[i : i + 4]) in known else known.setdefault(k, header(int.from_bytes(k.ljust(4, b"\0"), "big")))
    frames, skipped, samples, kind, table_of = [], 0, 0, None, {}
    while at + 4 <= end and not tagged(at):
        f = look(at)
        if not f or kind and (f.rate, f.layer) != kind or at + f.size > end or at + f.size + 4 <= end and not tagged(at + f.size) and not look(at + f.size):
            stop = tail if at < tail else end
            nxt = data.find(b"\xff", at + 1, stop)
            skipped, at = skipped + ((nxt if nxt >= 0 else stop) - at), nxt if nxt >= 0 else stop
            continue
        kind = f.rate, f.layer
        if not frames and not table_of and f.layer == 3 and (found := _bitrate_table(data, at, f)):
            table_of = found
        else:
            frames.append((at, f.size, f.protected, f.side, f.covered))
            samples += f.samples
        at += f.size
    if tagged(at):
        tags.setdefault("TIT2", data[tail + 3 : tail + 33].split(b"\0")[0].decode("latin-1"))
    out = np.array(frames, np.int64).reshape(-1, 5)
    b, bad, checked = np.frombuffer(data, np.uint8), 0, 0
    for covered in np.unique(out[(out[:, 2] == 1) & (out[:, 4] >= 0), 4]).tolist():
        begin = out[(out[:, 2] == 1) & (out[:, 4] == covered) & (out[:, 1] >= HEAD + 2 + covered), 0]
        said = b[begin + 4].astype(np.uint16) << 8 | b[begin + 5]
        bad += int((crc16(b[begin[:, None] + np.r_[2:4, 6 : 6 + covered]]) != said).sum())
        checked += len(begin)
    return {
        "tags": tags, "table": table_of, "offsets": out[:, 0], "sizes": out[:, 1], "lead": HEAD + 2 * out[:, 2] + out[:, 3], "samples": samples, "rate": kind[0] if kind else 0, "layer": kind[1] if kind else 0,
        "played": max(0, samples - table_of.get("delay", 0) - table_of.get("padding", 0)), "bad_crc": bad, "crcs": checked, "skipped": skipped,
    }


def payload_of(data: bytes, clip: dict) -> bytes:
    """The bytes that encode() stored; of a foreign clip, everything after its frames' headers and side information."""
    if not len(clip["offsets"]):
        return b""
    lead, size = clip["lead"], clip["sizes"]
    begin = clip["offsets"] + lead
    if "payload_bytes" in clip["tags"] and (lead + UNIT <= size).all():
        return np.frombuffer(data, np.uint8)[begin[:, None] + np.arange(UNIT)].tobytes()
    return b"".join([data[i : i + max(0, n)] for i, n in zip(begin.tolist(), (size - lead).tolist(), strict=True)])


STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, samples long, played_samples long, sample_rate int, duration_us long, crc_failures long, skipped_bytes long, seek_offsets array<long>"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.iloc[i : i + 500]
            raw = [x if isinstance(x, bytes) else b"" for x in part["payload"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(x) for x in raw], "media": [encode(pad(x), len(x)) for x in raw]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for data in (x if isinstance(x, bytes) else b"" for x in b["media"]):
            clip = parse(data)
            payload = payload_of(data, clip)
            n, rate, said = len(clip["offsets"]), clip["rate"], clip["tags"].get("payload_bytes", "")
            us = round(clip["samples"] * 1_000_000 / rate) if rate else 0
            seek = clip["offsets"].tolist()
            feature = f"mpeg-l{clip['layer']};hz={rate};frames={n};table={clip['table'].get('frames')};samples={clip['samples']};us={us};crc={clip['crcs'] - clip['bad_crc']}/{clip['crcs']};seek={zlib.crc32(clip['offsets'].tobytes())}"
            size = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else len(payload)
            rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, n, clip["samples"], clip["played"], rate, us, clip["bad_crc"], clip["skipped"], seek))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        yield out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the clip that holds the whole text. Null text: empty; equal texts give equal clips."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload")).mapInPandas(_store, STORED)


def features(clips: DataFrame) -> DataFrame:
    """One row per clip with its payload's and stored form's digests, exact duration (samples over sample_rate; duration_us
    is rounded) and frame seek offsets. clips: doc_id, media; a null or foreign clip gives what can be read of it, and a
    clip without a payload_bytes tag has its payload's length as n_bytes.
    """
    return clips.select("doc_id", "media").mapInPandas(_features, f"doc_id long, {FEATURES}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(materialize(store(table(spark, sf_dir, "documents")), "media"))
