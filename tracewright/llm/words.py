"""Whole batches of texts as numpy arrays: words, their 64-bit hashes, and which text each belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed random odd values per byte; A-Z share those of a-z, so hashing lower-cases ASCII.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1_000_000
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, CHUNK + 200_000)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(m - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segments(space: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of parts of about CHUNK bytes that end with white space, as the whole does; a longer word is one part."""
    at, n = 0, len(space)
    while at < n:
        end = min(at + CHUNK + 100_000, n)
        if not space[end - 1]:
            end += int(space[end:].argmax()) + 1
        yield at, end
        at = end


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, number of words of each text); words are maximal runs without ASCII white space."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space, hashes, starts = _SPACE[b], [], []
    for i, j in _segments(space):
        h, start = _hash_part(b[i:j], space[i:j])
        hashes.append(h)
        starts.append(start + i)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.r_[0, np.searchsorted(np.concatenate(starts), bounds)])


def _hash_part(b: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of bytes that end with white space."""
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b))
    total = np.cumsum(_BYTE[b] * up, dtype=np.uint64)
    h = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    return mix64(h * down[start] + (end - start).astype(np.uint64)), start


#: As _BYTE, but with a value of its own for every byte.
_EXACT = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, is the first of its text) of the pieces between single spaces; each text ends with NUL."""
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero((b == 32) | (b == 0))
    start = np.r_[0, end[:-1] + 1]
    up, down = _powers(len(b))
    total = np.cumsum(_EXACT[b] * up, dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    h = np.where(end > start, total[end - 1] - before, np.uint64(0))
    return mix64(h * down[start] + (end - start).astype(np.uint64)), start, end, np.r_[True, b[end[:-1]] == 0]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about limit bytes; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(values) -> list[bytes]:
    """Binary values of an Arrow-backed column; null is empty."""
    return [x if isinstance(x, bytes) else b"" if x is None else bytes(x) for x in values]
