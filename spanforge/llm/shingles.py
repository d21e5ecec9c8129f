"""Hashed word shingles of whole texts, made for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once. Numbers of 8 bytes are made for each, and tables of powers for as many stay in the worker.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 5  # odd, so it can be divided by modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n powers or more. One pair of tables is kept, for a full chunk; those of a longer text are not worth it."""
    full = 2 * CHUNK_BYTES
    if n > full:
        return _cumulated(_BASE, n), _cumulated(_INVERSE, n)
    if not _powers:
        _powers.append((_cumulated(_BASE, full), _cumulated(_INVERSE, full)))
    return _powers[0]


def _cumulated(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _chunk(texts: list[bytes]) -> list[np.ndarray]:
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(joined.size + 1)
    total = np.zeros(joined.size + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[joined]] * up[: joined.size], out=total[1:])
    word = mix((total[ends] - total[starts]) * down[starts])
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)
    every = np.zeros(max(0, word.size - WORDS + 1), np.uint64)
    for k in range(WORDS):
        every += word[k : k + every.size] * _PLACE[k]
    every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            own = np.sort(every[a : b - WORDS + 1])
            keep = np.empty(own.size, bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            out.append(mix((word[a:b] * _PLACE[:n]).sum(keepdims=True) + _PLACE[WORDS:] * np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode()
        if part and size + len(raw) > CHUNK_BYTES:
            out += _chunk(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    return out + (_chunk(part) if part else [])
