"""Runs of LEAST_RUN words or more that an earlier document holds too, wherever in a line they begin and end.

A word is a run of letters, digits and underscores in lower case, or one character of a script that is written without blanks; what stands
between words doesn't count. Every window of LEAST_RUN words has a key, the least hash of the GRAM words in a row in it, and equal
windows have equal keys. A segment is a run of windows with one key. Keys are small and few (one for some twenty words), so they
find the segments that may repeat; only these have their windows told apart, by 64 more bits each. Segments of equal windows settle each other
as one row; the windows of a key's distinct segments are told apart one by one. Nothing is sampled: every window is judged.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

LEAST_RUN = 50
GRAM = 8
WORD_ENTRIES = 100_000

_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_FACTOR = np.random.default_rng(51).integers(0, 1 << 64, (2, 8), dtype=np.uint64) | np.uint64(1)


class Codes(dict):
    """Two random 64-bit numbers for each word, as bytes, the same in every process."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = self[word] = hashlib.blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return out


def _joined(left: np.ndarray, right: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Hashes of what ``left`` stands for with what ``right`` stands for after it."""
    n = min(left.size, right.size)
    out = left[:n] * factor
    out ^= out >> np.uint64(31)
    out += right[:n]
    out *= _FACTOR[0, 7]
    return out ^ (out >> np.uint64(29))


def _runs(h: np.ndarray, factors: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row, from runs of 1, 2, 4, ... words."""
    out, done, m, k = None, 0, 1, 0
    while True:
        if width & m:
            out = h if out is None else _joined(h, out[m:], factors[k])
            done += m
        if done == width:
            return out
        h, m, k = _joined(h, h[m:], factors[k]), 2 * m, k + 1


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    m = 1
    while 2 * m <= width:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: h.size - (width - m)], h[width - m :]) if m < width else h


class Windows:
    """The windows of one text: their keys, and their hashes when asked; ``size`` is 0 where there are fewer words than a window has."""

    def __init__(self, words: list[str], codes: Codes):
        self.size = max(0, len(words) - LEAST_RUN + 1)
        if self.size:
            self.numbers = np.frombuffer(b"".join([codes[w] for w in words]), "<u8").reshape(-1, 2).T.copy()
            self.keys = _least(_runs(self.numbers[0], _FACTOR[0], GRAM), LEAST_RUN - GRAM + 1).view(np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of windows with one key, in order."""
        edge = np.flatnonzero(np.diff(self.keys)) + 1
        return np.concatenate([[0], edge]), np.append(edge, self.size)

    def hashes(self) -> np.ndarray:
        return _runs(self.numbers[1], _FACTOR[1], LEAST_RUN).view(np.int64)


def ranges_of_words(words: list[tuple[int, int]], windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of the words in a row that runs (first window, number of windows) cover."""
    covered = merged([(at, at + n + LEAST_RUN - 1) for at, n in windows])
    return [(words[a][0], words[b - 1][1]) for a, b in covered]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if a == b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are in order and apart."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])
