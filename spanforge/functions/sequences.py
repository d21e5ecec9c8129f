"""Order-dependent helpers over one run's short sequence, and their Arrow forms. Imports no queries: workers load this module alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def repeated_block(tokens: np.ndarray) -> tuple[int, int]:
    """(period, repeats) of the immediately repeated block that covers most tokens, the shorter period on a tie; (0, 1) without any."""
    best, n = (0, 0, 1), len(tokens)
    for period in range(1, n // 2 + 1):
        same = np.concatenate(([False], tokens[period:] == tokens[:-period], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        repeats = longest // period + 1
        if repeats >= 2 and repeats * period > best[0]:
            best = (repeats * period, period, repeats)
    return best[1], best[2]


def _cycles(runs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in runs:
        yield pd.DataFrame([repeated_block(np.asarray(t)) for t in batch], columns=["period", "repeats"])


def page_run(numbers: list[int]) -> list[int]:
    """The numbers at ``page_run_places``."""
    return [numbers[i] for i in page_run_places(numbers)]


def page_run_places(numbers: list[int]) -> list[int]:
    """Places of the longest strictly increasing subsequence (each place takes its earliest best predecessor, the first best end wins), cut where it jumps by over 100; the longest part, the first on a tie."""
    tails: list[list[int]] = []  # per length, the ends in order of place; their numbers fall
    back = [-1] * len(numbers)
    for i, x in enumerate(numbers):
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if numbers[tails[mid][-1]] < x else (lo, mid)
        if lo:
            ends = tails[lo - 1]
            a, b = 0, len(ends) - 1
            while a < b:
                mid = (a + b) // 2
                a, b = (a, mid) if numbers[ends[mid]] < x else (mid + 1, b)
            back[i] = ends[a]
        if lo == len(tails):
            tails.append([])
        tails[lo].append(i)
    if not tails:
        return []
    chain, i = [], tails[-1][0]
    while i >= 0:
        chain.append(i)
        i = back[i]
    chain.reverse()
    cuts = [0, *(j for j in range(1, len(chain)) if numbers[chain[j]] - numbers[chain[j - 1]] > 100), len(chain)]
    return max((chain[a:b] for a, b in zip(cuts, cuts[1:])), key=len)


def _page_runs(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda a: page_run([int(x) for x in a]))


def cycle(tokens: Column | str) -> Column:
    """(period, repeats) of an array of tokens."""
    return F.pandas_udf(_cycles, "struct<period: long, repeats: long>")(tokens)


def _page_places(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda a: page_run_places([int(x) for x in a]))


def page_places(numbers: Column | str) -> Column:
    """The places (from 0) of an array's numbers that make up its page run."""
    return F.pandas_udf(_page_places, "array<int>")(numbers)


def page_runs(numbers: Column | str) -> Column:
    """The numbers of an array that make up its page run."""
    return F.pandas_udf(_page_runs, "array<bigint>")(numbers)
