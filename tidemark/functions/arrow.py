"""Similarities that column expressions can only fold letter by letter, over Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=100_000)
def _jaro(a: str, b: str) -> float:
    """Each letter of a takes the first free equal letter of b inside the window; half transpositions
    count as halves."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    reach = max(la, lb) // 2 - 1
    if not la or not lb or reach < 0:
        return 0.0
    used, took = bytearray(lb), []
    for i, letter in enumerate(a):
        end = min(i + reach + 1, lb)
        j = b.find(letter, max(0, i - reach), end)
        while j >= 0 and used[j]:
            j = b.find(letter, j + 1, end)
        if j >= 0:
            used[j] = 1
            took.append(letter)
    m = len(took)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(took, (j for j in range(lb) if used[j])))
    return (m / la + m / lb + (m - moved / 2) / m) / 3


@lru_cache(maxsize=100_000)
def _winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    if j < 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def _over(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return pandas_udf(run, DoubleType())


jaro = _over(_jaro)
jaro_winkler = _over(_winkler)
