"""String similarities that Spark has no built-in for, as kernels over Python strings and as Arrow column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Jaro similarity; two empty strings are equal (1), an empty one is like nothing else (0)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                from_a.append(ch)
                break
    m = len(from_a)
    if not m:
        return 0.0
    from_b = (ch for ch, open_ in zip(b, free, strict=True) if not open_)
    swaps = sum(x != y for x, y in zip(from_a, from_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro raised by a tenth of what is missing for each of up to four shared first characters, above 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    shared = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        shared += 1
    return base + 0.1 * shared * (1 - base)


def levenshtein_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no substring edited twice."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return old[-1]


def damerau_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, between which other edits may stand."""
    far = len(a) + len(b)
    grid = {(-1, -1): far}
    for i in range(len(a) + 1):
        grid[i, -1], grid[i, 0] = far, i
    for j in range(len(b) + 1):
        grid[-1, j], grid[0, j] = far, j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            grid[i, j] = min(grid[i - 1, j - 1] + (x != y), grid[i, j - 1] + 1, grid[i - 1, j] + 1, grid[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return grid[len(a), len(b)]


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _of_longest(distance: Callable[[str, str], int]) -> Callable[[str, str], float]:
    return lambda a, b: 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


def indel(a: str, b: str) -> float:
    """Edits without substitution, over the sum of lengths."""
    return 1.0 if a == b else 2 * common_subsequence(a, b) / (len(a) + len(b))


def lcsseq(a: str, b: str) -> float:
    return 1.0 if a == b else common_subsequence(a, b) / max(len(a), len(b))


SIMILARITIES: dict[str, Callable[[str, str], float]] = {
    "exact": lambda a, b: float(a == b),
    "jaro": jaro,
    "jaro_winkler": jaro_winkler,
    "levenshtein": _of_longest(levenshtein_distance),
    "damerau_levenshtein": _of_longest(damerau_distance),
    "osa": _of_longest(osa_distance),
    "indel": indel,
    "lcsseq": lcsseq,
}


def similarity(name: str) -> Callable[[Column, Column], Column]:
    """Column function of a named similarity. Null on either side gives null. Equal pairs in a batch are computed once."""
    if name == "exact":
        return lambda a, b: (a == b).cast("double")
    if name == "levenshtein":
        return lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    kernel = SIMILARITIES[name]

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = lru_cache(maxsize=1 << 16)(kernel)
        return pd.Series([None if x is None or y is None else known(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return lambda a, b: run(a, b)


def with_similarity(df: DataFrame, a: str, b: str, name: str, out: str) -> DataFrame:
    """Adds ``out``: the similarity of columns a and b, computed once for each distinct pair of values and joined back.

    For kernels that leave the JVM this pays where values repeat; the distinct pairs are combined before their exchange.
    """
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct().withColumn(out, similarity(name)(F.col("_a"), F.col("_b")))
    return df.join(pairs, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_a", "_b")
