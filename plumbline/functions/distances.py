"""String distances over columns of pairs: built-in where Spark has them, pandas UDFs over arrays otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = tuple("jw lv osa lcs hamming qgram jaccard cosine soundex".split())


def jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """Jaro-Winkler similarity; the prefix bonus takes up to four characters and always applies."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [b[j] for j in range(m) if used[j]]
    t = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (k / n + k / m + (k - t) / k) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * p * (1 - jaro)


def osa(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours, no part edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
            if before is not None and j > 1 and c == b[j - 2] and a[i - 2] == d:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def lcs(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b."""
    last = [0] * (len(b) + 1)
    for c in a:
        row = [0]
        for j, d in enumerate(b, 1):
            row.append(last[j - 1] + 1 if c == d else max(last[j], row[-1]))
        last = row
    return len(a) + len(b) - 2 * last[-1]


def _pairwise(function, kind: str):
    @F.pandas_udf(kind)
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)])

    return over


def distance(a: Column, b: Column, method: str = "jw", p: float = 0.1, q: int = 3) -> Column:
    """The distance of two text columns; null if either is null."""
    from plumbline.functions.text import jaccard, qgrams

    if method == "jw":
        return 1 - _pairwise(lambda x, y: jaro_winkler(x, y, p), "double")(a, b)
    if method == "lv":
        return F.levenshtein(a, b).cast("double")
    if method == "osa":
        return _pairwise(lambda x, y: float(osa(x, y)), "double")(a, b)
    if method == "lcs":
        return _pairwise(lambda x, y: float(lcs(x, y)), "double")(a, b)
    if method == "hamming":
        same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)
        return F.when(F.length(a) == F.length(b), same.cast("double")).otherwise(F.lit(float("inf")))
    if method == "jaccard":
        return 1 - jaccard(qgrams(a, q), qgrams(b, q))
    if method in ("qgram", "cosine"):
        from collections import Counter

        grams = lambda s: Counter(s[i : i + q] for i in range(max(1, len(s) - q + 1)))

        def qgram(x: str, y: str) -> float:
            u, v = grams(x), grams(y)
            return float(sum(abs(u[g] - v[g]) for g in set(u) | set(v)))

        def cosine(x: str, y: str) -> float:
            u, v = grams(x), grams(y)
            norm = (sum(c * c for c in u.values()) * sum(c * c for c in v.values())) ** 0.5
            return 1 - sum(u[g] * v[g] for g in u) / norm if norm else 1.0

        return _pairwise(qgram if method == "qgram" else cosine, "double")(a, b)
    if method == "soundex":
        return (F.soundex(a) != F.soundex(b)).cast("double")
    raise ValueError(f"unknown method {method!r}; one of {METHODS}")
