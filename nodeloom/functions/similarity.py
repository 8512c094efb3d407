"""String similarities that Spark lacks, as Arrow UDFs, and MinHash signatures."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType


def jaro_py(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, common = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                common.append(x)
                break
    if not common:
        return 0.0
    other = [y for y, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(common, other)) // 2
    m = len(common)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_py(a: str, b: str, weight: float = 0.1, boost: float = 0.7) -> float:
    s = jaro_py(a, b)
    if s <= boost:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s)


def damerau_py(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def _pairs(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(jaro_py, a, b)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(jaro_winkler_py, a, b)


@F.pandas_udf(LongType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(damerau_py, a, b)


@F.pandas_udf(BooleanType())
def one_typo(a: pd.Series, b: pd.Series) -> pd.Series:
    """Same length and at most one substitution or swap of neighbours."""
    return _pairs(lambda x, y: len(x) == len(y) and damerau_py(x, y) <= 1, a, b)


_PRIME = np.uint64((1 << 61) - 1)


@lru_cache(4)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    return r.randint(1, int(_PRIME), n, dtype=np.uint64), r.randint(0, int(_PRIME), n, dtype=np.uint64)


def minhash_py(text: str, k: int = 3, n: int = 128, seed: int = 1) -> np.ndarray:
    """MinHash signature of the character shingles of a text without its blanks."""
    text = text.replace(" ", "")
    shingles = {text[i : i + k] for i in range(len(text) - k + 1)} or {text}
    a, b = _permutations(n, seed)
    h = np.array([int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "little") for s in shingles], np.uint64)
    return ((h[:, None] * a + b) % _PRIME & np.uint64(0xFFFFFFFF)).min(axis=0)


def bands(n_bands: int = 14, rows: int = 9):
    """UDF text -> array of band keys. 14 bands of 9 rows are the split of 128 permutations with
    the least summed error around a similarity of 0.7."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            sig = minhash_py(t or "")
            out.append([int.from_bytes(hashlib.blake2b(sig[i * rows : (i + 1) * rows].tobytes() + bytes([i]), digest_size=8).digest(), "little", signed=True) for i in range(n_bands)])
        return pd.Series(out)

    return run
