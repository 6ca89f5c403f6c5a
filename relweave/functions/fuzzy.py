"""Similarity of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared blank-separated tokens over all of them; 0 if there are none."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1, boost_from: float = 0.7) -> float:
    """Jaro similarity, raised for a common beginning of up to four letters where it is above boost_from."""
    s = jaro(a, b)
    if s <= boost_from:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + same * scale * (1 - s)


#: Letters of one side that are compared at once; longer strings go in smaller lots.
LOT = 2_000_000


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    """Code points, a row for each string, filled up with pad."""
    out = np.full((len(strings), width), pad, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _lot(a: list[str], b: list[str], scale: float, boost_from: float) -> np.ndarray:
    n, la, lb = len(a), np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    x, y = _codes(a, max(int(la.max()), 1), -1), _codes(b, max(int(lb.max()), 1), -2)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    at, used, hit = np.arange(y.shape[1]), np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):  # a letter of each string at a time
        near = (y == x[:, i : i + 1]) & ~used & (at >= (i - reach)[:, None]) & (at <= (i + reach)[:, None])
        some = np.flatnonzero(near.any(1))
        used[some, near[some].argmax(1)] = True
        hit[some, i] = True
    m = hit.sum(1)
    # the letters that were found, in their order on either side
    width = min(x.shape[1], y.shape[1])
    p = np.take_along_axis(x, np.argsort(~hit, axis=1, kind="stable"), 1)[:, :width]
    q = np.take_along_axis(y, np.argsort(~used, axis=1, kind="stable"), 1)[:, :width]
    moved = ((p != q) & (np.arange(width) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    s = np.where((la == lb) & (la == 0), 1.0, s)
    k = min(4, width)
    same = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(1)
    return np.where(s > boost_from, s + same * scale * (1 - s), s)[:n]


def jaro_winkler_all(a: list[str], b: list[str], scale: float = 0.1, boost_from: float = 0.7) -> np.ndarray:
    """jaro_winkler of every pair (a[i], b[i]): strings of like length are compared together, letter by letter."""
    out = np.empty(len(a))
    width = np.fromiter((max(len(x), len(y), 1) for x, y in zip(a, b)), np.int64, len(a))
    order = np.argsort(width, kind="stable")
    i = 0
    while i < len(order):
        # widths ascend, so a lot is as wide as its last
        fits = np.flatnonzero((np.arange(1, len(order) - i + 1)) * width[order[i:]] > LOT)
        j = i + max(1, int(fits[0]) if len(fits) else len(order) - i)
        some = order[i:j]
        out[some] = _lot([a[k] for k in some], [b[k] for k in some], scale, boost_from)
        i = j
    return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """jaro_winkler of two columns in Arrow batches, all pairs of a batch together; null if either is null."""
    for a, b in pairs:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = jaro_winkler_all(a[known].tolist(), b[known].tolist())
        yield pd.Series(out) if known.all() else pd.Series(pd.array(np.where(known, out, 0.0), "Float64")).mask(~known)
