"""Single-pass clustering of seed matches into patterns. The result depends on the order of the tuples, so it is a fold in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Similarities are rounded to so many digits, so that equal ones are equal however they are summed up; HALF a unit of the last digit is what
#: rounding adds at most, so that a similarity reaches a threshold where its rounded value does.
DIGITS = 12
HALF = 0.5 * 10.0**-DIGITS


#: Tuples that are compared with the members at once, and members of a piece of the matrix.
BLOCK, PIECE = 512, 8192


def similar(y: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) where it reaches the threshold: single precision, which errs by less than the slack, leaves few to compute in full."""
    norm, most = np.sqrt(np.square(x).sum(1)), np.sqrt(np.square(y).sum(1).max(initial=0.0))
    low = threshold - HALF - ((x.shape[1] + 8) * norm * most + abs(threshold)) * 2.0**-22
    with np.errstate(over="ignore", invalid="ignore"):
        close = y.astype(np.float32) @ x.astype(np.float32).T >= low.astype(np.float32)
        close[:, ~((norm < 1e15) & (most < 1e15))] = True
        cells = np.flatnonzero(close)
        m, row = np.divmod(cells, len(x))
        if len(cells) > close.size // 20:
            s = (y @ x.T).ravel()[cells]
        else:
            s = np.concatenate([np.empty(0)] + [np.einsum("ij,ij->i", y[m[i : i + 16384]], x[row[i : i + 16384]]) for i in range(0, len(cells), 16384)])
    ok = s >= threshold - HALF
    return row[ok], m[ok], s[ok]


class Clusters:
    """Clusters as they grow: the members' keys, and the vectors of all members in pieces of a matrix."""

    def __init__(self, threshold: float, first_id: int = 0):
        self.threshold, self.next, self.size = threshold, first_id, 0
        self.ids: list[int] = []
        self.keys: list[set[str]] = []
        self.where: dict[int, int] = {}
        self.pieces: list[np.ndarray] = []
        self.of, self.count = np.empty(64, np.int64), np.empty(64, np.int64)

    def load(self, pattern_id: int, key: str, x: np.ndarray) -> None:
        """A member of an earlier pass."""
        if pattern_id not in self.where:
            self._open(pattern_id)
        self._put(self.where[pattern_id], key, x)

    def _open(self, pattern_id: int) -> int:
        c = self.where[pattern_id] = len(self.ids)
        self.ids.append(pattern_id)
        self.keys.append(set())
        if c == len(self.count):
            self.count = np.resize(self.count, 2 * c)
        self.count[c] = 0
        self.next = max(self.next, pattern_id + 1)
        return c

    def _put(self, c: int, key: str, x: np.ndarray) -> bool:
        if key in self.keys[c]:
            return False
        self.keys[c].add(key)
        if self.size == len(self.of):
            self.of = np.resize(self.of, 2 * self.size)
        if self.size == PIECE * len(self.pieces):
            self.pieces.append(np.empty((PIECE, len(x))))
        self.pieces[-1][self.size % PIECE], self.of[self.size] = x, c
        self.size += 1
        self.count[c] += 1
        return True

    def _members(self, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(start - start % PIECE, end, PIECE):
            first = max(at, start)
            yield first, self.pieces[at // PIECE][first - at : end - at]

    def _choose(self, m: np.ndarray, s: np.ndarray) -> int | None:
        """The accepting cluster with the highest score, the first of equal ones, of those with a similar member (m, similarity s)."""
        if not len(m):
            return None
        c, of = np.unique(self.of[m], return_inverse=True)
        top = np.zeros(len(c))
        np.maximum.at(top, of, s)
        score = np.where(2 * np.bincount(of) >= self.count[c], np.round(top, DIGITS), 0.0)
        best = int(score.argmax())
        return int(c[best]) if score[best] >= self.threshold else None

    def add(self, keys: list[str], x: np.ndarray) -> list[tuple[int, int]]:
        """Puts the tuples, in their order, into the accepting cluster with the highest score, or a new one below the threshold. (row, pattern) of what was added.

        A block of tuples meets the members before it in one product; those that the block adds are compared one tuple at a time.
        """
        added = []
        for at in range(0, len(x), BLOCK):
            block, before = x[at : at + BLOCK], self.size
            found = [(r, m + first, s) for first, y in self._members(0, before) for r, m, s in [similar(y, block, self.threshold)]]
            r, m, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            order = np.argsort(r, kind="stable")
            m, s, ends = m[order], s[order], np.searchsorted(r[order], np.arange(len(block) + 1))
            for i, v in enumerate(block):
                if not self.ids:  # the very first tuple opens a cluster and is then clustered like any other
                    added.append((at + i, self.ids[c := self._open(self.next)]))
                    self._put(c, keys[at + i], v)
                ms, ss = [m[ends[i] : ends[i + 1]]], [s[ends[i] : ends[i + 1]]]
                for first, y in self._members(before, self.size):
                    new = y @ v
                    ms.append(np.flatnonzero(new >= self.threshold - HALF) + first)
                    ss.append(new[ms[-1] - first])
                c = self._choose(np.concatenate(ms), np.concatenate(ss))
                if c is None:
                    c = self._open(self.next)
                if self._put(c, keys[at + i], v):
                    added.append((at + i, self.ids[c]))
        return added


def cluster_pass(matched: DataFrame, members: DataFrame | None, threshold: float, first_id: int = 0, order: str = "tuple_ord") -> DataFrame:
    """(pattern_id, tuple_key, tuple_ord, x): members that a pass over the matched tuples adds.

    Tuples come in ascending order. Each goes to the accepting pattern with the highest score, the lowest pattern winning ties; if
    that score is below the threshold it opens a new one. Only the members of the patterns are held in memory, not the tuples.
    Rows of earlier members (members) are fed in ahead of the tuples.
    """
    rows = matched.select(F.lit(1).alias("turn"), F.col(order).cast("bigint").alias("ord"), F.lit(-1).cast("bigint").alias("pattern_id"), "tuple_key", "x")
    if members is not None:
        rows = rows.unionByName(members.select(F.lit(0).alias("turn"), F.col("tuple_ord").cast("bigint").alias("ord"), F.col("pattern_id").cast("bigint").alias("pattern_id"), "tuple_key", "x"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Clusters(threshold, first_id)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n = int((b.column("turn").to_numpy() == 0).sum())  # earlier members come first
            keys = b.column("tuple_key").to_pylist()
            for pid, key, v in zip(b.column("pattern_id")[:n].to_pylist(), keys, x):
                state.load(pid, key, v)
            added = state.add(keys[n:], x[n:])
            at = pa.array([n + i for i, _ in added], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p in added], pa.int64()), *[b.column(c).take(at) for c in ("tuple_key", "ord", "x")]], ["pattern_id", "tuple_key", "tuple_ord", "x"])

    one = rows.repartition(1).sortWithinPartitions("turn", F.when(F.col("turn") == 0, F.col("pattern_id")), "ord")
    return one.mapInArrow(fold, "pattern_id bigint, tuple_key string, tuple_ord bigint, x array<double>")


def supported(members: DataFrame, least: int) -> DataFrame:
    """Members of the patterns with at least that many distinct members."""
    often = members.groupBy("pattern_id").agg(F.count_distinct("tuple_key").alias("n")).where(F.col("n") >= least)
    return members.join(often.select("pattern_id"), "pattern_id", "left_semi")


def pattern_words(members: DataFrame, tuples: DataFrame) -> DataFrame:
    """(pattern_id, words): the distinct contexts between the entities of each pattern's members, sorted."""
    rows = members.select("pattern_id", "tuple_ord").join(tuples.select("tuple_ord", "bet_words"), "tuple_ord").where("bet_words is not null")
    return rows.select("pattern_id", "bet_words").distinct().groupBy("pattern_id").agg(F.sort_array(F.collect_list("bet_words")).alias("words"))
