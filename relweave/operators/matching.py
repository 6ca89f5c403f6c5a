"""Tuples against extraction patterns: similarity, majority vote, best pattern.

A tuple's three context vectors are kept as one vector x (see functions.vectors.weighted_unit), so that the similarity of two
tuples is one dot product. Patterns are sets of members (pattern_id, tuple_key, x).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.operators.clustering import DIGITS, HALF
from relweave.session import materialize

#: Bytes of member vectors that are sent to the executors at once; more members are matched in blocks.
SENT = 64 << 20
#: Similarities that a worker holds at once.
CELLS = 2 << 20
#: Vectors of this length or more are not compared in single precision.
LARGE = 1e15


def seed_matches(tuples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tuples whose (ent1, ent2) is a seed, exactly as written; repeats stay."""
    return tuples.join(seeds.select("ent1", "ent2").distinct(), ["ent1", "ent2"], "left_semi")


def seed_match_counts(tuples: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ent1, ent2, matches) of seeds with any."""
    return seed_matches(tuples, seeds).groupBy("ent1", "ent2").agg(F.count(F.lit(1)).alias("matches"))


def matched_seeds(tuples: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_match_counts, most matches first; of equal ones by name."""
    return seed_match_counts(tuples, seeds).orderBy(F.col("matches").desc(), "ent1", "ent2")


def best_patterns(voted: DataFrame, key: str = "tuple_ord") -> DataFrame:
    """Of each tuple's accepting patterns that with the highest score above 0; the lowest pattern_id wins ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "pattern_id"))
    return voted.where(F.col("accepted") & (F.col("score") > 0)).withColumn("__r", rank).where("__r = 1").drop("__r")


class Members:
    """Members of patterns as a matrix, patterns one after the other; or a part of those of one pattern of n members."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int | None = None):
        order = np.argsort(ids, kind="stable")
        self.x = x[order]
        self.ids, self.first = np.unique(ids[order], return_index=True)
        self.n = np.diff(np.append(self.first, len(ids))) if n is None else np.array([n])
        self.norm = np.sqrt(np.square(self.x).sum(1).max(initial=0.0))
        # a pattern whose first members are not similar cannot win its vote: more than half of them are looked at first, in single precision
        seen = np.minimum(self.n, self.n // 2 + 1 + self.n // 16) if n is None else np.array([len(ids)])
        self.seen, self.rest, self.start = seen, self.n - seen, np.cumsum(seen) - seen

    @functools.cached_property
    def near(self) -> np.ndarray:
        """The members looked at first; made where it is used, not sent."""
        return self.x[np.repeat(self.first - self.start, self.seen) + np.arange(self.seen.sum())].astype(np.float32)

    def screened(self, x: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of x by slices: where a slice begins, and for each pattern (rows) and row (columns) at least as many as are similar of the members
        looked at first. Single precision errs by less than the slack; rows that are no such numbers get all."""
        step, of = max(1, CELLS // max(1, len(self.near))), np.repeat(np.arange(len(self.ids)), self.seen)
        norm = np.sqrt(np.square(x).sum(1))
        low = threshold - HALF - ((x.shape[1] + 8) * norm * self.norm + abs(threshold)) * 2.0**-22
        odd = ~((norm < LARGE) & (self.norm < LARGE))
        for at in range(0, len(x), step):
            with np.errstate(over="ignore", invalid="ignore"):
                close = self.near @ x[at : at + step].astype(np.float32).T >= low[at : at + step].astype(np.float32)
            m, row = np.divmod(np.flatnonzero(close), wide := close.shape[1])  # few are similar: these are counted
            good = np.bincount(of[m] * wide + row, minlength=wide * len(self.ids)).reshape(-1, wide)
            good[:, odd[at : at + step]] = len(self.near)
            yield at, good

    def accepted(self, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pattern_id, score) of each row of x and pattern that accepts it, by slices of the rows; what the first look leaves open is computed in full."""
        for at, good in self.screened(x, threshold):
            j, i = np.nonzero(2 * (good + self.rest[:, None]) >= self.n[:, None])
            found = []
            for rows, p in zip(np.split(i + at, cut := np.flatnonzero(np.diff(j)) + 1), j[np.append(0, cut)] if len(j) else []):
                s = x[rows] @ self.x[self.first[p] : self.first[p] + self.n[p]].T
                ok = 2 * (s >= threshold - HALF).sum(1) >= self.n[p]
                found.append((rows[ok], np.full(ok.sum(), self.ids[p]), np.round(np.maximum(s[ok].max(1), 0.0), DIGITS)))
            if found:
                yield tuple(np.concatenate(c) for c in zip(*found))


def _x(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _blocks(members: DataFrame) -> tuple[list[DataFrame], list[tuple[int, list[DataFrame]]]]:
    """Members in blocks of whole patterns of about SENT bytes; and of each pattern that is larger by itself how many and those in parts of about SENT bytes."""
    sizes = members.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.max(F.size("x")) * 8).alias("bytes"))
    big = F.col("bytes") > SENT
    # patterns that are larger than a block are as few as their size makes them
    total, large = sizes.agg(F.coalesce(F.sum(F.when(~big, F.col("bytes"))), F.lit(0)), F.collect_list(F.when(big, F.struct("pattern_id", "n", "bytes")))).first()
    small = members.where(~F.col("pattern_id").isin([p for p, _, _ in large])) if large else members
    n = -(-2 * total // SENT) if total > SENT else 1 if total else 0
    whole = [small.where(F.pmod(F.xxhash64("pattern_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [small] * n
    parts = []
    for pid, count, size in large:
        k = -(-size // SENT)
        parts.append((count, [members.where((F.col("pattern_id") == pid) & (F.pmod(F.xxhash64("x"), F.lit(k)) == i)) for i in range(k)]))
    return whole, parts


def _sent(block: DataFrame, n: int | None = None):
    """A block's members on all executors, about SENT bytes; None if it has none."""
    rows = block.select("pattern_id", "x").toArrow()
    if rows.num_rows:
        return block.sparkSession.sparkContext.broadcast(Members(rows["pattern_id"].to_numpy(), _x(rows["x"].combine_chunks()), n))


class Patterns:
    """Blocks of members on all executors. A worker holds one block at a time, so each batch of tuples meets the blocks in turn where it is."""

    def __init__(self, whole: list[DataFrame], parts: list[tuple[int, list[DataFrame]]]):
        self.whole = [b for b in map(_sent, whole) if b]
        self.parts = [(n, [b for b in (_sent(p, n) for p in blocks) if b]) for n, blocks in parts]
        self.one = len(self.whole) + len(self.parts) == 1 and not self.parts

    def destroy(self) -> None:
        """Takes the blocks from the executors and from the driver's disk."""
        for sent in self.whole + [b for _, blocks in self.parts for b in blocks]:
            sent.destroy()

    @contextmanager
    def _held(self, sent) -> Iterator[Members]:
        yield sent.value
        if not self.one:
            sent.__dict__.pop("_value", None)  # read again from the worker's disk for the next batch

    def accepted(self, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pattern_id, score) of each row of x and pattern that accepts it, in pieces."""
        if not len(x):
            return
        for sent in self.whole:
            with self._held(sent) as m:
                yield from m.accepted(x, threshold)
        for n, parts in self.parts:
            # rows that can't win the vote any more are left out as soon as that is known
            rows, good, left = np.arange(len(x)), np.zeros(len(x), np.int64), n
            for sent in parts:
                with self._held(sent) as m:
                    left -= len(m.x)
                    for at, close in m.screened(x[rows], threshold):
                        good[rows[at : at + close.shape[1]]] += close[0]
                rows = rows[2 * (good[rows] + left) >= n]
                if not len(rows):
                    break
            if not len(rows):
                continue
            good, top = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for sent in parts:
                with self._held(sent) as m:
                    step, pid = max(1, CELLS // len(m.x)), m.ids[0]
                    for at in range(0, len(rows), step):
                        s = x[rows[at : at + step]] @ m.x.T
                        good[at : at + step] += (s >= threshold - HALF).sum(1)
                        top[at : at + step] = np.maximum(top[at : at + step], s.max(1))
            ok = 2 * good >= n
            yield rows[ok], np.full(ok.sum(), pid), np.round(top[ok], DIGITS)

    def best(self, x: np.ndarray, threshold: float, seen=lambda i, p: None) -> tuple[np.ndarray, np.ndarray]:
        """(pattern_id, score) of each row's best accepting pattern, the lowest of equal ones; 0 if none has more. seen is told which patterns accept which rows."""
        best, top = np.full(len(x), -1, np.int64), np.zeros(len(x))
        for i, p, s in self.accepted(x, threshold):
            seen(i, p)
            order = np.lexsort((p, -s, i))
            i, p, s = i[order], p[order], s[order]
            lead = np.append(True, i[1:] != i[:-1])[: len(i)]
            i, p, s = i[lead], p[lead], s[lead]
            more = (s > top[i]) | (s == top[i]) & (s > 0) & (p < best[i])
            best[i[more]], top[i[more]] = p[more], s[more]
        return best, top


def _in_rounds(rows: DataFrame, members: DataFrame, run: Callable[[Patterns, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> list[DataFrame]:
    """What run makes of rows with each block, or with all parts of a pattern: if these are more than one, each is written before the next goes out, so that the
    executors' disks hold one at a time. rows is then read as often: a table, not a join."""
    whole, parts = _blocks(members)
    rounds = [([b], []) for b in whole] + [([], [p]) for p in parts] or [([], [])]
    made = []
    for r in rounds:
        patterns = Patterns(*r)
        made.append(rows.mapInArrow(lambda batches, patterns=patterns: run(patterns, batches), schema))
        if len(rounds) > 1:
            made[-1] = materialize(made[-1], name)
            patterns.destroy()
    return made


def _united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def match(tuples: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> DataFrame:
    """(key, pattern_id, score) of every accepting pattern, by matrix products over slices of Arrow batches.

    Members go to the executors in blocks of whole patterns of about SENT bytes, and a pattern that is larger by itself in parts, whose votes
    are added up where the tuple is: nothing is shuffled.
    """

    def run(patterns: Patterns, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p, s in patterns.accepted(_x(b.column("x")), threshold):
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(i)), pa.array(p), pa.array(s)], ["k", "pattern_id", "score"])

    rows = tuples.select(F.col(key).cast("bigint").alias("k"), "x")
    return _united(_in_rounds(rows, members, run, "k bigint, pattern_id bigint, score double", "hits")).withColumnRenamed("k", key)


def best_and_counts(classed: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> tuple[DataFrame, DataFrame]:
    """Of tuples with x, pos, neg, unk: (key, pattern_id, score) of each tuple's best accepting pattern with a score above 0, and (pattern_id, positive, negative,
    unknown) over the tuples that each pattern accepts.

    Both are made where the tuples are: a task gives one row a tuple and one a pattern and batch, not one for each tuple and pattern. The
    result is written once and read twice.
    """
    flags = ["pos", "neg", "unk"]

    def run(patterns: Patterns, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, sums = np.stack([b.column(f).to_numpy() for f in flags]), []

            def seen(i: np.ndarray, p: np.ndarray, told=told, sums=sums) -> None:
                ids, of = np.unique(p, return_inverse=True)
                sums.append((ids, *[np.bincount(of, t[i], len(ids)).astype(np.int64) for t in told]))

            best, top = patterns.best(_x(b.column("x")), threshold, seen)
            some = np.flatnonzero(top > 0)
            none = np.zeros(len(some), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(some)), pa.array(best[some]), pa.array(top[some]), *[pa.array(none)] * 3], ["k", "pattern_id", "score", *flags])
            if sums:
                ids, of = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
                cols = [np.bincount(of, np.concatenate([s[c] for s in sums]), len(ids)).astype(np.int64) for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(np.zeros(len(ids))), *map(pa.array, cols)], ["k", "pattern_id", "score", *flags])

    rows = classed.select(F.col(key).cast("bigint").alias("k"), "x", *[F.col(f).cast("bigint").alias(f) for f in flags])
    made = _in_rounds(rows, members, run, "k bigint, pattern_id bigint, score double, pos bigint, neg bigint, unk bigint", "scored")
    both = _united(made) if len(made) > 1 else materialize(made[0], "scored")
    best = both.where("k is not null").select("k", "pattern_id", "score")
    if len(made) > 1:
        best = best.groupBy("k").agg(F.max_by(F.struct("pattern_id", "score"), F.struct("score", -F.col("pattern_id"))).alias("b")).select("k", "b.pattern_id", "b.score")
    counts = both.where("k is null").groupBy("pattern_id").agg(F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.sum("unk").alias("unknown"))
    return best.withColumnRenamed("k", key), counts


def best_of_rows(rows: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> DataFrame:
    """(key, pattern_id, score) of the best accepting pattern of each row with a score above 0, row by row: also for streams. All blocks go to the executors' disks."""
    patterns = Patterns(*_blocks(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, top = patterns.best(_x(b.column("x")), threshold)
            some = np.flatnonzero(top > 0)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(some)), pa.array(best[some]), pa.array(top[some])], ["k", "pattern_id", "score"])

    return rows.select(F.col(key).cast("bigint").alias("k"), "x").mapInArrow(run, "k bigint, pattern_id bigint, score double").withColumnRenamed("k", key)


def best_of_stream(stream: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> DataFrame:
    """best_of_rows for patterns that fit one block; others are refused."""
    whole, parts = _blocks(members)
    if parts or len(whole) > 1:
        raise ValueError("the patterns do not fit one block")
    return best_of_rows(stream, members, threshold, key)
