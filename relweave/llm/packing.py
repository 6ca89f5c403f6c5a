"""Containers of fixed capacity filled with items, by linear grouping.

Large lengths are rounded up within groups of equal cardinality, so that few sizes are left; configurations of these are chosen one after another, each
the fullest that holds an item of the largest size left (a dynamic program over the capacity, greedy over the configurations, not a linear program),
and used as often as the counts allow; documents take the places of their group by rank; small ones go by best fit into what is left.

Everything that is decided on the driver is decided on counts by length, of which there are at most as many as the capacity: how
often each configuration of rounded lengths is used, and how many small items of each length go into how many containers with
which free space. Which documents these are follows on the executors from a document's rank among those of its length. So the
plan does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.tokens import count_tokens
from relweave.session import materialize

#: Groups of equal cardinality to which large lengths are rounded up.
GROUPS = 128
#: Items of at most this share of the capacity are small.
SMALL = 8
#: Rows of one length and bucket that are ranked together.
RANKED = 200_000


def cut_items(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, len): a document whole, or one over the capacity as full pieces and the rest."""
    n = F.col("n_tokens")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("bigint") - 1, F.lit(0).cast("bigint")))
    return counts.select("doc_id", "n_tokens", F.explode(pieces).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"),
        F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("len"),
    )


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with rank: 0, 1, ... within equal key. A hot key is ranked in buckets, which the counts by bucket then join up."""
    n = df.count()
    buckets = max(1, -(-n // RANKED))
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    offset = b.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offset = offset.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    local = b.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__b").orderBy(*order)))
    out = local.join(offset.select(key, "__b", F.coalesce("__before", F.lit(0)).alias("__before")), [key, "__b"])
    return out.withColumn("rank", F.col("__before") + F.col("__k") - 1).drop("__b", "__k", "__before")


def _fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by group of the configuration that holds an item of the largest group left and fills the capacity best with it.

    No group is used beyond what is left of it. Taking the largest first keeps them from being left over, alone in containers.
    """
    top = int(np.flatnonzero(left)[0])  # sizes descend
    left = left.copy()
    left[top] -= 1
    capacity -= int(sizes[top])
    used = np.zeros((len(sizes), capacity + 1), np.int64)
    ok = np.zeros(capacity + 1, bool)
    ok[0] = True
    for g, s in enumerate(sizes):
        for _ in range(min(int(left[g]), capacity // int(s))):
            new = np.zeros_like(ok)
            new[s:] = ok[:-s]
            new &= ~ok
            at = np.flatnonzero(new)
            if not len(at):
                break
            used[:, at] = used[:, at - s]
            used[g, at] += 1
            ok[at] = True
    out = used[:, np.flatnonzero(ok).max()].copy()
    out[top] += 1
    return out


def configurations(hist: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]], int]:
    """Plan for large items. hist: items by length.

    Returns the groups (rounded size, first rank, end) over the items in descending length, the slots (group, first slot, end,
    container of the first, slots a container), and the number of containers.
    """
    lengths = sorted(hist, reverse=True)
    total = sum(hist.values())
    if not total:
        return [], [], 0
    full = hist.get(capacity, 0)  # these need no rounding
    cuts = [0, full] if full else [0]
    rest = total - full
    k = min(groups, rest)
    cuts += [full + rest * (i + 1) // k for i in range(k)] if k else []
    ends = np.cumsum([hist[x] for x in lengths])
    bands = [(lengths[int(np.searchsorted(ends, a, side="right"))], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    sizes = np.array([s for s, _, _ in bands])
    left = np.array([b - a for _, a, b in bands], np.int64)
    taken = np.zeros(len(bands), np.int64)
    slots, containers = [], 0
    while left.sum():
        use = _fullest(sizes, left, capacity)
        times = int(min(left[g] // use[g] for g in np.flatnonzero(use)))
        for g in np.flatnonzero(use):
            slots.append((int(g), int(taken[g]), int(taken[g] + use[g] * times), containers, int(use[g])))
            taken[g] += use[g] * times
        left -= use * times
        containers += times
    return bands, slots, containers


def best_fit(small: dict[int, int], free: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan for small items by length into containers by free space.

    Longest first, each into the fullest container that holds it, else into a new one. Rows (length, first rank, end, free
    space at the start, first container of that free space, items a container); new ones have free space capacity + 1. Second, the
    number of new containers.
    """
    state: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    for f, n in free.items():
        if n and f:
            state[f].append((f, 0, n))
    rows, fresh = [], 0
    for size in sorted((x for x in small if x), reverse=True):
        n, rank = small[size], 0
        f = size
        while n and f <= capacity:
            if not state[f]:
                f += 1
                continue
            origin, lo, hi = state[f].pop()
            q = f // size
            use = min(hi - lo, n // q)
            if use:
                rows.append((size, rank, rank + use * q, origin, lo, q))
                rank, n = rank + use * q, n - use * q
                state[f - q * size].append((origin, lo, lo + use))
                lo += use
            elif lo < hi:  # fewer than q are left
                rows.append((size, rank, rank + n, origin, lo, n))
                state[f - n * size].append((origin, lo, lo + 1))
                rank, n, lo = rank + n, 0, lo + 1
            if lo < hi:
                state[f].append((origin, lo, hi))
        if n:
            q = capacity // size
            whole, rest = divmod(n, q)
            if whole:
                rows.append((size, rank, rank + whole * q, capacity + 1, fresh, q))
                state[capacity - q * size].append((capacity + 1, fresh, fresh + whole))
            if rest:
                rows.append((size, rank + whole * q, rank + n, capacity + 1, fresh + whole, rest))
                state[capacity - rest * size].append((capacity + 1, fresh + whole, fresh + whole + 1))
            fresh += whole + bool(rest)
    return rows, fresh


def _lookup(rows: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of the row (key, first, end, ...) that holds each (key, rank). rows are sorted by key, first."""
    base = int(rank.max(initial=0)) + int(rows[:, 2].max(initial=0)) + 1
    return np.searchsorted(rows[:, 0] * base + rows[:, 1], key * base + rank, side="right") - 1


def pack(counts: DataFrame, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id) for counts (doc_id, n_tokens).

    A document has one row, one over the capacity a row for each piece; no container holds more than the capacity.
    Documents without tokens are spread over the containers. Container numbers are 0, 1, ...; copies of a document count once,
    with the greatest length; null identifiers are left out, null lengths are 0. An empty table gives no rows.
    """
    spark = counts.sparkSession
    once = counts.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("n_tokens"))
    items = materialize(cut_items(once, capacity), "items")
    items = materialize(ranked(items, "len", ["doc_id", "piece"]), "ranked")
    hist = {r.len: r.n for r in items.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    limit = capacity // SMALL
    large_hist = {k: v for k, v in hist.items() if k > limit}
    bands, slots, n_large = configurations(large_hist, capacity)

    lengths = sorted(large_hist, reverse=True)
    before = dict(zip(lengths, np.concatenate([[0], np.cumsum([large_hist[x] for x in lengths])])[:-1].tolist())) if lengths else {}
    starts = np.zeros(capacity + 1, np.int64)
    for k, v in before.items():
        starts[k] = v
    firsts = np.array([a for _, a, _ in bands], np.int64)
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column("len").to_numpy().astype(np.int64), b.column("rank").to_numpy().astype(np.int64)
            at = starts[size] + rank
            g = np.searchsorted(firsts, at, side="right") - 1
            slot = at - firsts[g]
            row = table[_lookup(table, g, slot)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(row[:, 3] + (slot - row[:, 1]) // row[:, 4])], [*b.schema.names, "container_id"])

    columns = "doc_id bigint, piece int, first_token bigint, len int"
    schema = f"{columns}, rank bigint, container_id bigint"
    names = [x.split()[0] for x in columns.split(", ")]
    source = items.select(*names, F.col("rank").cast("bigint").alias("rank"))
    large = materialize(source.where(F.col("len") > limit).mapInArrow(place, schema), "large")

    free = large.groupBy("container_id").agg((capacity - F.sum("len")).cast("int").alias("free"))
    free = materialize(ranked(materialize(free, "free"), "free", ["container_id"]), "free")
    by_free = {r.free: r.n for r in free.groupBy("free").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    rows, fresh = best_fit({k: v for k, v in hist.items() if 0 < k <= limit}, by_free, capacity)
    plan = np.array(sorted(rows), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(plan)
    total = max(1, n_large + fresh)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column("len").to_numpy().astype(np.int64), b.column("rank").to_numpy().astype(np.int64)
            row = p[_lookup(p, size, rank)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(row[:, 3]), pa.array(row[:, 4] + (rank - row[:, 1]) // row[:, 5])], [*b.schema.names, "free", "at"])

    fitted = source.where((F.col("len") > 0) & (F.col("len") <= limit)).mapInArrow(fit, f"{columns}, rank bigint, free bigint, at bigint")
    new = fitted.where(F.col("free") > capacity).withColumn("container_id", F.col("at") + n_large)
    old = fitted.where(F.col("free") <= capacity).join(free.select(F.col("free").cast("bigint").alias("free"), F.col("rank").cast("bigint").alias("at"), "container_id"), ["free", "at"])
    none = source.where(F.col("len") == 0).withColumn("container_id", F.pmod("rank", F.lit(total)))
    out = [x.select(*names, "container_id") for x in (large, new, old, none)]
    rows_out: DataFrame = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    length: Column = F.col("len").cast("bigint").alias("n_tokens")
    return rows_out.select("doc_id", "piece", "first_token", length, "container_id")


def pack_documents(df: DataFrame, record: str, text: str, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """pack() of texts measured in tokens of the vocabulary."""
    return pack(count_tokens(df, record, text, vocabulary), capacity)


def unused(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row (containers, documents, tokens, fullest, unused_share)."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    a = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest"))
    d = packed.where("piece = 0").agg(F.count(F.lit(1)).alias("documents"))
    return a.crossJoin(d).select("containers", "documents", "tokens", "fullest", F.try_divide(F.col("containers") * capacity - F.col("tokens"), F.col("containers") * capacity).alias("unused_share"))


def faults(packed: DataFrame, counts: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row that counts what is wrong with pack(counts): all zeros, besides documents, if nothing is.

    overfull: containers over the capacity; lost and strange: documents without a container, and those that counts has not; cut: documents within the
    capacity in more than one piece; short: documents whose pieces do not add up or do not follow each other.
    """
    once = counts.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("__n"))
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("__sum"), F.count(F.lit(1)).alias("__k"), F.max(F.col("first_token") + F.col("n_tokens")).alias("__end"), F.count_distinct("piece").alias("__pieces"))
    both = once.join(per, "doc_id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias
    d = both.agg(
        n(F.col("__n").isNotNull())("documents"), n(F.col("__k").isNull())("lost"), n(F.col("__n").isNull())("strange"), n((F.col("__n") <= capacity) & (F.col("__k") > 1))("cut"),
        n((F.col("__sum") != F.col("__n")) | (F.col("__end") != F.col("__n")) | (F.col("__pieces") != F.col("__k")))("short"),
    )
    return d.crossJoin(packed.groupBy("container_id").agg(F.sum("n_tokens").alias("__t")).agg(n(F.col("__t") > capacity)("overfull")))
