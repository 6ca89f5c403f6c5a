"""Near-duplicate records by b-bit MinHash.

A record is the multiset of its words: the second occurrence of a word is another element than the first, so Jaccard
similarity of elements is that of multisets. Records with equal multisets are one class before anything else. Every class gets
BANDS * ROWS minima. Bands of full minima give candidates; of the first PACKED minima only the lowest BITS bits are kept, packed into
two longs that travel with the bands, so that where a candidate is met its similarity is estimated by counting bits, corrected for
chance collisions. What the estimate does not rule out is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions import text as T
from relweave.llm.graph import components
from relweave.session import materialize

#: A pair at similarity 0.7 is missed by all bands with probability (1 - 0.7**4)**24 = 0.0014, one at 0.75 with 0.0001, at 0.8 with 3e-6.
BANDS, ROWS = 24, 4
#: Minima in the packed signature, and bits of each: two longs.
PACKED, BITS = 64, 2
#: How far below the threshold an estimate may lie: 3.6 standard errors at similarity 0.7.
MARGIN = 0.25


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Elements of records given as runs of sorted word hashes: the hash mixed with how many equal ones precede it."""
    n = len(hashes)
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[offsets[:-1]] = True
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return _mixed(hashes.view(np.uint64) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(elements: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (records x bands, int32) and packed low bits (records x 2, int64) of records given as runs of elements.

    Every record has at least one element. Minima are of 32-bit values of seeded multiply-shift hashes.
    """
    n, total, per = len(offsets) - 1, bands * rows, 64 // BITS
    seeds = np.random.default_rng(20240601).integers(1, 2**63, size=(total, 2), dtype=np.int64).astype(np.uint64)
    packed, keys = np.zeros((n, 2), np.uint64), np.empty((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(total):
            low = np.minimum.reduceat(((elements * (seeds[k, 0] | np.uint64(1)) + seeds[k, 1]) >> np.uint64(32)).astype(np.uint32), offsets[:-1]).astype(np.uint64)
            if k < PACKED:
                packed[:, k // per] |= (low & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (k % per))
            b, r = divmod(k, rows)
            keys[:, b] = _mixed((keys[:, b] if r else np.full(n, b + 1, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + low)
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32), packed.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A row (key, rep, s0, s1) for each record and band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column("hashes")
        offsets = np.asarray(arr.offsets, dtype=np.int64)
        flat = np.asarray(arr.values, dtype=np.int64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        keys, packed = signatures(numbered(flat, offsets), offsets, bands, rows)
        spread = [np.repeat(c, bands) for c in (batch.column("rep").to_numpy(), packed[:, 0], packed[:, 1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), *spread)], ["key", "rep", "s0", "s1"])


def word_hashes(df: DataFrame, record: str, text: str) -> DataFrame:
    """(id, hashes): the sorted hashes of each record's words.

    A record's copies count once, with the greatest non-null text; null texts and null identifiers are left out.
    """
    rows = df.select(F.col(record).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    return rows.groupBy("id").agg(F.max("t").alias("t")).select("id", F.sort_array(F.transform(T.words(F.col("t")), lambda w: F.xxhash64(w))).alias("hashes"))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, n_words), and classes of equal multisets of words, which two hashes over it and its size tell: (rep, n_words, hashes).

    rep is the smallest identifier. Both are written once; the classes carry the words, which all members have in common.
    """
    keys = ["k1", "k2", "n_words"]
    named = records.withColumns({"k1": F.xxhash64("hashes"), "k2": F.hash("hashes"), "n_words": F.size("hashes")})
    reps = materialize(named.groupBy(*keys).agg(F.min("id").alias("rep"), F.any_value("hashes").alias("hashes")), "classes")
    members = materialize(named.select("id", *keys).join(reps.select("rep", *keys), keys).select("id", "rep", "n_words"), "members")
    return members, reps.select("rep", "n_words", "hashes")


def estimate(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    """Similarity estimated from packed signatures, less what equal low bits of different minima add by chance."""
    low = F.lit(0x5555555555555555).cast("bigint")

    def unequal(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(low))

    same = F.lit(PACKED) - unequal(x[0], y[0]) - unequal(x[1], y[1])
    chance = 2.0**-BITS
    return (same / PACKED - chance) / (1 - chance)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact multiset similarity of the pairs' hashes, where it reaches the threshold."""

    def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = np.asarray(column.offsets, np.int64)
        flat, off = np.asarray(column.values, np.int64)[off[0] : off[-1]], off - off[0]
        size = np.diff(off)
        with np.errstate(over="ignore"):  # the pair's number is mixed in, so that all pairs are compared at once
            return _mixed(numbered(flat, off) + np.repeat(np.arange(len(size)), size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), size

    for b in batches:
        if not b.num_rows:
            continue
        (x, p), (y, q) = elements(b.column("ha")), elements(b.column("hb"))
        shared = np.bincount(np.repeat(np.arange(len(p)), p)[np.isin(x, y)], minlength=len(p))
        union = p + q - shared
        # the threshold is met in whole numbers: 0.7 of 10 words is 7 words
        keep = np.flatnonzero(shared >= threshold * union - 1e-9)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep)), pa.array(shared[keep] / union[keep])], ["a", "b", "similarity"])


def class_pairs(reps: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN) -> DataFrame:
    """(a, b, similarity): pairs of classes a < b with at least that similarity."""
    words = reps.where("n_words > 0").select("rep", "hashes")
    banded = words.mapInArrow(lambda it: _sign(it, bands, rows), "key int, rep bigint, s0 bigint, s1 bigint")
    x = banded.select("key", F.col("rep").alias("a"), F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    y = banded.select("key", F.col("rep").alias("b"), F.col("s0").alias("y0"), F.col("s1").alias("y1"))
    # A self-join on the band key: a hot key is split by adaptive skew handling, never collected. One exchange serves both sides.
    near = estimate((F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))) >= threshold - margin
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    both = pairs.join(words.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(words.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(lambda it: _compare(it, threshold), "a bigint, b bigint, similarity double")


def near_duplicate_pairs(df: DataFrame, record: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity) of records id_a < id_b whose word multisets have at least that similarity.

    Pairs inside a class have similarity 1, also those of texts without words. The result is as large as the classes make it;
    near_duplicate_groups gives one row a record instead.
    """
    members, reps = classes(word_hashes(df, record, text))
    pairs = class_pairs(reps, threshold)
    m = members.select("id", "rep")
    inside = m.alias("x").join(m.alias("y"), F.col("x.rep") == F.col("y.rep")).where(F.col("x.id") < F.col("y.id"))
    inside = inside.select(F.col("x.id").alias("p"), F.col("y.id").alias("q"), F.lit(1.0).alias("similarity"))
    across = (
        pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("p")), "a")
        .join(m.select(F.col("rep").alias("b"), F.col("id").alias("q")), "b")
        .select("p", "q", "similarity")
    )
    both = inside.unionByName(across)
    return both.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")


def near_duplicate_groups(df: DataFrame, record: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, links): one row for each record with a text.

    class_id is the smallest record with an equal word multiset, group_id the smallest that a chain of near-duplicates
    reaches, links the number of other classes that the record's class is near to.
    """
    members, reps = classes(word_hashes(df, record, text))
    pairs = materialize(class_pairs(reps, threshold), "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = components(pairs).select(F.col("node").alias("rep"), "component")
    out = members.join(links, "rep", "left").join(groups, "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
