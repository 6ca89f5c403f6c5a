"""Evaluation passages inside training documents, by a distributed positional inverted index.

Documents are cut into shards; each shard is inverted by itself: every term -> its positions in the shard's words laid end to end, with
the start of each document. The index is a table, one row for each shard, that can be written once and searched with any items. A query set
(the evaluation items, stated and small beside the corpus) is matched against every shard. An item's rarest terms over the whole corpus are
chosen so that every window of the wanted length holds one; their lists, shifted by the term's offset in the item, are the candidate places, and
these are intersected with the shifted lists of the neighbouring terms, for all items of a shard at once. No posting is shuffled to answer a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions import text as T
from relweave.session import materialize

#: Words of a shard, unless a single document has more.
SHARD_WORDS = 400_000
INDEX = "shard bigint, doc_ids array<bigint>, starts array<bigint>, terms array<bigint>, ends array<bigint>, positions array<int>"
#: Item words sent to every executor at once; a larger set of items is matched in blocks of this size.
BLOCK_WORDS = 2_000_000
#: Candidate places compared at once in a shard.
PLACES = 1_000_000


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, documents, starts, words) of each shard of a partition."""
    from pyspark import TaskContext

    part, ids, lists, size, k = TaskContext.get().partitionId(), [], [], 0, 0

    def done():
        lengths = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        return (part << 32) + k, np.asarray(ids, np.int64), np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(lists) if lists else np.empty(0, np.int64)

    for batch in batches:
        words = batch.column("words")
        flat, off = np.asarray(words.values, np.int64), np.asarray(words.offsets, np.int64)
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            ids.append(doc)
            lists.append(flat[off[i] : off[i + 1]])
            size += len(lists[-1])
            if size >= limit:
                yield done()
                ids, lists, size, k = [], [], 0, k + 1
    if ids:
        yield done()


def _postings(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for shard, docs, starts, words in _shards(batches, limit):
        order = np.argsort(words, kind="stable").astype(np.int32)
        ranked = words[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(ranked)) if len(ranked) else first
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), one(docs), one(starts), one(ranked[first]), one(ends.astype(np.int64)), one(order)],
            ["shard", "doc_ids", "starts", "terms", "ends", "positions"],
        )


def build_index(df: DataFrame, record: str, text: str, path: str | None = None, shard_words: int | None = None) -> DataFrame:
    """The written index, a row for each shard: doc_ids, starts (of the documents, and the end), terms, ends, positions.

    Terms are 64-bit hashes of words; the postings of term i are positions[ends[i-1]:ends[i]], ascending. The postings of all words are stored,
    under path or in the shared folder; open_index reads them again for other items. Null texts have no postings, rows with a null identifier
    are left out.
    """
    docs = df.select(F.col(record).cast("bigint").alias("doc_id"), F.transform(T.words(F.col(text).cast("string")), lambda w: F.xxhash64(w)).alias("words"))
    docs, limit = docs.where(F.col("doc_id").isNotNull()), shard_words or SHARD_WORDS
    rows = docs.mapInArrow(lambda it: _postings(it, limit), INDEX)
    if path is None:
        return materialize(rows, "index")
    rows.write.parquet(path)
    return open_index(df.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that build_index wrote."""
    return spark.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, query, words): each item's words. Null identifiers are left out; copies of an item count once, query tells others of one identifier apart."""
    words = items.select(F.col(item).cast("bigint").alias("item_id"), T.words(F.col(text).cast("string")).alias("words")).where(F.col("item_id").isNotNull())
    return words.withColumn("query", F.xxhash64("item_id", "words")).distinct()


def counted(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, query, at, word, term, n): each word of the items, and how often it occurs in the corpus."""
    words = queries.select("item_id", "query", F.posexplode("words").alias("at", "word")).withColumn("term", F.xxhash64("word"))
    each = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("ends", i) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("n")))
    counts = index.select(F.inline(each)).join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    return words.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _anchors(weight: np.ndarray, length: int) -> list[int]:
    """Offsets such that each window of length words holds one, the rarest terms being preferred. Windows with a word that the corpus lacks need none."""
    chosen: list[int] = []
    last = -1
    while last + length < len(weight):
        # the window that begins after the last anchor must hold the next
        window = weight[last + 1 : last + 1 + length]
        low = window.min()
        last = last + 1 + int(np.flatnonzero(window == low)[-1])
        if low:
            chosen.append(last)
    return chosen


class _Shard:
    """A row of the index. A posting's key is its term's number and its position in one integer, ascending over the shard."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.docs, self.starts, self.terms, self.ends = row["doc_ids"], row["starts"], row["terms"], row["ends"]
        self.positions = row["positions"].astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else np.empty(0, np.int64)
        self.wide = int(self.starts[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.wide + self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms here, -1 for those that do not occur."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def places(self, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into number, position) of every posting of these terms, so many at once."""
        at = np.flatnonzero(number >= 0)
        size = self.ends[number[at]] - self.begins[number[at]]
        cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + PLACES, PLACES), side="left")
        for a, b in zip(cut, [*cut[1:], len(at)]):
            n = size[a:b]
            if n.sum():
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at[a:b], n), self.positions[np.repeat(self.begins[number[at[a:b]]], n) + inside]

    def within(self, number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the terms have a posting from lo to hi."""
        if not len(self.keys):
            return np.zeros(len(number), bool)
        k = np.searchsorted(self.keys, number * self.wide + lo)
        found = self.keys[np.minimum(k, len(self.keys) - 1)]
        return (number >= 0) & (lo <= hi) & (k < len(self.keys)) & (found <= number * self.wide + hi)

    def bounds(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document of each position, and where it begins and ends."""
        doc = np.searchsorted(self.starts, position, side="right") - 1
        return doc, self.starts[doc], self.starts[doc + 1]


class _Phrases:
    """Items laid end to end: their words as numbers of distinct terms, and the places of the anchors."""

    def __init__(self, items: pd.DataFrame):
        words = [np.asarray(w, np.int64) for w in items["terms"]]
        size = np.array([len(w) for w in words], np.int64)
        self.terms, self.word = np.unique(np.concatenate([np.empty(0, np.int64), *words]), return_inverse=True)
        begin = np.cumsum(size) - size
        per = np.array([len(x) for x in items["anchors"]], np.int64)
        self.item, self.begin, self.end = (np.repeat(x, per) for x in (items["item_id"].to_numpy(np.int64), begin, begin + size))
        self.anchor = self.begin + np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in items["anchors"]]])

    def match(self, shard: _Shard, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, run) for runs of at least length words."""
        number = shard.numbers(self.terms)[self.word]
        for k, at in shard.places(number[self.anchor]):
            doc, lo, hi = shard.bounds(at)
            run = np.ones(len(at), np.int64)
            for step in (-1, 1):  # the shifted lists of the words before, then after, as long as they hold the place
                alive, j = np.arange(len(at)), 0
                while len(alive):
                    j += step
                    word, place = self.anchor[k[alive]] + j, at[alive] + j
                    inside = (word >= self.begin[k[alive]]) & (word < self.end[k[alive]]) & (place >= lo[alive]) & (place < hi[alive])
                    alive, word, place = alive[inside], word[inside], place[inside]
                    alive = alive[shard.within(number[word], place, place)]
                    run[alive] += 1
            found = run >= length
            yield shard.docs[doc[found]], self.item[k[found]], run[found]


class _Windows:
    """Windows of items with their rarest terms, the rarest first, and these terms' offsets; short lists are filled with the first."""

    def __init__(self, windows: pd.DataFrame, rarest: int):
        wide = lambda c: np.array([[*x, *[x[0]] * (rarest - len(x))] for x in windows[c].map(list)], np.int64).reshape(-1, rarest)
        self.item, self.term, self.offset = windows["item_id"].to_numpy(np.int64), wide("terms"), wide("offsets")

    def match(self, shard: _Shard, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, places)."""
        number = shard.numbers(self.term.ravel()).reshape(self.term.shape)
        whole, pairs, counts = (number >= 0).all(1), [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
        for k, at in shard.places(np.where(whole, number[:, 0], -1)):
            doc, lo, hi = shard.bounds(at)
            for c in range(1, self.term.shape[1]):
                want = at + self.offset[k, c] - self.offset[k, 0]
                ok = shard.within(number[k, c], np.maximum(want - slop, lo), np.minimum(want + slop, hi - 1))
                k, at, doc, lo, hi = k[ok], at[ok], doc[ok], lo[ok], hi[ok]
            pair, n = np.unique(np.stack([doc, self.item[k]], 1), axis=0, return_counts=True)
            pairs.append(pair), counts.append(n)
        pair, at = np.unique(np.concatenate(pairs), axis=0, return_inverse=True)
        yield shard.docs[pair[:, 0]], pair[:, 1], np.bincount(at.ravel(), np.concatenate(counts), len(pair)).astype(np.int64)


def _scan(index: DataFrame, match, names: list[str]) -> DataFrame:
    """match(shard), which yields tuples of arrays of bigints, of every shard, where the shard is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard({c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("doc_ids", "starts", "terms", "ends", "positions")})
                for found in match(shard):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return index.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _blocks(queries: DataFrame, words: Column) -> list[DataFrame]:
    """The queries in parts of about BLOCK_WORDS words."""
    n = queries.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    k = -(-n // BLOCK_WORDS) or 1
    return [queries.where(F.pmod(F.xxhash64("query"), F.lit(k)) == i) for i in range(k)] if k > 1 else [queries]


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaks(docs: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str, length: int = 12, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, run): documents that share at least length consecutive words with an item, and the longest run.

    Items with fewer than length words cannot be found. Repeated items give a row each, repeated rows of a document one. Empty tables
    give no rows. index: an index of docs that is there already; it is built otherwise.
    """
    spark = docs.sparkSession
    index = build_index(docs, record, text) if index is None else index
    words = counted(item_terms(items, item, item_text).where(F.size("words") >= length), index)
    rows = words.groupBy("item_id", "query").agg(F.array_sort(F.collect_list(F.struct("at", "term", "n"))).alias("w")).select("item_id", "query", F.col("w.term").alias("terms"), F.col("w.n").alias("n"))

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(anchors=[_anchors(np.asarray(n), length) for n in b["n"]]).drop(columns="n")

    queries = materialize(rows.mapInPandas(anchor, "item_id bigint, query bigint, terms array<bigint>, anchors array<bigint>").where(F.size("anchors") > 0), "phrases")
    found = []
    for block in _blocks(queries, F.size("terms")):
        sent = spark.sparkContext.broadcast(_Phrases(block.toPandas()))  # about BLOCK_WORDS words
        found.append(_scan(index, lambda shard, sent=sent: sent.value.match(shard, length), ["doc_id", "item_id", "run"]))
    return _united(found).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def near_passages(
    docs: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str, rarest: int = 4, slop: int = 8, window: int = 24, index: DataFrame | None = None
) -> DataFrame:
    """(doc_id, item_id, places): proximity matches, whole or in part.

    An item is cut into windows of that many words (a last one of less than half joins the one before). Of a window the rarest distinct terms over
    the whole corpus are taken, or all if it has fewer; ties go to the smaller word; a window of which too few occur at all is nowhere. It
    is at a place of its rarest term if all the others stand within slop words of where they should, in the same document. places counts
    these, over all windows. A term that is repeated in a window counts at its first offset.
    """
    spark = docs.sparkSession
    index = build_index(docs, record, text) if index is None else index
    queries = item_terms(items, item, item_text)
    size = queries.select("query", F.size("words").alias("size"))
    words = counted(queries, index).join(size, "query")
    # windows of an item: the whole ones, and a rest of at least half a window
    many = F.greatest(F.floor((F.col("size") + window - (window + 1) // 2) / window), F.lit(1))
    words = words.withColumn("window", F.least(F.floor(F.col("at") / window), many - 1))
    each = words.groupBy("item_id", "query", "window", "word", "term", "n").agg(F.min("at").alias("at"))
    per = each.groupBy("item_id", "query", "window").agg(
        F.count(F.lit(1)).alias("distinct"), F.slice(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "word", "term", "at")))), 1, rarest).alias("a")
    )
    per = per.where((F.size("a") == F.least(F.col("distinct"), F.lit(rarest))) & (F.size("a") > 0))
    per = materialize(per.select("item_id", "query", F.col("a.term").alias("terms"), F.col("a.at").alias("offsets")), "windows")
    found = []
    for block in _blocks(per, F.size("terms")):
        sent = spark.sparkContext.broadcast(_Windows(block.toPandas(), rarest))  # about BLOCK_WORDS terms
        found.append(_scan(index, lambda shard, sent=sent: sent.value.match(shard, slop), ["doc_id", "item_id", "places"]))
    # repeated rows of a document count once: the most places of any
    return _united(found).groupBy("doc_id", "item_id").agg(F.max("places").alias("places"))
