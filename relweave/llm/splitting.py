"""Oversized texts cut at natural boundaries, by lexical cohesion.

Within the last part of each piece's size window every natural boundary (end of a paragraph, line or sentence) is scored by how unlike the
words before and after it are: the cosine of two sliding blocks falls into a valley where the topic changes. The deepest
valley is the cut, whatever the boundary's kind; of equally deep ones the end of a paragraph, then of a line, then of a sentence, then the last. Where the last
part has no natural boundary, the search goes back by parts almost to the start of the piece. The next piece begins about the overlap before, at the start of a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.tokens import count_tokens, encoding, vocabulary_of

#: Words of a block, hash buckets of its words, and the share of the limit from which a cut is looked for first.
BLOCK, BUCKETS, FROM = 80, 128, 0.7
#: Where the last part has no natural boundary, the parts from these shares on are searched, one after the other.
BEFORE = (0.4, 0.1)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PARAGRAPH = regex.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_LINE = regex.compile(r"[\r\n]+\s*")
_SENTENCE = regex.compile(r"[.!?…。！？][\"'”’)\]]*\s+")
_SPACE = regex.compile(r"\s+")
KINDS = ["paragraph", "line", "sentence", "word", "none"]


def _valleys(text: str, cuts: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each cut (character offsets, ascending)."""
    found = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    n = len(found)
    if not n:
        return np.zeros(len(cuts))
    bucket = np.fromiter((hash_word(w) for _, w in found), np.int64, n)
    g = np.searchsorted(np.fromiter((i for i, _ in found), np.int64, n), cuts)
    # a block's counts by bucket: of the words from g - BLOCK on, and from g on
    span = np.arange(BLOCK)
    left, right = (np.zeros((len(cuts), BUCKETS + 1), np.float32) for _ in range(2))
    for out, at in ((left, g[:, None] - 1 - span), (right, g[:, None] + span)):
        inside = (at >= 0) & (at < n)
        np.add.at(out, (np.arange(len(cuts))[:, None], np.where(inside, bucket[np.clip(at, 0, n - 1)], BUCKETS)), inside.astype(np.float32))
    left, right = left[:, :BUCKETS], right[:, :BUCKETS]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    sim = np.divide((left * right).sum(1), norm, out=np.zeros(len(cuts)), where=norm > 0)
    # depth: how far the similarity climbs to the nearest peak on either side
    sims, n = sim.tolist(), len(cuts)
    before, after = list(sims), list(sims)
    for i in range(1, n):
        if sims[i - 1] >= sims[i]:
            before[i] = before[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            after[i] = after[i + 1]
    return np.asarray(before) + np.asarray(after) - 2 * sim


@lru_cache(maxsize=100_000)
def hash_word(w: str) -> int:
    """Bucket of a word, the same in every process; short words, which any topic has, are in one that does not count."""
    return zlib.crc32(w.lower()[:12].encode()) % BUCKETS if len(w) > 3 else BUCKETS


def _natural(text: str, lo: int, hi: int) -> dict[int, int]:
    """Ends of paragraphs, lines and sentences in (lo, hi], each with the number of its first kind."""
    out: dict[int, int] = {}
    for k, pattern in enumerate((_PARAGRAPH, _LINE, _SENTENCE)):
        for m in pattern.finditer(text, lo, hi):
            if lo < m.end() <= hi:
                out.setdefault(m.end(), k)
    return out


def _boundary(text: str, bounds: list[int]) -> tuple[int, str]:
    """The cut and its kind: the natural boundary in the deepest valley of the first part (from the end) that has one, else the last space of the
    last part. bounds are the ends of the parts, ascending."""
    lo, hi = bounds[-2:]
    for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
        if found := _natural(text, a, b):
            cuts, margin = sorted(found), 12 * BLOCK
            depth = _valleys(text[max(0, a - margin) : b + margin], np.asarray(cuts) - max(0, a - margin))
            best = max(range(len(cuts)), key=lambda i: (round(float(depth[i]), 6), -found[cuts[i]], i))
            return cuts[best], KINDS[found[cuts[best]]]
    spaces = [m.start() for m in _SPACE.finditer(text, lo, hi) if lo < m.start() <= hi]
    return (spaces[-1], "word") if spaces else (hi, "none")


def _offsets(text: str, tokens: list[int], enc) -> np.ndarray:
    """The character at which each token begins (that it begins inside of), and the end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    size = np.fromiter(map(len, enc.decode_tokens_bytes(tokens)), np.int64, len(tokens))
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return np.append(char[np.cumsum(size) - size], len(text))


def split_text(text: str, limit: int, overlap: int, enc) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, boundary) of the pieces, in order; boundary is what the piece ends at ("end" for the last).

    A text within the limit is one piece. Every piece has at most limit tokens when it is encoded by itself; together they
    cover the text; consecutive ones share about overlap tokens, less only if that would leave no progress.
    """
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= limit:
        return [(0, len(text), len(tokens), "end")]
    offsets = _offsets(text, tokens, enc)
    out, start = [], 0
    while True:
        i = int(np.searchsorted(offsets, start))
        if i + limit >= len(tokens):
            n = len(enc.encode_ordinary(text[start:]))
            if n <= limit:
                out.append((start, len(text), n, "end"))
                return out
        hi = int(offsets[min(i + limit, len(tokens) - 1)])
        early = [int(offsets[min(i + int(limit * f), len(tokens) - 1)]) for f in reversed(BEFORE)]
        lo = int(offsets[min(i + int(limit * FROM), len(tokens) - 1)])
        while True:
            end, kind = _boundary(text, [*(min(max(x, start), max(lo, start)) for x in early), max(lo, start), max(hi, start + 1)])
            n = len(enc.encode_ordinary(text[start:end]))
            if n <= limit:
                break
            hi = min(hi - 1, int(offsets[max(int(np.searchsorted(offsets, hi)) - (n - limit) - 1, i + 1)]))
            lo = min(lo, hi - 1)
        out.append((start, end, n, kind))
        start = _resume(text, offsets, start, end, overlap)


def _resume(text: str, offsets: np.ndarray, start: int, end: int, overlap: int) -> int:
    """Where the next piece begins: overlap tokens before end, or the nearest start of a word by a quarter of that."""
    j = int(np.searchsorted(offsets, end))
    want = max(j - overlap, int(np.searchsorted(offsets, start)) + 1)
    if overlap <= 0 or want >= j:
        return end
    near = sorted(range(max(want - overlap // 4, 0), min(want + overlap // 4, j - 1) + 1), key=lambda k: abs(k - want))
    for k in near:
        p = int(offsets[k])
        if start < p < end and (text[p].isspace() or text[p - 1].isspace()):
            return p
    p = int(offsets[want])
    return p if start < p < end else end


def split_documents(df: DataFrame, record: str, text: str, limit: int = 4096, overlap: int = 64, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start_char, end_char, n_tokens, boundary, text) of every text over the limit.

    Offsets count characters. Texts within the limit, null and empty ones have no rows. A byte-level token has at least one
    byte, so texts of at most limit bytes are known to be within it and are not encoded. Every row is a document of its own.
    """

    path = vocabulary_of(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            rows = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                pieces = split_text(t, limit, overlap, enc)
                if len(pieces) > 1:
                    rows += [(doc, k, s, e, n, kind, t[s:e]) for k, (s, e, n, kind) in enumerate(pieces)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start_char", "end_char", "n_tokens", "boundary", "text"])

    long = df.select(F.col(record).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    long = long.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > limit))
    return long.mapInArrow(run, "doc_id bigint, piece int, start_char bigint, end_char bigint, n_tokens bigint, boundary string, text string")


def faults(pieces: DataFrame, df: DataFrame, record: str, text: str, limit: int = 4096, overlap: int = 64, vocabulary: str | None = None) -> DataFrame:
    """One row that counts what is wrong with split_documents(): all zeros if nothing is.

    too_long: pieces over the limit; gaps: pieces that begin after the one before ends, or not after its start, and documents not covered to their
    ends; wrong_text: pieces that are not what the document has there; overlapping: pieces whose text in common with the next has more than
    twice the overlap of tokens; unnatural: cuts at a space or inside a word, though the
    second half of the piece has a paragraph's end.
    """
    w = Window.partitionBy("doc_id").orderBy("piece")
    own = df.select(F.col(record).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("__whole"))
    p = pieces.withColumn("__next", F.lead("start_char").over(w)).withColumn("__last", F.lead("start_char").over(w).isNull()).join(own, "doc_id")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias
    ended = F.when(F.col("__last"), F.col("end_char") != F.length("__whole")).otherwise((F.col("__next") > F.col("end_char")) | (F.col("__next") <= F.col("start_char")))
    shared = p.where(~F.col("__last") & (F.col("end_char") > F.col("__next"))).select("doc_id", F.expr("substring(text, cast(__next - start_char + 1 as int))").alias("text"))
    shared = count_tokens(shared, "doc_id", "text", vocabulary).agg(n(F.col("n_tokens") > 2 * overlap)("overlapping"))
    return p.agg(
        n(F.col("n_tokens") > limit)("too_long"),
        n(ended | ((F.col("piece") == 0) & (F.col("start_char") != 0)))("gaps"),
        n(F.expr("substring(__whole, cast(start_char + 1 as int), cast(end_char - start_char as int))") != F.col("text"))("wrong_text"),
        n(F.col("boundary").isin("word", "none") & F.expr("substring(text, cast(length(text) / 2 as int))").rlike(r"[\p{L}.]\n[ \t]*\n\s*\p{L}"))("unnatural"),
    ).crossJoin(shared)
