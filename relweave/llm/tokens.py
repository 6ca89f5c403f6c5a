"""Token counts under a public tokenizer. Vocabulary files are read from a path, on the executors."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE with 50,256 tokens, where the session names no other file of this form in spark.relweave.vocabulary. All executors must
#: have the file there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts text before that vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary_of(df: DataFrame, given: str | None = None) -> str:
    """The rank file: the one given, else the session's, else VOCABULARY."""
    return given or df.sparkSession.conf.get("spark.relweave.vocabulary", VOCABULARY)


def count_tokens(df: DataFrame, record: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): one row for each row of df with an identifier; null and empty texts have 0 tokens."""
    path = vocabulary_of(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = df.select(F.col(record).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")
