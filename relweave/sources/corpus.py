"""Sentences, seeds and embeddings."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.functions.text import strip
from relweave.session import materialize
from relweave.sources import files


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, sentence): lines of text files, also compressed ones, in the order of the files.

    sent_id grows with the order but has gaps, so that no task has to see all lines; number_rows makes it dense.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("sent_id"), strip(F.col("value")).alias("sentence"))
    return rows


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with name: 0, 1, ... in ascending order. Ranges are numbered apart and shifted by the counts of those before.

    The ranges are written first: their bounds come from a sample and must be the same wherever they are used.
    """
    part = materialize(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = part.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    return local.join(before.select("__p", "__before"), "__p").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__p", "__k", "__before")


def count_lines(df: DataFrame, text: str) -> DataFrame:
    """One row (lines): line feeds in a text column; null texts have none."""
    return df.agg(F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit("\n"))), F.lit(0)).cast("bigint").alias("lines"))


def parse_seeds(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(seeds, types): distinct pairs (ent1, ent2), and one row (e1_type, e2_type) of the header lines e1:TYPE and e2:TYPE.

    Blank lines and lines starting with # are left out; further fields are ignored, and so are lines with fewer than two.
    """
    v = strip(F.col(line))
    rows = lines.select(v.alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    head = F.regexp_extract("v", r"^e([12])\s*:\s*(\S.*)$", 1)
    rows = rows.withColumn("h", head).withColumn("t", strip(F.regexp_extract("v", r"^e([12])\s*:\s*(\S.*)$", 2)))
    types = rows.agg(F.max(F.when(F.col("h") == "1", F.col("t"))).alias("e1_type"), F.max(F.when(F.col("h") == "2", F.col("t"))).alias("e2_type"))
    parts = F.split("v", ";")
    seeds = rows.where((F.col("h") == "") & (F.size(parts) >= 2)).select(strip(F.get(parts, F.lit(0))).alias("ent1"), strip(F.get(parts, F.lit(1))).alias("ent2")).distinct()
    return seeds, types


def read_seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_seeds of a file."""
    return parse_seeds(spark.read.text(path))


def parse_word2vec(source, block: int = 1 << 20) -> Iterator[tuple[str, np.ndarray]]:
    """(word, vector) of a binary word2vec stream: a line "vocabulary dimensions", then word, blank, floats. A block is held at a time, not the file."""
    held, at = source.read(block), 0
    end = held.index(b"\n")
    n, dim = map(int, held[:end].split())
    at, need = end + 1, 4 * dim
    for _ in range(n):
        while True:
            while held[at : at + 1] == b"\n":
                at += 1
            blank = held.find(b" ", at)
            if blank >= 0 and len(held) >= blank + 1 + need:
                break
            more = source.read(max(block, need))
            if not more:
                raise ValueError("the file ends inside a vector")
            held, at = held[at:] + more, 0
        yield held[at:blank].decode("utf-8", "replace"), np.frombuffer(held, "<f4", dim, blank + 1)
        at = blank + 1 + need


def write_word2vec(path: str, vectors: dict[str, list[float]] | Iterable[tuple[str, list[float]]], size: int | None = None) -> None:
    """Writes the binary format, for fixtures and for other tools; size is the number of vectors if they are no dictionary."""
    rows = iter(vectors.items() if isinstance(vectors, dict) else vectors)
    first = next(rows, None)
    with files.created(path) as f:
        f.write(f"{len(vectors) if size is None else size} {len(first[1]) if first else 0}\n".encode())
        for w, v in chain([first] if first else [], rows):
            f.write(w.encode() + b" " + struct.pack(f"<{len(v)}f", *v) + b"\n")


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of binary word2vec files, one task a file, which is streamed; write it to Parquet once and read that afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                with files.opened(name) as f:
                    rows: list[tuple[str, np.ndarray]] = []
                    for row in parse_word2vec(f):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["word", "vec"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "word string, vec array<float>")


def write_tuples(df: DataFrame, path: str) -> None:
    """The tuple store."""
    df.write.mode("overwrite").parquet(path)


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """The tuple store; it is only read where it is asked for."""
    return spark.read.parquet(path)
