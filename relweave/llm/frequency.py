"""Frequency of every term, in a vertical layout.

The collection is turned on its side: every term has a bitmap of the records that hold it, and beside it a counter of occurrences. A
bitmap is made of containers, one for each block of identifiers; a container keeps its 64-bit words that are not zero, so rare terms
cost one word and common ones one bit a record. Words are united with bit_or, containers of one block by the union of their words;
containers of different blocks have nothing in common, so a bitmap's cardinality, the document frequency, is the sum of its containers'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions import text as T
from relweave.session import materialize

#: Records of one block of 2**CHUNK_BITS identifiers are in one partition when the containers are built.
CHUNK_BITS = 12


def term_bitmaps(df: DataFrame, record: str, text: str) -> DataFrame:
    """The bitmaps, a row for each container: (term, loose, chunk, words array of (word, bits), records, occurrences).

    record is an integer identifier. Rows with the same identifier are one record delivered again and count once, with
    the greatest non-null text; rows without an identifier are records of their own, numbered by themselves (loose). Null and blank texts have no
    terms. The null term stands for any term: its bitmap holds the records that have one. A container has at most 2**CHUNK_BITS / 64
    words; records are its set bits: word * 64 + the number of the bit. Only the two columns are read, so others may have any name. One shuffle
    brings each record's copies together (combined before), one brings blocks of records together; building and uniting needs none.
    """
    own = F.coalesce(F.col(record).cast("bigint"), F.monotonically_increasing_id())
    rows = df.select(F.col(record).isNull().alias("loose"), own.alias("__id"), F.col(text).cast("string").alias("__text"))
    records = rows.groupBy("loose", "__id").agg(F.max("__text").alias("__text")).where(F.col("__text").isNotNull())
    terms = T.let(T.pieces(F.lower("__text")), lambda p: F.when(F.size(p) > 0, F.concat(p, F.array(F.lit(None).cast("string")))))
    return (
        records.withColumn("chunk", F.shiftright("__id", CHUNK_BITS))
        .repartition("loose", "chunk")
        .select("loose", "chunk", F.shiftright("__id", 6).alias("word"), F.pmod("__id", F.lit(64)).cast("int").alias("__bit"), F.explode(terms).alias("term"))
        .groupBy("loose", "chunk", "word", "term")
        .agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("bits"), F.count(F.lit(1)).alias("__n"))
        .groupBy("term", "loose", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum("__n").alias("occurrences"))
        .withColumn("records", F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"])))
    )


def term_frequencies(df: DataFrame, record: str, text: str, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """(term, occurrences, records, share, mark) of every distinct term.

    mark is rare (fewer than min_records records), common (more than max_share of the records with any term) or
    useful. An empty table gives no rows. For the rest see term_bitmaps.
    """
    counts = term_bitmaps(df, record, text).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    counts = materialize(counts, "terms")
    total = counts.where("term is null").select(F.col("records").alias("__n"))
    mark = (
        F.when(F.col("records") < min_records, "rare")
        .when(F.col("records") > max_share * F.col("__n"), "common")
        .otherwise("useful")
    )
    # total is one row at most, whatever the data
    terms = counts.where("term is not null").crossJoin(F.broadcast(total))
    return terms.select("term", "occurrences", "records", (F.col("records") / F.col("__n")).alias("share"), mark.alias("mark"))
