"""Relations from a stream of tagged sentences. The batch operators are row-local up to the pairs, so they run on a stream as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.config import Config
from relweave.functions.tagging import Tagger, rule_tags
from relweave.operators import extract, matching
from relweave.session import scratch_dir


def sentence_stream(spark: SparkSession, path: str, watermark: str | None = "30 days") -> DataFrame:
    """A stream of (sent_id, sentence, ingested_at) of relation files, each sentence once within the watermark.

    Rows that come later than the watermark behind the latest one seen are dropped, as the state that would tell repeats is gone by then. Without
    a watermark no row is dropped and repeats stay: whoever reads the table takes each (sent_id, pos) once.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema)
    # a table may be a folder of files or one file in a folder
    rows = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)
    rows = rows.where("sentence is not null and sent_id is not null").select("sent_id", "sentence", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    return rows if watermark is None else rows.withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["sent_id"])


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def relationships(stream: DataFrame, config: Config | None = None, tagger: Tagger | None = rule_tags, typed: bool = True) -> DataFrame:
    """Pairs with contexts, as in operators.extract.relationships."""
    return extract.relationships(stream, config, tagger, typed)


def matches(stream: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> DataFrame:
    """(key, pattern_id, score): of a stream of tuples (key, x) the best pattern of each that any accepts. The patterns are frozen.

    Row-local: the members go to the executors once, in blocks (operators.matching.SENT) that each batch of rows meets in turn.
    """
    return matching.best_of_rows(stream, members, threshold, key)


def drain(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder, and returns the table. A restart continues at its checkpoint."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/relweave-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
