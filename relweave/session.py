"""Sessions and the shared scratch folder."""

from __future__ import annotations

import functools
import sys
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import ParamSpec, TypeVar

from pyspark.sql import DataFrame, SparkSession

P, R = ParamSpec("P"), TypeVar("R")


def get_spark(app: str = "relweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the operators assume (UTC, adaptive execution with skew handling)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a temporary folder of this machine is taken and kept
    in the session's settings.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="relweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting by which a query's shuffle files are deleted as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What materialize() wrote in this process and nobody released.
_written: list[str] = []


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df once to the shared folder and reads it back.

    This cuts the lineage like checkpoint(), but computes df only once, keeps it columnar, and survives the loss of
    any executor. The table stays until release(), as a result that is not read yet may need it. What was shuffled for it is deleted at once.
    """
    spark, was = df.sparkSession, df.sparkSession.conf.get(CLEANUP, "false")
    path = f"{scratch_dir(df.sparkSession)}/relweave-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes all that materialize() wrote in this process, and says how many tables. Results that were not read or written by then are lost."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it is not there: for results that later runs take over. Whoever changes the input removes it."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path)
    df = make()
    df.write.mode("overwrite").parquet(path)  # what a broken run left there has no _SUCCESS
    return spark.read.schema(df.schema).parquet(path)


def timed(f: Callable[P, R]) -> Callable[P, R]:
    """f, telling on the error stream how long it took."""

    @functools.wraps(f)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            print(f"{f.__name__}: {time.perf_counter() - began:.3f} s", file=sys.stderr)

    return run
