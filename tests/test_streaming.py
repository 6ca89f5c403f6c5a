"""A stream in several batches gives what the batch operators give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from relweave.operators import extract, matching
from relweave.streaming import extract as streaming

START = datetime(2024, 1, 1)


def arriving(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, s, START + timedelta(days=day)) for k, s, day in rows], "sent_id bigint, sentence string, ingested_at timestamp")
        df.coalesce(1).write.mode("append").parquet(folder)


def test_batches_repeats_and_late_rows(spark, tmp_path):
    say = lambda a, b: f"<ORG>{a}</ORG> is based in <LOC>{b}</LOC> ."
    folder = str(tmp_path / "in")
    batches = [[(1, say("A", "B"), 0), (2, say("C", "D"), 1), (1, say("A", "B"), 1)], [(2, say("C", "D"), 2), (3, say("E", "F"), 100), (None, say("N", "N"), 100)], [(4, say("G", "H"), 2), (5, None, 101), (6, "no entity", 101)]]
    arriving(spark, folder, batches)
    pairs = lambda w: sorted(r.ent1 for r in streaming.drain(streaming.relationships(streaming.sentence_stream(spark, folder, w), tagger=None)).collect())
    assert set(pairs(None)) == {"A", "C", "E", "G"} and len(pairs(None)) == 6  # all rows, also repeated ones
    got = pairs("30 days")
    assert len(got) == len(set(got)) and {"A", "C", "E"} <= set(got)
    batch = extract.relationships(spark.read.parquet(folder).where("sentence is not null and sent_id is not null").dropDuplicates(["sent_id"]), tagger=None)
    assert sorted(r.ent1 for r in batch.collect()) == ["A", "C", "E", "G"]


def test_frozen_patterns(spark, tmp_path):
    members = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "pattern_id bigint, tuple_key string, x array<double>")
    tuples = spark.createDataFrame([(i, [float(i % 3), float(i % 2)]) for i in range(12)], "tuple_ord bigint, x array<double>")
    for i in range(3):
        tuples.where(F.col("tuple_ord") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(tuples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = {(r.tuple_ord, r.pattern_id, r.score) for r in streaming.drain(streaming.matches(stream, members, 0.5)).collect()}
    best = matching.best_patterns(matching.match(tuples, members, 0.5).withColumn("accepted", F.lit(True)))
    assert got == {(r.tuple_ord, r.pattern_id, r.score) for r in best.collect()} and len(got) > 5
    none = spark.readStream.schema(tuples.schema).parquet(str(tmp_path / "t"))
    assert streaming.drain(streaming.matches(none, members.limit(0), 0.5)).count() == 0


def test_patterns_that_fit_no_block(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(matching, "SENT", 8)
    members = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "pattern_id bigint, tuple_key string, x array<double>")
    with pytest.raises(ValueError):
        matching.best_of_stream(members, members, 0.5)


def test_frozen_patterns_of_many_blocks(spark, tmp_path, monkeypatch):
    import numpy as np

    g = np.random.default_rng(5)
    size = [30, 5, 1, 8, 2]
    members = spark.createDataFrame([(p, f"k{p}{k}", g.normal(size=8).tolist()) for p, n in enumerate(size) for k in range(n)], "pattern_id bigint, tuple_key string, x array<double>")
    tuples = spark.createDataFrame([(i, g.normal(size=8).tolist()) for i in range(60)], "tuple_ord bigint, x array<double>")
    tuples.write.parquet(str(tmp_path / "t"))
    best = matching.best_patterns(matching.match(tuples, members, 0.1).withColumn("accepted", F.lit(True)))
    want = {(r.tuple_ord, r.pattern_id, round(r.score, 6)) for r in best.collect()}
    monkeypatch.setattr(matching, "SENT", 100)
    stream = spark.readStream.schema(tuples.schema).parquet(str(tmp_path / "t"))
    got = {(r.tuple_ord, r.pattern_id, round(r.score, 6)) for r in streaming.drain(streaming.matches(stream, members, 0.1)).collect()}
    assert got == want and len(got) > 40
