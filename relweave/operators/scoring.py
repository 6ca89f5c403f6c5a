"""Selectivity and confidence of patterns, confidence of tuples, and new seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.text import strip


def selectivity_classes(tuples: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """tuples with pos, neg, unk: what each of its accepting patterns gains.

    Names are compared without outer white space. A positive seed pair: pos 1. Else, the first name in a positive seed: neg 1. A
    negative seed pair that is not positive: neg 1 more. None of these: unk 1. It depends on the tuple alone, not on the pattern.
    """
    a, b = strip(F.col("ent1")).alias("__a"), strip(F.col("ent2")).alias("__b")
    pos = positive.select(a, b).distinct().withColumn("__pos", F.lit(True))
    first = positive.select(a).distinct().withColumn("__first", F.lit(True))
    neg = negative.select(a, b).distinct().withColumn("__neg", F.lit(True))
    rows = tuples.withColumn("__a", strip(F.col("ent1"))).withColumn("__b", strip(F.col("ent2")))
    rows = rows.join(pos, ["__a", "__b"], "left").join(first, "__a", "left").join(neg, ["__a", "__b"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_pos, kin, is_neg = yes("__pos"), ~yes("__pos") & yes("__first"), ~yes("__pos") & yes("__neg")
    num = lambda c: c.cast("bigint")
    return rows.withColumns({"pos": num(is_pos), "neg": num(kin) + num(is_neg), "unk": num(~is_pos & ~kin & ~is_neg)}).drop("__a", "__b", "__pos", "__first", "__neg")


def pattern_counts(accepted: DataFrame, classed: DataFrame, key: str = "tuple_ord") -> DataFrame:
    """(pattern_id, positive, negative, unknown) over the tuples that each pattern accepts, whatever their score."""
    rows = accepted.select(key, "pattern_id").join(classed.select(key, "pos", "neg", "unk"), key)
    return rows.groupBy("pattern_id").agg(F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.sum("unk").alias("unknown"))


def pattern_confidence(positive: Column, negative: Column, unknown: Column, negative_weight: float = 2.0, unknown_weight: float = 0.0) -> Column:
    """positive / (positive + unknown * weight + negative * weight); 0 without positives."""
    return F.when(positive > 0, positive / (positive + unknown * unknown_weight + negative * negative_weight)).otherwise(0.0)


def tuple_confidence(evidence: DataFrame, patterns: DataFrame) -> DataFrame:
    """(tuple_key, confidence): one less the product of one less pattern confidence times similarity."""
    rows = evidence.join(patterns.select("pattern_id", F.col("confidence").alias("__c")), "pattern_id")
    return rows.groupBy("tuple_key").agg((1 - F.product(1 - F.least(F.col("__c") * F.col("sim"), F.lit(1.0)))).alias("confidence"))


def new_evidence(best: DataFrame, known: DataFrame | None, threshold: float) -> DataFrame:
    """(tuple_key, pattern_id, sim, first_ord): for each tuple key and best pattern at the threshold the similarity met first; known ones stay."""
    rows = best.where(F.col("score") >= threshold)
    first = rows.groupBy("tuple_key", "pattern_id").agg(F.min_by("score", "tuple_ord").alias("sim"), F.min("tuple_ord").alias("first_ord"))
    return first if known is None else first.join(known.select("tuple_key", "pattern_id"), ["tuple_key", "pattern_id"], "left_anti")


def promoted(candidates: DataFrame, threshold: float) -> DataFrame:
    """(ent1, ent2) of the candidates with that confidence."""
    return candidates.where(F.col("confidence") >= threshold).select("ent1", "ent2").distinct()


def with_seeds(seeds: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct union."""
    return seeds.select("ent1", "ent2").unionByName(new.select("ent1", "ent2")).distinct()
