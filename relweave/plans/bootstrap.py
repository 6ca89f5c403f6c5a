"""The bootstrap loop: seeds find tuples, tuples make patterns, patterns score tuples, sure tuples become seeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.config import Config
from relweave.functions.vectors import weighted_unit
from relweave.operators import clustering, extract, matching, scoring
from relweave.session import materialize
from relweave.sources.corpus import number_rows

OUTPUT = ["entity_1", "entity_2", "confidence", "sentence", "bef_words", "bet_words", "aft_words", "passive_voice"]


@dataclass
class Result:
    """relations (OUTPUT, best first), why the run ended, patterns, and a row of figures for each pass."""

    relations: DataFrame
    status: str
    patterns: DataFrame | None
    passes: list[dict]


def prepare(sentences: DataFrame, embeddings: DataFrame, dim: int, config: Config, tagger=extract.rule_tags) -> DataFrame:
    """The tuple store of tagged sentences (sent_id, sentence): tuples with x, in corpus order."""
    rows = extract.tuples(extract.relationships(sentences, config, tagger))
    rows = rows.withColumn("bef_tokens", F.transform("before", lambda t: t["tok"])).withColumn("aft_tokens", F.transform("after", lambda t: t["tok"]))
    rows = rows.withColumn("row_id", F.struct("sent_id", "pos"))
    rows = materialize(rows.drop("before", "between", "after"), "relationships")
    words = {"bef_vec": "bef_tokens", "bet_vec": "bet_filtered", "aft_vec": "aft_tokens"}
    rows = extract.context_vectors(rows, "row_id", words, embeddings, dim)
    weights = {n: w for n, w in zip(words, (config.alpha, config.beta, config.gamma)) if w}
    rows = rows.withColumn("x", weighted_unit(weights, dim)).drop(*words, "bef_tokens", "aft_tokens")
    return number_rows(rows, "row_id", "tuple_ord").drop("row_id")


def bootstrap(tuples: DataFrame, positive: DataFrame, negative: DataFrame, config: Config | None = None) -> Result:
    """Runs iterations + 1 passes over tuples (tuple_ord, tuple_key, ent1, ent2, x and the output's columns).

    Pattern counts add up over the passes; the first similarity of a tuple to a pattern stays; seeds found in a pass count from the
    next. A run without seed matches, or without patterns in the first pass, ends with no relations and says so.
    State is small (patterns, evidence, seeds) and written after each pass.
    """
    c = config or Config()
    spark = tuples.sparkSession
    slim = materialize(tuples.select("tuple_ord", "tuple_key", "ent1", "ent2", "x"), "tuples")
    seeds = materialize(positive.select("ent1", "ent2").distinct(), "seeds")
    negative = materialize(negative.select("ent1", "ent2").distinct(), "negative")
    members = counts = evidence = patterns = None
    confidence: DataFrame | None = None
    next_id, status, passes = 0, "done", []
    for turn in range(c.iterations + 1):
        matched = matching.seed_matches(slim, seeds)
        added = materialize(clustering.cluster_pass(matched, members, c.similarity, next_id), "members")
        n_matched = matched.count()
        if not n_matched:
            status = "no seed matches"
            break
        top = added.agg(F.max("pattern_id")).first()[0]
        next_id = max(next_id, (top if top is not None else -1) + 1)
        grown = added if members is None else members.unionByName(added)
        members = materialize(clustering.supported(grown, c.min_pattern_support), "members")
        n_patterns = members.select("pattern_id").distinct().count()
        if not n_patterns and turn == 0:
            status = "no patterns"
            break
        best, fresh = matching.best_and_counts(scoring.selectivity_classes(slim, seeds, negative), members, c.similarity)
        counts = fresh if counts is None else counts.unionByName(fresh)
        zero = members.select("pattern_id").distinct().select("pattern_id", *[F.lit(0).cast("bigint").alias(n) for n in ("positive", "negative", "unknown")])
        counts = materialize(counts.unionByName(zero).groupBy("pattern_id").agg(*[F.sum(n).alias(n) for n in ("positive", "negative", "unknown")]), "counts")
        best = best.join(slim.select("tuple_ord", "tuple_key"), "tuple_ord")
        more = scoring.new_evidence(best, evidence, c.similarity)
        evidence = materialize(more if evidence is None else evidence.unionByName(more), "evidence")
        sure = scoring.pattern_confidence(F.col("positive"), F.col("negative"), F.col("unknown"), c.negative_weight, c.unknown_weight)
        patterns = counts.withColumn("confidence", sure)
        confidence = materialize(scoring.tuple_confidence(evidence, patterns), "confidence")
        first = evidence.groupBy("tuple_key").agg(F.min("first_ord").alias("first_ord"))
        named = confidence.join(first, "tuple_key").join(slim.select(F.col("tuple_ord").alias("first_ord"), "ent1", "ent2"), "first_ord")
        seeds = materialize(scoring.with_seeds(seeds, scoring.promoted(named, c.confidence)), "seeds")
        passes.append({"iteration": turn, "matched": n_matched, "patterns": n_patterns, "candidates": confidence.count(), "seeds": seeds.count()})
    if not passes:
        out = tuples.limit(0).drop("confidence").select(F.col("ent1").alias("entity_1"), F.col("ent2").alias("entity_2"), F.lit(0.0).alias("confidence"), *OUTPUT[3:])
        return Result(out, status, None, passes)
    return Result(ranked_output(tuples, evidence, confidence), status, patterns, passes)


def ranked_output(tuples: DataFrame, evidence: DataFrame, confidence: DataFrame) -> DataFrame:
    """All candidates, best first; ties by first appearance. The first instance of a tuple key stands for it."""
    first = evidence.groupBy("tuple_key").agg(F.min("first_ord").alias("first_ord"))
    rows = tuples.drop("confidence").join(first.select(F.col("first_ord").alias("tuple_ord"), F.col("tuple_key").alias("__key")), "tuple_ord")
    rows = rows.join(confidence.select(F.col("tuple_key").alias("__key"), "confidence"), "__key")
    out = rows.select("tuple_ord", F.col("ent1").alias("entity_1"), F.col("ent2").alias("entity_2"), *OUTPUT[2:])
    return out.orderBy(F.col("confidence").desc(), "tuple_ord").drop("tuple_ord")
