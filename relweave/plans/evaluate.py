"""The whole evaluation of extracted facts against a knowledge base and a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions.tokenize import tokens
from relweave.operators import evaluation as E
from relweave.operators import kb as K
from relweave.session import cached, materialize


@dataclass
class Evaluation:
    """The sets (see operators.evaluation) and the figures."""

    a: DataFrame
    b: DataFrame
    wrong: DataFrame
    c: DataFrame
    d: DataFrame
    metrics: DataFrame


def evaluate(
    facts: DataFrame, kb: DataFrame, corpus: DataFrame, sentences: DataFrame, relation: str, slop: int = 6, ratio: float = 0.7, limit: int | None = None, cache: str | None = None
) -> Evaluation:
    """facts (ent1, ent2, sentence, bet_words), kb (e1, e2) in the facts' direction, corpus relations (sent_id, ent1, ent2, e1_type, e2_type, sentence, before,
    between, after as tokens), and indexed sentences (sent_id, sentence).

    cache is a folder for what depends on the corpus and the knowledge base alone: a later run with other facts takes it over from there. It is the
    caller's to remove when one of the two changes.
    """
    spark = facts.sparkSession
    lasting = lambda make, name: cached(spark, f"{cache}/{relation}-{name}", make) if cache else materialize(make(), name)
    t = K.relation_type(relation)
    org = t.e1_type == "ORG"
    typed = lasting(lambda: corpus.where((F.col("e1_type") == t.e1_type) & (F.col("e2_type") == t.e2_type)), "corpus")
    s = materialize(facts.select("ent1", "ent2", "sentence", "bet_words").distinct(), "facts")
    positions = lasting(lambda: E.entity_positions(sentences), "positions")

    known = materialize(K.known_pairs(s, kb, org), "known")
    b = s.join(known, E.PAIR, "left_semi")
    rest = s.join(known, E.PAIR, "left_anti")

    def accepted(pairs: DataFrame, judge) -> DataFrame:
        hits = E.proximity_hits(positions, pairs, t.e1_type, t.e2_type, slop, limit)
        rows = typed.select("sent_id", *E.PAIR, "before", "between", "after").join(hits, ["sent_id", *E.PAIR], "left_semi")
        return E.proximity_ratio(judge(rows, pairs), ratio).where("accepted").select(*E.PAIR)

    def by_fact(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        said = pairs.select(*E.PAIR, tokens(F.col("bet_words")).alias("said")).groupBy(*E.PAIR).agg(F.collect_set("said").alias("said"))
        same = F.array_contains("said", F.col("between"))
        return rows.join(said, E.PAIR).withColumn("relational", same | E.has_keyword(F.col("before"), F.col("between"), F.col("after"), t.unigrams, t.bigrams))

    def by_words(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        return rows.withColumn("relational", E.relational_by_words(F.col("between"), t.unigrams, t.bigrams))

    a = materialize(rest.join(accepted(rest, by_fact), E.PAIR, "left_semi"), "a")
    wrong = rest.join(a.select(*E.PAIR).distinct(), E.PAIR, "left_anti")

    told = typed.where(E.plausible(F.col("between")))
    worded = lasting(lambda: told.where(E.has_keyword(F.col("before"), F.col("between"), F.col("after"), t.unigrams, t.bigrams)).select(*E.PAIR, "sentence").distinct(), "told")
    in_kb = lasting(lambda: K.known_pairs(worded, kb, org), "told_known")
    c = E.less_found(worded.join(in_kb, E.PAIR, "left_semi"), b)
    outside = worded.join(in_kb, E.PAIR, "left_anti")
    right = lasting(lambda: outside.join(accepted(outside, by_words), E.PAIR, "left_semi"), "told_right")
    d = E.less_found(right, a)
    return Evaluation(a, b, wrong, c, d, E.metrics(a, b, s, c, d))
