"""How good extracted facts are: keyword and proximity evidence in a corpus, the sets of the evaluation, and its figures.

S are the extracted facts, D the knowledge base, G what the corpus tells. b = S in D, a = right ones of S outside D, c = (G in D) less b,
d = (right ones of G outside D) less a.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.stopwords import NOT_VALID
from relweave.functions.text import bigrams

PAIR = ["ent1", "ent2"]


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def says_nothing(tokens: Column) -> Column:
    """All tokens are invalid between entities; true for none."""
    return F.forall(tokens, lambda t: t.isin(NOT_VALID))


def plausible(between: Column) -> Column:
    """Not all invalid, and no comma unless it comes first."""
    return ~says_nothing(between) & (~F.array_contains(between, ",") | (F.get(between, F.lit(0)) == ","))


def has_keyword(before: Column, between: Column, after: Column, unigrams: list[str], pairs: list[str]) -> Column:
    """A relation's unigram in any context, or one of its bigrams between the entities."""
    u = _list(unigrams)
    return F.arrays_overlap(before, u) | F.arrays_overlap(between, u) | F.arrays_overlap(after, u) | F.arrays_overlap(bigrams(between), _list(pairs))


def eligible_sentences(relations: DataFrame) -> DataFrame:
    """(sent_id, valid, invalid) of sentences with more valid than invalid relations (sent_id, between).

    A relation is invalid if a full stop stands between the entities, or nothing that says something.
    """
    bad = F.array_contains("between", ".") | says_nothing(F.col("between"))
    n = relations.groupBy("sent_id").agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))
    return n.where(F.col("valid") > F.col("invalid"))


def selected_sentences(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(sent_id, selected) of sentences with a relation: false if one of its relations has only a comma or a bracket between the entities, or an entity that
    is not in entities (entity)."""
    known = entities.select("entity").where("entity is not null").distinct().withColumn("__k", F.lit(True))
    rows = relations.join(known.select(F.col("entity").alias("ent1"), F.col("__k").alias("__k1")), "ent1", "left").join(known.select(F.col("entity").alias("ent2"), F.col("__k").alias("__k2")), "ent2", "left")
    mark = (F.size("between") == 1) & F.get("between", F.lit(0)).isin(",", "(", ")")
    bad = F.col("__k1").isNull() | F.col("__k2").isNull() | F.coalesce(mark, F.lit(False))
    return rows.groupBy("sent_id").agg((F.count_if(bad) == 0).alias("selected"))


def term_positions(sentences: DataFrame, text: str = "sentence", key: str = "sent_id") -> DataFrame:
    """(key, position, term): words and hyphenated words in lower or upper case as written; a tagged entity is one term."""
    pattern = r"(?U)(\w+(?:-\w+)+|<[A-Z]+>[^<]+</[A-Z]+>|\w+)"
    return sentences.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("position", "term"))


def entity_positions(sentences: DataFrame, text: str = "sentence", key: str = "sent_id") -> DataFrame:
    """term_positions of the tagged entities only: the same positions, but no row for any other word."""
    pattern = r"(?U)(\w+(?:-\w+)+|<[A-Z]+>[^<]+</[A-Z]+>|\w+)"
    every = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda t, i: F.struct(i.alias("position"), t.alias("term")))
    return sentences.where(F.col(text).contains("<")).select(key, F.inline(F.filter(every, lambda x: x["term"].startswith("<"))))


def entity_term(kind: Column | str, name: Column) -> Column:
    """The term that an entity of that type is in term_positions."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("<"), k, F.lit(">"), name, F.lit("</"), k, F.lit(">"))


def proximity_hits(positions: DataFrame, pairs: DataFrame, e1_type: str, e2_type: str, slop: int = 6, limit: int | None = None, key: str = "sent_id") -> DataFrame:
    """(ent1, ent2, key): sentences in which the second entity's term follows the first's within slop terms.

    All are kept, unless a limit is given: then that many sentences a pair, those with the smallest keys, as a search that returns a top list. Positions are narrowed to the entities' terms before they are joined by sentence.
    """
    p = pairs.select(*PAIR).distinct()
    firsts = p.select("ent1", entity_term(e1_type, F.col("ent1")).alias("term")).distinct()
    seconds = p.select("ent2", entity_term(e2_type, F.col("ent2")).alias("term")).distinct()
    x = positions.join(firsts, "term").select(key, "ent1", F.col("position").alias("__p"))
    y = positions.join(seconds, "term").select(key, "ent2", F.col("position").alias("__q"))
    near = x.join(y, key).where((F.col("__q") - F.col("__p")).between(1, slop)).select(*PAIR, key).distinct().join(p, PAIR, "left_semi")
    if limit is None:
        return near
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(*PAIR).orderBy(key))).where(F.col("__r") <= limit).drop("__r")


def relational_by_words(between: Column, unigrams: list[str], pairs: list[str]) -> Column:
    """Whether a hit tells the relation by its words: a keyword among the tokens between, which must not all be invalid."""
    return ~says_nothing(between) & (F.arrays_overlap(between, _list(unigrams)) | F.arrays_overlap(bigrams(between), _list(pairs)))


def proximity_ratio(judged: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(ent1, ent2, with_words, without_words, ratio, accepted) of hits (ent1, ent2, relational).

    Accepted with hits of both sorts and a ratio of at least the threshold; a pair with only relational hits is not.
    """
    n = judged.groupBy(*PAIR).agg(F.count_if("relational").alias("with_words"), F.count_if(~F.col("relational")).alias("without_words"))
    n = n.withColumn("ratio", F.try_divide(F.col("with_words"), F.col("without_words")))
    return n.withColumn("accepted", (F.col("with_words") > 0) & F.coalesce(F.col("ratio") >= threshold, F.lit(False)))


def less_found(facts: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("ent1", "ent2", "sentence")) -> DataFrame:
    """Facts without those that were found, by entities and sentence."""
    return facts.join(found.select(*keys).distinct(), list(keys), "left_anti")


def metrics(a: DataFrame, b: DataFrame, s: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """One row (a, b, s, c, d, precision, recall, f1): distinct facts of a, b, S and distinct pairs of c, d. Figures without a base are 0."""
    n = lambda df, name, *cols: df.select(*cols).distinct().agg(F.count(F.lit(1)).alias(name))
    row = n(a, "a", *a.columns).crossJoin(n(b, "b", *b.columns)).crossJoin(n(s, "s", *s.columns)).crossJoin(n(c, "c", *PAIR)).crossJoin(n(d, "d", *PAIR))
    right = F.col("a") + F.col("b")
    row = row.withColumn("precision", F.coalesce(F.try_divide(right, F.col("s")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(right, right + F.col("c") + F.col("d")), F.lit(0.0)))
    return row.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def truth(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """(ent1, ent2): distinct pairs of all that is right, extracted or not."""
    out = a.select(*PAIR)
    for x in (b, c, d):
        out = out.unionByName(x.select(*PAIR))
    return out.distinct()
