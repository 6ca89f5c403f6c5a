"""From tagged sentences to pairs of entities with contexts. All in one row: no shuffle, no window over exploded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.config import Config
from relweave.functions import relphrase
from relweave.functions.stopwords import NOT_VALID
from relweave.functions.tagging import Tagger, pos_tags, rule_tags
from relweave.functions.text import let
from relweave.functions.tokenize import entity_parts, tokens

# How entities are tagged.
ENTITY = "<([A-Z]+)>([^<]+)</[A-Z]+>"
ENTITY_TAG = "</?[A-Z]+>"


def entities(sentence: Column) -> Column:
    """array of (surface, etype) in order; the closing tag need not agree with the opening one, which gives the type."""
    surface, kind = F.regexp_extract_all(sentence, F.lit(ENTITY), F.lit(2)), F.regexp_extract_all(sentence, F.lit(ENTITY), F.lit(1))
    return F.zip_with(surface, kind, lambda s, t: F.struct(s.alias("surface"), t.alias("etype")))


def untagged(sentence: Column) -> Column:
    """The sentence without entity tags."""
    return F.regexp_replace(sentence, ENTITY_TAG, "")


def has_entities(sentence: Column, least: int = 2) -> Column:
    """Whether at least so many entities are tagged."""
    return F.regexp_count(sentence, F.lit(ENTITY)) >= least


def find_locations(parts: Column, toks: Column) -> Column:
    """Every 1-based start at which the parts stand in the tokens, tagged there or not. Both should be columns or variables."""
    n, k = F.size(toks), F.size(parts)
    starts = F.when((k > 0) & (n >= k), F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    # the first part alone rules out most starts, before anything is cut out of the array
    return F.filter(starts, lambda i: (F.get(toks, i - 1) == F.get(parts, F.lit(0))) & (F.slice(toks, i, k) == parts))


def locations(ents: Column, toks: Column) -> Column:
    """array of (start, longest, nth, surface, etype), ascending; of entities that start at one place the longest, then the first tagged, stays.

    longest is the negative number of the entity's tokens.
    """

    def of(e: Column) -> Column:
        one = lambda i: F.struct(i.alias("start"), (-F.size(e["parts"])).alias("longest"), e["nth"].alias("nth"), e["surface"].alias("surface"), e["etype"].alias("etype"))
        return F.transform(find_locations(e["parts"], toks), one)

    read = F.transform(
        F.array_distinct(ents), lambda e, nth: F.struct(nth.alias("nth"), e["surface"].alias("surface"), e["etype"].alias("etype"), entity_parts(e["surface"]).alias("parts"))
    )
    return let(F.sort_array(F.flatten(F.transform(read, of))), lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["start"] != x["start"])))


def _pairs(locs: Column, c: Config, typed: bool) -> Column:
    """Consecutive starts (pos, x, y) at an allowed distance, of the wanted types, of different surfaces."""
    n = F.size(locs)
    every = F.zip_with(F.slice(locs, 1, F.greatest(n - 1, F.lit(0))), F.slice(locs, 2, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    every = F.transform(every, lambda p, i: F.struct(i.alias("pos"), p["x"].alias("x"), p["y"].alias("y")))
    return F.filter(
        every,
        lambda p: (p["y"]["start"] - p["x"]["start"]).between(c.min_tokens_away, c.max_tokens_away)
        & (p["x"]["surface"] != p["y"]["surface"])
        & ((p["x"]["etype"] == c.e1_type) & (p["y"]["etype"] == c.e2_type) if typed else F.lit(True)),
    )


def locate(df: DataFrame, sentence: str = "sentence", config: Config | None = None, typed: bool = True) -> DataFrame:
    """df with toks, locs and pairs, for sentences with at least two tagged entities. Null sentences are left out.

    Distances are from start to start. pos counts the consecutive starts of the sentence from 0. All three are made in one
    expression, behind an explode, so that nothing is computed twice.
    """
    c, s = config or Config(), F.col(sentence)
    whole = let(
        F.struct(tokens(untagged(s)).alias("toks"), entities(s).alias("ents")),
        lambda z: let(locations(z["ents"], z["toks"]), lambda l: F.struct(z["toks"].alias("toks"), l.alias("locs"), _pairs(l, c, typed).alias("pairs"))),
    )
    rows = df.where(has_entities(s)).withColumn("__s", F.explode(F.array(whole)))
    return rows.select(*df.columns, "__s.toks", "__s.locs", "__s.pairs")


def neighbours(df: DataFrame, config: Config | None = None, typed: bool = True, sentence: str = "sentence") -> DataFrame:
    """locate(), only sentences with a pair."""
    return locate(df, sentence, config, typed).where(F.size("pairs") > 0)


def valid_between(between: Column) -> Column:
    """Whether any token can be part of a relation; false for none."""
    return F.exists(between, lambda t: ~t.isin(NOT_VALID))


def _end(e: Column) -> Column:
    return e["start"] - e["longest"]


def contexts(df: DataFrame, config: Config | None = None) -> DataFrame:
    """One row for each pair whose tokens between say something: pos, ent1, ent2, e1_type, e2_type, distance, before, between, after.

    before and after hold up to context_window_size tokens; a window of 0 is empty. Contexts are arrays of tokens, or of
    (tok, tag) if df has a column tags.
    """
    w = (config or Config()).context_window_size
    tagged = "tags" in df.columns
    d = df.withColumn("p", F.explode("pairs"))
    x, y, toks = F.col("p.x"), F.col("p.y"), F.col("toks")
    n = F.size(toks)
    between = F.slice(toks, _end(x), F.greatest(y["start"] - _end(x), F.lit(0)))
    d = d.where(valid_between(between))
    seq = F.zip_with("toks", "tags", lambda a, b: F.struct(a.alias("tok"), b.alias("tag"))) if tagged else toks
    cut = lambda start, length: F.slice(seq, start, F.greatest(length, F.lit(0)))
    first = F.greatest(x["start"] - w, F.lit(1))
    keep = [F.col(c) for c in df.columns if c not in ("toks", "locs", "pairs", "tags")]
    return d.select(
        *keep, F.col("p.pos").alias("pos"), x["surface"].alias("ent1"), y["surface"].alias("ent2"), x["etype"].alias("e1_type"), y["etype"].alias("e2_type"),
        (y["start"] - x["start"]).alias("distance"), cut(first, x["start"] - first).alias("before"), cut(_end(x), y["start"] - _end(x)).alias("between"),
        cut(F.least(_end(y), n + 1), F.least(F.lit(w), n + 1 - _end(y))).alias("after"),
    )


def relationships(sentences: DataFrame, config: Config | None = None, tagger: Tagger | None = rule_tags, typed: bool = True) -> DataFrame:
    """Pairs with contexts of tagged sentences. Only sentences with a pair are given to the tagger, each once."""
    c = config or Config()
    s = F.col("sentence")
    rows = sentences.where(s.contains(f"<{c.e1_type}>") & s.contains(f"<{c.e2_type}>")) if typed else sentences
    rows = neighbours(rows, c, typed)
    if tagger is not None:
        rows = rows.withColumn("tags", pos_tags(F.col("toks"), tagger))
    return contexts(rows, c)


def joined(tagged: Column) -> Column:
    """Tokens of a tagged context joined by blanks."""
    return F.array_join(F.transform(tagged, lambda t: t["tok"]), " ")


def tuples(rels: DataFrame) -> DataFrame:
    """Relationships with what the matcher needs: context strings, content words, passive voice, and the key of equal tuples."""
    # the phrase is found once, and both of what is told from it are made behind an explode, so that nothing is computed twice
    both = lambda p: F.struct(((F.size(p) > 0) & relphrase.passive_voice(p)).alias("passive_voice"), relphrase.content_of(p, F.col("between")).alias("bet_filtered"))
    told = rels.withColumn("__told", F.explode(F.array(let(relphrase.relational_phrase(F.col("between")), both))))
    rows = told.select(*rels.columns, "__told.passive_voice", "__told.bet_filtered")
    rows = rows.withColumn("bef_words", joined(F.col("before"))).withColumn("bet_words", joined(F.col("between"))).withColumn("aft_words", joined(F.col("after")))
    return rows.withColumn("tuple_key", tuple_key(*[F.col(c) for c in ("ent1", "ent2", "bef_words", "bet_words", "aft_words")]))


def tuple_key(*parts: Column) -> Column:
    """Identity of a tuple: a digest of its entities and contexts, each preceded by its length."""
    return F.sha2(F.concat(*[F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]), 256)


def context_vectors(rows: DataFrame, key: str, words: dict[str, str], embeddings: DataFrame, dim: int) -> DataFrame:
    """rows with a vector column for each (vector name: array of words column): the sum of the words' vectors, repeated words counting again.

    Words without a vector add nothing; no such word gives zeros. One join for all contexts; embeddings (word, vec) is broadcast
    only if Spark knows it to be small. Vector sums are partial before the shuffle.
    """
    spread = F.flatten(F.array(*[_labelled(F.col(c), i) for i, c in enumerate(words.values())]))
    flat = rows.select(F.col(key).alias("__k"), F.explode(spread).alias("e")).select("__k", "e.i", "e.word")
    hit = flat.join(embeddings.select("word", "vec"), "word")
    sums = hit.groupBy("__k", "i").agg(*[F.sum(F.get("vec", F.lit(d)).cast("double")).alias(f"d{d}") for d in range(dim)])
    vec = sums.select("__k", "i", F.array(*[f"d{d}" for d in range(dim)]).alias("v"))
    wide = vec.groupBy("__k").agg(*[F.first(F.when(F.col("i") == i, F.col("v")), ignorenulls=True).alias(n) for i, n in enumerate(words)])
    zero = F.array_repeat(F.lit(0.0), dim)
    out = rows.join(wide, rows[key] == wide["__k"], "left").drop("__k")
    for n in words:
        out = out.withColumn(n, F.coalesce(F.col(n), zero))
    return out


def _labelled(c: Column, i: int) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.struct(F.lit(i).alias("i"), w.alias("word")))


def tagged_text(df: DataFrame, text: str, tagger: Tagger = rule_tags) -> DataFrame:
    """df with tagged: the (tok, tag) of plain text."""
    d = df.withColumn("__toks", tokens(F.col(text)))
    d = d.withColumn("__tags", pos_tags(F.col("__toks"), tagger))
    return d.withColumn("tagged", F.zip_with("__toks", "__tags", lambda a, b: F.struct(a.alias("tok"), b.alias("tag")))).drop("__toks", "__tags")


def text_phrases(df: DataFrame, text: str, universal: bool = False, tagger: Tagger = rule_tags) -> DataFrame:
    """df with phrases of plain text: one array of (tok, tag) of all relational phrases, or, under universal tags, each phrase by itself."""
    d = tagged_text(df, text, tagger)
    return d.withColumn("phrases", relphrase.universal_phrases(F.col("tagged")) if universal else relphrase.relational_phrase(F.col("tagged"))).drop("tagged")
