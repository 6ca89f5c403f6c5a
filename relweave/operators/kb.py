"""Cleaning knowledge-base facts, and matching extracted facts with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.fuzzy import jaro_winkler_similarity, token_jaccard
from relweave.functions.text import strip

# Organisations that appear as founders of countries and the like.
NOT_FOUNDED = ["UNESCO", "World Trade Organization", "European Union", "United Nations"]
# Relations of the four-column list that are kept.
WHITELIST = [
    "Governance of", "Leader of", "Organization founded", "Employment history", "Organization acquired", "Venture Investment", "Place founded",
    "location/mailing_address/citytown", "Neighborhood of", "Capital of", "Spouse (or domestic partner)", "Married To", "Sibling", "Peer",
]
#: Relations whose knowledge-base direction is the other way round.
FLIPPED = ["founder", "employer"]


@dataclass(frozen=True)
class RelationType:
    """Entity types and telling words of a relation."""

    e1_type: str
    e2_type: str
    unigrams: list[str] = field(default_factory=list)
    bigrams: list[str] = field(default_factory=list)


# The relations that can be evaluated, with their words.
RELATIONS = {
    "founder": RelationType("ORG", "PER", ["founder", "co-founder", "cofounder", "co-founded", "cofounded", "founded", "founders"], ["started by"]),
    "acquired": RelationType("ORG", "ORG", ["owns", "acquired", "bought", "acquisition"], ["owns", "acquired", "bought", "acquisition"]),
    "headquarters": RelationType(
        "ORG", "LOC",
        ["headquarters", "headquartered", "offices", "office", "building", "buildings", "factory", "plant", "compound"],
        ["based in", "located in", "main office", " main offices", "offices in", "building in", "office in", "branch in", "store in", "firm in", "factory in",
         "plant in", "head office", "head offices", "in central", "in downtown", "outskirts of", "suburs of"],
    ),
    "contained_by": RelationType("LOC", "LOC"),
    "employer": RelationType("ORG", "PER", ["chief", "scientist", "professor", "biologist", "ceo", "CEO", "employer"], []),
}


def relation_type(name: str) -> RelationType:
    """The relation of that name, or an error that names those there are."""
    if name not in RELATIONS:
        raise ValueError(f"unknown relation {name}; there are {', '.join(RELATIONS)}")
    return RELATIONS[name]


def without_brackets(c: Column) -> Column:
    """Without what stands from the first opening to the last closing bracket, and without outer white space."""
    return strip(F.regexp_replace(c, r"\(.*\)", ""))


def without_org_suffix(c: Column) -> Column:
    """Without " Corporation" and " Inc."."""
    return F.regexp_replace(c, r" Corporation| Inc\.", "")


def is_acronym(c: Column) -> Column:
    """A single word in upper case."""
    return ~c.contains(" ") & (c == F.upper(c)) & c.rlike("[A-Z]")


def local_name(c: Column) -> Column:
    """Without the resource and ontology prefixes and angle brackets; underscores become blanks."""
    return strip(F.replace(F.regexp_replace(c, r"http://dbpedia\.org/(resource|ontology)/|[<>]", ""), F.lit("_"), F.lit(" ")))


def clean_facts(df: DataFrame, e1: str = "e1", e2: str = "e2") -> DataFrame:
    """df without facts on identifier paths, numbered names or the listed organisations; names without bracketed notes.

    Null names are left out.
    """
    a, b = F.col(e1), F.col(e2)
    noise = lambda c: c.startswith("/") | c.startswith("m/") | c.rlike("#[0-9]+$")
    rows = df.where(a.isNotNull() & b.isNotNull() & ~noise(a) & ~noise(b) & ~strip(b).isin(NOT_FOUNDED))
    return rows.withColumns({e1: without_brackets(a), e2: without_brackets(b)})


def clean_listed_facts(df: DataFrame, e1: str = "e1", rel: str = "r", e2: str = "e2") -> DataFrame:
    """clean_facts of the four-column list: also without all-digit names and lists, and only of the kept relations."""
    a, b = F.col(e1), F.col(e2)
    junk = lambda c: c.startswith("/") | c.startswith("m/") | c.rlike("#[0-9]+$") | c.rlike("^[0-9]+$") | c.startswith("DVD Region") | c.startswith("Area code")
    rows = df.where(F.col(rel).isin(WHITELIST) & a.isNotNull() & b.isNotNull() & ~junk(a) & ~junk(b) & ~a.startswith("US Census"))
    return rows.withColumns({e1: without_brackets(a), e2: without_brackets(b)})


def directed(df: DataFrame, relation: str, e1: str = "e1", e2: str = "e2") -> DataFrame:
    """(e1, e2) in the direction of the extracted facts."""
    flip = relation in FLIPPED
    return df.withColumns({e1: F.col(e2 if flip else e1), e2: F.col(e1 if flip else e2)})


# Words between two names that say which is the parent.
_PARENT, _SUBSIDIARY, _ALONE = "'s parent", "subsidiary of", "subsidiary"


def swap_arguments(df: DataFrame, relation: str, ent1: str = "ent1", ent2: str = "ent2") -> DataFrame:
    """Entities changed over where the sentence says the relation the other way: in the passive voice (acquired, headquarters), or for
    acquired where the words between speak of a parent or a subsidiary. Both together still change them once."""
    bet = F.coalesce(F.col("bet_words"), F.lit(""))
    turn = F.lit(False)
    if relation in ("acquired", "headquarters"):
        turn = F.coalesce(F.col("passive_voice"), F.lit(False))
    if relation == "acquired":
        turn = turn | bet.contains(_PARENT) | bet.contains(_SUBSIDIARY) | (bet == _ALONE)
    return df.withColumns({ent1: F.when(turn, F.col(ent2)).otherwise(F.col(ent1)), ent2: F.when(turn, F.col(ent1)).otherwise(F.col(ent2))})


def acronym_map(df: DataFrame) -> DataFrame:
    """(acronym, expansions): sorted distinct expansions; rows with a slash in either, or a null, are left out."""
    a, b = strip(F.col("acronym")), strip(F.col("expansion"))
    rows = df.select(a.alias("acronym"), b.alias("expansion")).where(~F.col("acronym").contains("/") & ~F.col("expansion").contains("/"))
    return rows.groupBy("acronym").agg(F.sort_array(F.collect_set("expansion")).alias("expansions"))


def exact_matches(pairs: DataFrame, kb: DataFrame) -> DataFrame:
    """Pairs (ent1, ent2) that are facts, exactly."""
    return pairs.join(kb.select(F.col("e1").alias("ent1"), F.col("e2").alias("ent2")).distinct(), ["ent1", "ent2"], "left_semi")


def fuzzy_matches(pairs: DataFrame, kb: DataFrame, side: str, org: bool, jaccard: float = 0.5, winkler: float = 0.9) -> DataFrame:
    """(ent1, ent2, e1, e2, jaccard, winkler): pairs and facts that agree exactly on one argument and nearly on the other.

    side is the argument that is compared: arg1 or arg2. Near is a token Jaccard of at least jaccard, or a Jaro-Winkler similarity of
    the upper-case strings of at least winkler. With org, the fact's argument is first freed from its legal suffix. Pairs are made
    distinct before the join, whose key is the exact argument; adaptive execution splits a hot one. The cheap test comes
    first, and only pairs that it leaves open are given to Python.
    """
    p, k = pairs.select("ent1", "ent2").distinct(), kb.select("e1", "e2").where("e1 is not null and e2 is not null").distinct()
    if side == "arg1":
        both, mine, theirs = p.join(k, p["ent2"] == k["e2"]), F.col("ent1"), F.col("e1")
    else:
        both, mine, theirs = p.join(k, p["ent1"] == k["e1"]), F.col("ent2"), F.col("e2")
    both = both.withColumn("__t", without_org_suffix(theirs) if org else theirs).withColumn("jaccard", token_jaccard(mine, F.col("__t")))
    sure = both.where(F.col("jaccard") >= jaccard).withColumn("winkler", F.lit(None).cast("double"))
    # by the formula a similarity of winkler needs lengths that are not too far apart; the bound is loose and exact
    reach = F.least(F.length(mine), F.length("__t")) / F.greatest(F.length(mine), F.length("__t"), F.lit(1))
    bound = (2 + reach) / 3
    least = bound + F.lit(0.4) * (1 - bound)
    open_ = both.where((F.col("jaccard") < jaccard) & (least >= winkler))
    close = open_.withColumn("winkler", jaro_winkler_similarity(F.upper(mine), F.upper("__t"))).where(F.col("winkler") >= winkler)
    return sure.unionByName(close).select("ent1", "ent2", "e1", "e2", "jaccard", "winkler")


def known_pairs(pairs: DataFrame, kb: DataFrame, org: bool = True) -> DataFrame:
    """Distinct pairs that match a fact exactly or nearly on either argument."""
    one = exact_matches(pairs.select("ent1", "ent2").distinct(), kb)
    return one.unionByName(fuzzy_matches(pairs, kb, "arg1", org).select("ent1", "ent2")).unionByName(fuzzy_matches(pairs, kb, "arg2", org).select("ent1", "ent2")).distinct()


def unknown_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that match no fact."""
    return pairs.join(known.select("ent1", "ent2"), ["ent1", "ent2"], "left_anti")


def known_entities(kb: DataFrame) -> DataFrame:
    """(entity): distinct names of facts."""
    return kb.select(F.explode(F.array("e1", "e2")).alias("entity")).where("entity is not null").distinct()
