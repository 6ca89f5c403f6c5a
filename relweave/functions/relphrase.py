"""Relational phrases and passive voice over arrays of (tok, tag), as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.stopwords import FILTER_TAGS, STOPWORDS
from relweave.functions.text import let

# Treebank tags of each class.
CLASS_TAGS = {
    "V": ["VB", "VBD", "VBD|VBN", "VBG", "VBG|NN", "VBN", "VBP", "VBP|TO", "VBZ", "VP"],
    "R": ["RB", "RBR", "RBS", "RB|RP", "RB|VBG", "WRB"],
    "T": ["POS", "PRT", "TO", "RP"],
    "N": ["NN", "NNP", "NNPS", "NNS", "NN|NNS", "NN|SYM", "NN|VBG", "NP"],
    "J": ["JJ", "JJR", "JJRJR", "JJS", "JJ|RB", "JJ|VBG"],
    "P": ["WP", "WP$", "PRP", "PRP$", "PRP|VBP"],
    "D": ["DT", "EX", "PDT", "WDT"],
    "I": ["IN", "IN|RP"],
}
TAG_CLASS = {tag: letter for letter, tags in CLASS_TAGS.items() for tag in tags}
# The published mapping of Treebank tags to twelve universal ones.
UNIVERSAL = {
    "!": ".", "#": ".", "$": ".", "''": ".", "(": ".", ")": ".", ",": ".", "-LRB-": ".", "-RRB-": ".", ".": ".", ":": ".", "?": ".", "``": ".",
    "CC": "CONJ", "CD": "NUM", "CD|RB": "X", "DT": "DET", "EX": "DET", "FW": "X", "IN": "ADP", "IN|RP": "ADP", "JJ": "ADJ", "JJR": "ADJ", "JJRJR": "ADJ",
    "JJS": "ADJ", "JJ|RB": "ADJ", "JJ|VBG": "ADJ", "LS": "X", "MD": "VERB", "NN": "NOUN", "NNP": "NOUN", "NNPS": "NOUN", "NNS": "NOUN", "NN|NNS": "NOUN",
    "NN|SYM": "NOUN", "NN|VBG": "NOUN", "NP": "NOUN", "PDT": "DET", "POS": "PRT", "PRP": "PRON", "PRP$": "PRON", "PRP|VBP": "PRON", "PRT": "PRT", "RB": "ADV",
    "RBR": "ADV", "RBS": "ADV", "RB|RP": "ADV", "RB|VBG": "ADV", "RN": "X", "RP": "PRT", "SYM": "X", "TO": "PRT", "UH": "X", "VB": "VERB", "VBD": "VERB",
    "VBD|VBN": "VERB", "VBG": "VERB", "VBG|NN": "VERB", "VBN": "VERB", "VBP": "VERB", "VBP|TO": "VERB", "VBZ": "VERB", "VP": "VERB", "WDT": "DET", "WH": "X",
    "WP": "PRON", "WP$": "PRON", "WRB": "ADV",
}
# Forms of "be".
BE = ["be", "am", "is", "are", "was", "were", "been", "being"]


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tag_class(tag: Column) -> Column:
    """Class letter of a Treebank tag: V R T N J P D I, or O."""
    return F.coalesce(F.try_element_at(_table(TAG_CLASS), tag), F.lit("O"))


def universal_tag(tag: Column) -> Column:
    """Universal tag of a Treebank tag; X for others."""
    return F.coalesce(F.try_element_at(_table(UNIVERSAL), tag), F.lit("X"))


#: What a phrase goes on with in each state: the class letters, and the state that each leads to.
PTB_MOVES = {1: {"VRT": 1, "NJPD": 2, "I": 3}, 2: {"NJRPD": 2, "IT": 3}, 3: {"IT": 3}}
UNIVERSAL_CLASS = {"VERB": "V", "PRT": "T", "ADV": "R", "NOUN": "N", "ADJ": "J", "PRON": "P", "DET": "D", "ADP": "I"}


def phrase_groups(classes: Column) -> Column:
    """For each class letter the number of the phrase that holds it, from 1, or 0.

    A phrase is V (V|R|T)* (N|J|R|P|D)* (I|T)*. The token that ends a phrase is swallowed: no phrase starts there.
    """
    none = F.array().cast("array<int>")

    def step(acc: Column, c: Column) -> Column:
        st = F.when((acc["st"] == 0) & (c == "V"), 1)
        for state, moves in PTB_MOVES.items():
            for letters, to in moves.items():
                st = st.when((acc["st"] == state) & c.isin(*letters), to)
        st = st.otherwise(0)
        begun = F.when((acc["st"] == 0) & (c == "V"), acc["n"] + 1).otherwise(acc["n"])
        return F.struct(st.alias("st"), begun.alias("n"), F.concat(acc["out"], F.array(F.when(st > 0, begun).otherwise(0))).alias("out"))

    start = F.struct(F.lit(0).alias("st"), F.lit(0).alias("n"), none.alias("out"))
    return F.aggregate(classes, start, step, lambda acc: acc["out"])


def relational_phrase(tagged: Column) -> Column:
    """The tagged tokens of all phrases, one after the other; none if there is no verb."""
    groups = phrase_groups(F.transform(tagged, lambda t: tag_class(t["tag"])))
    return let(groups, lambda g: F.filter(tagged, lambda t, i: F.get(g, i) > 0))


def universal_phrases(tagged: Column) -> Column:
    """array of phrases (phrase, tokens) under universal tags, each by itself; words are parted and followed by a blank."""
    classes = F.transform(tagged, lambda t: F.coalesce(F.try_element_at(_table(UNIVERSAL_CLASS), universal_tag(t["tag"])), F.lit("O")))

    def phrases(s: Column) -> Column:
        groups, toks = s["g"], s["t"]
        n = F.coalesce(F.array_max(groups), F.lit(0))

        def one(k: Column) -> Column:
            held = F.filter(toks, lambda t, i: F.get(groups, i) == k)
            words = F.concat(F.array_join(F.transform(held, lambda t: t["tok"]), " "), F.lit(" "))
            return F.struct(words.alias("phrase"), F.transform(held, lambda t: F.struct(t["tok"].alias("tok"), universal_tag(t["tag"]).alias("tag"))).alias("tokens"))

        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), one)

    return let(F.struct(phrase_groups(classes).alias("g"), tagged.alias("t")), phrases)


def passive_voice(phrase: Column) -> Column:
    """Whether a phrase ends in "by" after a past form, or begins with a form of be and a past form and ends in "by".

    A phrase of three or more must begin with a verb. Never null.
    """
    n = F.size(phrase)
    past = lambda i: F.get(phrase, i)["tag"].isin("VBN", "VBD")
    by = F.get(phrase, n - 1)["tok"] == "by"
    first = F.get(phrase, F.lit(0))
    long = (n >= 3) & first["tag"].startswith("V") & (past(n - 2) | (first["tok"].isin(BE) & past(F.lit(1))))
    return F.coalesce(by & (long | ((n == 2) & past(n - 2))), F.lit(False))


def content_words(tagged: Column) -> Column:
    """Tokens of the relational phrase, or of all if there is none, without stop words, adjectives and adverbs."""
    return let(relational_phrase(tagged), lambda phrase: content_of(phrase, tagged))


def content_of(phrase: Column, tagged: Column) -> Column:
    """content_words where the phrase is known."""
    chosen = F.when(F.size(phrase) > 0, phrase).otherwise(tagged)
    kept = F.filter(chosen, lambda t: ~F.lower(t["tok"]).isin(STOPWORDS) & ~F.coalesce(t["tag"].isin(FILTER_TAGS), F.lit(False)))
    return F.transform(kept, lambda t: t["tok"])
