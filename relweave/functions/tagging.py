"""Part-of-speech tags (Penn Treebank). The tagger is a parameter; the default one knows closed word classes and endings, and is a native
expression. functions.perceptron has one that is trained from tagged sentences."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.text import let

Tagger = Callable[[list[str]], list[str]]

# Closed word classes by tag.
CLOSED = {
    "DT": "the a an this that these those each every some any no another either neither all both",
    "IN": "of in by for with about against between into through during before after above below from up down on off over under at as since until while because although though if than per via without within among near like unlike toward towards upon across behind beyond",
    "TO": "to", "CC": "and but or nor yet plus", "MD": "can could may might must shall should will would",
    "PRP": "i you he she it we they me him us them himself herself itself themselves who whom",
    "PRP$": "my your his her its our their whose", "WDT": "which", "WP": "what", "WRB": "when where why how", "EX": "there",
    "VBZ": "is has does", "VBP": "are am have do", "VBD": "was were had did said", "VB": "be", "VBN": "been done", "VBG": "being having doing",
    "RB": "not n't also now then very too so just only never often always still again here", "POS": "'s '",
}
# Further verb forms by tag.
VERBS = {
    "VBD": "bought sold made took gave went came became began led held kept left lost met paid ran saw sent told won wrote built spoke grew found hit beat",
    "VBN": "based known written born gone given taken shown driven chosen broken sworn built held made led",
    "VBZ": "says plans wants wins plays owns runs leads makes employs hosts sells buys works lives",
}
_LEXICON = {w: t for table in (VERBS, CLOSED) for t, ws in table.items() for w in ws.split()}
_SUFFIX = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("est", "JJS")]
_NUMBER = re.compile(r"^[\d.,:/-]*\d[\d.,:/-]*$")


def rule_tags(words: list[str]) -> list[str]:
    """Tags of one sentence's tokens."""
    out: list[str] = []
    for i, w in enumerate(words):
        low, before = w.lower(), out[-1] if out else ""
        if not any(c.isalnum() for c in w) and low not in _LEXICON:
            tag = _MARKS.get(w, ":")
        elif low in _LEXICON:
            tag = _LEXICON[low]
        elif _NUMBER.match(w):
            tag = "CD"
        elif w[0].isupper() and i > 0:
            tag = "NNP"
        else:
            tag = next((t for s, t in _SUFFIX if low.endswith(s) and len(low) > len(s) + 2), "NNP" if w[0].isupper() else "NNS" if low.endswith("s") and not low.endswith("ss") else "NN")
        # a past form after a form of be or have is a participle, a base form follows to and modals
        if tag == "VBD" and (before in ("VBZ", "VBP", "VBD", "VB", "VBN", ",") and (not out or words[i - 1].lower() in ("is", "are", "was", "were", "be", "been", "being", "has", "have", "had", ","))):
            tag = "VBN"
        elif tag in ("NN", "NNS") and before in ("TO", "MD"):
            tag = "VB"
        out.append(tag)
    return out


#: A past form after one of these is a participle, a base form after one of those is a verb. Their own tags do not depend on the words before, so a
#: token's tag depends on the token before alone.
_HELPING = ["is", "are", "was", "were", "be", "been", "has", "have", "had", ","]
_LEADING = [w for w, t in _LEXICON.items() if t in ("TO", "MD")]
_MARKS = {",": ",", ".": ".", "?": ".", "!": ".", "``": "``", "''": "''", "(": "(", ")": ")"}
_BY_TAG = {t: [w for w, u in _LEXICON.items() if u == t] for t in dict.fromkeys(_LEXICON.values())}


def _native_tag(w: Column, i: Column, before: Column) -> Column:
    low = F.lower(w)
    tag = F.when(F.lit(False), "")
    for t, words in _BY_TAG.items():
        tag = tag.when(low.isin(words), t)
    no_word = ~w.rlike(r"[\p{L}\p{N}]")
    for mark, t in _MARKS.items():
        tag = tag.when(w == mark, t)
    tag = tag.when(no_word, ":").when(w.rlike(_NUMBER.pattern), "CD").when(w.rlike(r"^\p{Lu}") & (i > 0), "NNP")
    for ending, t in _SUFFIX:
        tag = tag.when(low.endswith(ending) & (F.length(low) > len(ending) + 2), t)
    tag = tag.when(w.rlike(r"^\p{Lu}"), "NNP").when(low.endswith("s") & ~low.endswith("ss"), "NNS").otherwise("NN")
    return let(tag, lambda t: F.when((t == "VBD") & F.coalesce(before.isin(_HELPING), F.lit(False)), "VBN").when(t.isin("NN", "NNS") & F.coalesce(before.isin(_LEADING), F.lit(False)), "VB").otherwise(t))


def native_rule_tags(tokens: Column) -> Column:
    """rule_tags as a native expression: no Python, no row leaves the JVM. Null for null."""
    return F.transform(tokens, lambda w, i: _native_tag(w, i, F.when(i > 0, F.lower(F.get(tokens, i - 1)))))


def rule_tags_sql(tokens: str) -> str:
    """rule_tags of a list of tokens in SQL."""
    texts = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
    low, before = "lower(x)", f"case when i > 1 then lower({tokens}[i - 1]) else '' end"
    whens = [f"when {low} in {texts(ws)} then '{t}'" for t, ws in _BY_TAG.items()]
    whens += [f"when x in {texts([m])} then {texts([t])[1:-1]}" for m, t in _MARKS.items()]
    whens += ["when not regexp_matches(x, '[\\p{L}\\p{N}]') then ':'", f"when regexp_matches(x, '{_NUMBER.pattern}') then 'CD'", "when regexp_matches(x, '^\\p{Lu}') and i > 1 then 'NNP'"]
    whens += [f"when {low} like '%{e}' and length({low}) > {len(e) + 2} then '{t}'" for e, t in _SUFFIX]
    tag = "case " + " ".join(whens) + f" when regexp_matches(x, '^\\p{{Lu}}') then 'NNP' when {low} like '%s' and {low} not like '%ss' then 'NNS' else 'NN' end"
    fixed = lambda t: f"case when {t} = 'VBD' and {before} in {texts(_HELPING)} then 'VBN' when {t} in ('NN', 'NNS') and {before} in {texts(_LEADING)} then 'VB' else {t} end"
    first = f"list_transform({tokens}, lambda x, i: {tag})"
    return f"list_transform({first}, lambda y, i: {fixed('y')})"


def pos_tags(tokens: Column, tagger: Tagger = rule_tags) -> Column:
    """array<string> of tags, one for each token. tagger maps a list of tokens to as many tags; the default one runs as a native expression, any other
    in Arrow batches, each distinct sentence of a batch once."""
    if tagger is rule_tags:
        return native_rule_tags(tokens)

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        seen: dict[tuple[str, ...], list[str]] = {}
        out = []
        for t in batch:
            if t is None:
                out.append(None)
                continue
            key = tuple(t)
            if key not in seen:
                seen[key] = list(tagger(list(key)))
            out.append(seen[key])
        return pd.Series(out, dtype=object)

    return run(tokens)
