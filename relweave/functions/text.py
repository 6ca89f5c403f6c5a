"""Native column expressions over text: white space, words, tags, names, n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: Unicode's White_Space and the four ASCII separators that Python counts too.
SPACE = r"[\s\p{Z}\x{0085}\x{001c}-\x{001f}]"
TAG = r"</?[A-Za-z]+>"

# Ways of writing that a name is missing (compared in lower case, outer brackets removed).
NO_NAME = [
    "", "-", "--", "---", "?", "??", ".", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "undefined", "unk", "unknown",
    "missing", "not available", "not known", "no name", "tbd", "tba", "xxx",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once.

    An expression that is named inside a lambda is computed anew for each element, also when it was given a column of its own, as
    projections are merged. A lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space of any kind become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}++|{SPACE}++$", "")


def pieces(c: Column) -> Column:
    """The pieces between white space; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), lambda x: x != "")


def untag(c: Column, by: str = "") -> Column:
    """Without entity tags."""
    return F.regexp_replace(c, TAG, by)


def words(c: Column) -> Column:
    """Maximal runs of letters and digits in lower case, entity tags being spaces; none for null."""
    return F.filter(F.split(F.lower(untag(F.coalesce(c, F.lit("")), " ")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def holds_name(c: Column) -> Column:
    """Whether a value is a name: not null, blank or a placeholder. Never null."""
    bare = F.regexp_replace(F.lower(squeeze(c)), r"^[\[(<{ ]+|[\])>} ]+$", "")
    return F.coalesce(~bare.isin(NO_NAME) & bare.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a blank; empty for fewer than two."""
    return let(tokens, lambda t: F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b)))
