"""Word tokens by the published Penn Treebank rules, as a chain of native replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.text import let

# The published tokenisation rules (pattern, replacement), in order.
RULES = [
    (r'^"', "`` "),
    (r"(``)", " $1 "),
    (r'([ (\[{<])("|\'\')', "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"(\S)('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(gim|lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon|wan)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i) ('t)(is|was)\b", " $1 $2 "),
]


def tokens(text: Column) -> Column:
    """Treebank tokens; none for null and blank texts."""
    c = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), F.lit(" "))
    c = F.regexp_replace(c, r"^ +", "")
    for pattern, replacement in RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def tokens_sql(text: str) -> str:
    """The same as an SQL expression with RE2 patterns."""
    c = f"regexp_replace(' ' || regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g') || ' ', '^ +', '')"
    for pattern, replacement in RULES:
        p, r = pattern.replace("'", "''"), replacement.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3").replace("'", "''")
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def entity_parts(surface: Column) -> Column:
    """Tokens of an entity; a final full stop goes back to the token before it. A lone full stop stays."""

    def parts(t: Column) -> Column:
        n = F.size(t)
        joined = F.concat(F.slice(t, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(t, n - 2), F.lit("."))))
        return F.when((n >= 2) & (F.get(t, n - 1) == "."), joined).otherwise(t)

    return let(tokens(surface), parts)
