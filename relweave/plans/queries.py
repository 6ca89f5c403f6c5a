"""The core's queries over the tables of a data folder, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relweave.plans import file_queries, relation_queries  # noqa: F401  (file_queries registers its queries)
from relweave.plans.tables import table
from relweave.sources import lines


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.classify_lines(table(spark, d, "relationships_raw"), "line", table(spark, d, "relation_types"))
    return rows.where("reason is not null").select("line_id", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = lines.load_triples(table(spark, d, "relationships_raw"), "line", table(spark, d, "relation_types"))
    return valid.select("line_id", "e1", "r", "e2")


_G = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_U, _Q = r"[^\"\t]*", r"[ \x{0b}\x{0c}\r\p{Z}\x{85}\x{1c}-\x{1f}]*\"(?:[^\"]|\"\")*\"[ \x{0b}\x{0c}\r\p{Z}\x{85}\x{1c}-\x{1f}]*"
_F = f"(?:{_U}|{_Q})"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_G}+|{_G}+$', '', 'g')"


def _value(c: str) -> str:
    bare = _trim(c)
    inside = _trim(f"replace(substr({bare}, 2, length({bare}) - 2), '\"\"', '\"')")
    return f"case when starts_with({bare}, '\"') then {inside} else {bare} end"


_LINES = f"""
with l as (select line_id, line from relationships_raw where line is not null and regexp_matches(line, '[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]') and not starts_with(line, '#')),
q as (select *, regexp_full_match(line, '(?s){_F}(?:\\t{_F})*') as quoted, regexp_full_match(line, '(?s){_F}\\t{_F}\\t{_F}') as three,
  regexp_extract(line, '(?s)^({_F})\\t({_F})\\t({_F})$', ['a', 'b', 'c']) as f from l),
v as (select line_id, quoted, three, {_value("f.a")} as e1, {_value("f.b")} as r, {_value("f.c")} as e2 from q),
done as (select *, case when not quoted then 'quoting' when not three then 'column_count'
  when r not in (select r from relation_types where r is not null) or not regexp_matches(e1, '\\p{{L}}') or not regexp_matches(e2, '\\p{{L}}')
    or regexp_matches(e1, '^(/|m/)') or regexp_matches(e2, '^(/|m/)')
    or regexp_matches(e1 || e2, '[\\x{{00}}-\\x{{08}}\\x{{0a}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\x{{fffd}}]') then 'invalid_value' end as reason from v)
"""

ORACLE: dict[str, str] = {
    **relation_queries.ORACLE,
    "p2_found": _LINES + "select line_id, reason from done where reason is not null",
    "p2_valid": _LINES + "select line_id, e1, r, e2 from done where reason is null",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relation_queries.QUERIES, **{f.__name__: f for f in (p2_found, p2_valid)}}
