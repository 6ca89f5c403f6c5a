"""The bootstrap in SQL, to hold the operators against: the single pass is a recursion over the tuples in their order."""

from __future__ import annotations

from relweave.operators.clustering import DIGITS

_CLUSTERS = "struct(k varchar[], xs double[][], os bigint[])[]"


def vectors(weights: dict[str, float], dim: int) -> str:
    """The scaled unit vectors end to end, as weighted_unit makes them."""
    parts = []
    for c, w in weights.items():
        square = f"list_sum(list_transform({c}, lambda e: e::double * e))"
        scaled = f"case when {square} > 0 then list_transform({c}, lambda e: e::double * ({w ** 0.5!r} / sqrt({square}))) else list_transform({c}, lambda e: e::double) end"
        parts.append(f"case when len({c}) = {dim} then {scaled} else list_resize([]::double[], {dim}, 0.0::double) end")
    return f"flatten([{', '.join(parts)}])"


def _dot(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}), {DIGITS})"


def fold(name: str, rows: str, threshold: float, init: str = f"[]::{_CLUSTERS}") -> str:
    """CTE name(n, cl): the clusters after each of rows (n, ord, key, x)."""
    score = (
        f"case when 2 * len(list_filter(c.xs, lambda y: {_dot('y', 'x')} >= {threshold})) >= len(c.xs) "
        f"then greatest(list_max(list_transform(c.xs, lambda y: {_dot('y', 'x')})), 0.0) else 0.0 end"
    )
    return f"""{name}(n, cl) as (select 0::bigint, {init}
  union all select n, case when sc[hit] >= {threshold}
    then list_transform(c0, lambda c, i: case when i = hit and not list_contains(c.k, key) then {{k: list_append(c.k, key), xs: list_append(c.xs, x), os: list_append(c.os, ord)}} else c end)
    else list_append(c0, {{k: [key], xs: [x], os: [ord]}}) end
  from (select *, list_position(sc, list_max(sc)) as hit from (select *, list_transform(c0, lambda c: {score}) as sc from (
    select m.n, m.ord, m.key, m.x, case when len(f.cl) = 0 then [{{k: [m.key], xs: [m.x], os: [m.ord]}}] else f.cl end as c0 from {name} f join {rows} m on m.n = f.n + 1))))"""


def members(name: str, folded: str) -> str:
    """CTE name(pattern_id, key, x, ord) of the last state of a fold."""
    last = f"select cl from {folded} order by n desc limit 1"
    return f"{name} as (select pattern_id, unnest(c.k) as key, unnest(c.xs) as x, unnest(c.os) as ord from (select unnest(cl) as c, unnest(range(len(cl))) as pattern_id from ({last})))"


def passes(count: int, threshold: float, confidence: float, negative_weight: float, unknown_weight: float, strip) -> str:
    """CTEs of so many passes over sx (ord, key, ent1, ent2, x), seeds0 and neg (ent1, ent2), ending in ev and sure (key, confidence).

    Patterns of one member are kept.
    """
    out = []
    for i in range(count):
        init = f"[]::{_CLUSTERS}" if not i else f"(select cl from fold{i - 1} order by n desc limit 1)"
        out += [
            f"m{i} as (select row_number() over (order by ord) as n, ord, key, x from sx semi join seeds{i} using (ent1, ent2))",
            fold(f"fold{i}", f"m{i}", threshold, init),
            members(f"mem{i}", f"fold{i}"),
            f"""v{i} as (select ord, pattern_id, greatest(max(s), 0) as score from (select t.ord, m.pattern_id, {_dot("t.x", "m.x")} as s from sx t, mem{i} m) group by all
  having 2 * count(*) filter (s >= {threshold}) >= count(*))""",
            f"ps{i} as (select distinct {strip('ent1')} as a, {strip('ent2')} as b from seeds{i})",
            f"""cls{i} as (select ord, p::int as pos, (not p and f)::int + (not p and g)::int as neg, (not p and not f and not g)::int as unk from (
  select ord, exists (select 1 from ps{i} where a = a0 and b = b0) as p, exists (select 1 from ps{i} where a = a0) as f, exists (select 1 from ng where a = a0 and b = b0) as g
  from (select ord, {strip('ent1')} as a0, {strip('ent2')} as b0 from sx)))""",
            f"n{i} as (select pattern_id, sum(pos) as p, sum(neg) as g, sum(unk) as u from v{i} join cls{i} using (ord) group by 1)",
            f"best{i} as (select ord, pattern_id, score from (select *, row_number() over (partition by ord order by score desc, pattern_id) as r from v{i} where score > 0) where r = 1 and score >= {threshold})",
            f"found{i} as (select key, pattern_id, arg_min(score, ord) as sim, min(ord) as first_ord from best{i} join sx using (ord) group by 1, 2)",
            f"ev{i} as (select * from found{i})" if not i else f"ev{i} as (select * from ev{i - 1} union all select * from found{i} anti join ev{i - 1} using (key, pattern_id))",
            f"""conf{i} as (select pattern_id, case when sum(p) > 0 then sum(p) / (sum(p) + sum(u) * {unknown_weight} + sum(g) * {negative_weight}) else 0 end as c from (
  {" union all ".join(f"select * from n{k}" for k in range(i + 1))}) group by 1)""",
            f"sure{i} as (select key, 1 - product(1 - least(c * sim, 1)) as confidence, min(first_ord) as first_ord from ev{i} join conf{i} using (pattern_id) group by 1)",
            f"seeds{i + 1} as (select ent1, ent2 from seeds{i} union select ent1, ent2 from sure{i} join sx on ord = first_ord where confidence >= {confidence})",
        ]
    return f"ng as (select distinct {strip('ent1')} as a, {strip('ent2')} as b from neg),\n" + ",\n".join(out)
