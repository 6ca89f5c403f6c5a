"""Best record of each group of duplicates, by skyline selection.

A record has the dimensions completeness (which of its fields are valid, or how many), trust and recency. Completeness and trust take few
values, so a group is first pressed into cells: of all records with the same valid fields and the same trust only the
latest can be undominated, and that one is found by an aggregate that combines before the shuffle. However many rows a group has,
its layers are then peeled from a handful of cells. A field's value comes from the first layer that has a valid one, and within the layer by the
lexicographic policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of a source that is unknown.
UNTRUSTED = 2_147_483_647


def skyline_cells(df: DataFrame, group: list[str], record: str, fields: dict[str, Column], trust: Column, recency: str) -> DataFrame:
    """(group, records, cells): for each group its cells, and the number of distinct records.

    A cell has mask (bit i: field i is valid), trust (small is better), latest, record and the fields' values. record
    identifies copies of a row. Of records in one cell with the same recency the smallest identifier is taken. A null
    recency is older than any. Groups with a null key are left out: they are no known group.
    """
    mask = sum((F.when(F.coalesce(ok, F.lit(False)), 1 << i).otherwise(0) for i, ok in enumerate(fields.values())), F.lit(0))
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    cols = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    rows = df.where(known).select(
        *cols, F.col(record).cast("bigint").alias("__record"), F.coalesce(trust.cast("int"), F.lit(UNTRUSTED)).alias("__trust"),
        F.col(recency).alias("__at"), mask.alias("__mask"), *[F.col(f).alias(f"__f{i}") for i, f in enumerate(fields)],
    )
    keys = [f"__g{i}" for i in range(len(group))]
    # nulls are least; of equal times the smaller identifier is the greater
    order = F.struct(F.col("__at"), -F.col("__record"))
    best = F.max_by(F.struct(F.col("__record"), F.col("__at"), *[F.col(f"__f{i}") for i in range(len(fields))]), order)
    cells = rows.groupBy(*keys, "__mask", "__trust").agg(best.alias("best"), F.min("__record").alias("lo"), F.max("__record").alias("hi"))
    cell = F.struct(F.col("__mask").alias("mask"), F.col("__trust").alias("trust"), F.col("best.__at").alias("latest"), F.col("best.__record").alias("record"), *[F.col(f"best.__f{i}").alias(f) for i, f in enumerate(fields)])
    out = cells.groupBy(*keys).agg(F.collect_list(cell).alias("cells"), (F.min("lo") < F.max("hi")).alias("several"))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.coalesce("several", F.lit(False)).alias("several"), "cells")


def _dominates(a: Column, b: Column, count: bool) -> Column:
    """a is at least as complete, trusted and recent as b, and better in one of these. Of equal times the smaller identifier is the more recent."""
    more = F.bit_count(a["mask"]) >= F.bit_count(b["mask"]) if count else a["mask"].bitwiseAND(b["mask"]) == b["mask"]
    later = F.when(b["latest"].isNull(), a["latest"].isNotNull()).otherwise(F.coalesce(a["latest"] > b["latest"], F.lit(False)))
    recent = later | (a["latest"].eqNullSafe(b["latest"]) & (a["record"] < b["record"]))
    return more & (a["trust"] <= b["trust"]) & recent


def survivors(
    df: DataFrame, group: list[str], record: str, fields: dict[str, Column], trust: Column, recency: str, policy: dict[str, str] | None = None, completeness: str = "fields"
) -> DataFrame:
    """One surviving record for each group with at least two records.

    fields: column name to the condition that its value is valid. completeness "fields": a record is as complete as another if it has all
    its valid fields; "count": if it has as many. Layers are peeled, the undominated records first. A field is taken from the first
    layer in which it is valid; within the layer policy says by what: "trust" (trust, then recency) or "recency" (recency
    alone), then the smallest identifier. With "fields" no valid value is lost behind a layer without one, so the first layer has the best of
    the group by either policy; with "count" a fuller record may hide the only one with a field, and a later layer fills it. Result: group, layers
    (number of dominance layers), skyline (size of the first), and for each field f its value f, the record f_record and the
    layer f_layer (from 1); all are null if the group has no valid value.
    """
    policy = policy or {}
    cells = skyline_cells(df, group, record, fields, trust, recency).where("several")
    # layer of a cell: peel off what no remaining cell dominates; a chain is at most as long as the number of cells
    peel = F.aggregate(
        F.sequence(F.lit(1), F.size("cells")),
        F.struct(F.col("cells").alias("rest"), F.transform(F.filter(F.col("cells"), lambda c: F.lit(False)), lambda c: F.struct(F.lit(0).alias("layer"), c.alias("cell"))).alias("order"), F.lit(0).alias("layers"), F.lit(0).alias("skyline")),
        lambda acc, _: F.when(F.size(acc["rest"]) == 0, acc).otherwise(_peeled(acc, completeness == "count")),
    )
    out = cells.withColumn("__peeled", peel)
    cols = [F.col(g) for g in group] + [F.col("__peeled.layers").alias("layers"), F.col("__peeled.skyline").alias("skyline")]
    for i, f in enumerate(fields):
        best = _best("__peeled.order", i, f, policy.get(f, "trust") == "trust")
        out = out.withColumn(f"__best{i}", best)
        cols += [F.col(f"__best{i}.value").alias(f), F.col(f"__best{i}.record").alias(f"{f}_record"), (-F.col(f"__best{i}.layer")).alias(f"{f}_layer")]
    return out.select(*cols)


def _best(order: str, i: int, field: str, by_trust: bool) -> Column:
    """Of the first layer with a valid field i, the best cell by the policy."""
    valid = F.filter(order, lambda o: o["cell"]["mask"].bitwiseAND(1 << i) != 0)
    key = lambda c: [(-c["trust"]).alias("trust")] if by_trust else []
    one = lambda o, c: F.struct((-o["layer"]).alias("layer"), *key(c), c["latest"].alias("latest"), (-c["record"]).alias("id"), c["record"].alias("record"), c[field].alias("value"))
    return F.array_max(F.transform(valid, lambda o: one(o, o["cell"])))


def _peeled(acc: Column, count: bool) -> Column:
    rest, layer = acc["rest"], (acc["layers"] + 1)
    top = F.filter(rest, lambda c: ~F.exists(rest, lambda o: _dominates(o, c, count)))
    return F.struct(
        F.filter(rest, lambda c: F.exists(rest, lambda o: _dominates(o, c, count))).alias("rest"),
        F.concat(acc["order"], F.transform(top, lambda c: F.struct(layer.alias("layer"), c.alias("cell")))).alias("order"),
        layer.alias("layers"),
        F.when(acc["layers"] == 0, F.size(top)).otherwise(acc["skyline"]).alias("skyline"),
    )
