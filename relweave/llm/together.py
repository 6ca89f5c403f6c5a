"""Items that appear together, by collapsing equal baskets.

Baskets are made sets, sorted, and equal ones become one row with a weight, so that the pairs of a basket that occurs a
million times are enumerated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.session import materialize

#: Items of a block; a basket of more items than LARGE is never held in one row, but as blocks of about so many.
BLOCK, LARGE = 64, 1024
#: The blocks of a large basket are paired in places of so many blocks on one side.
SIDE = 64


def basket_items(df: DataFrame, basket: str, items: Column) -> DataFrame:
    """(basket, item): distinct. items is an array column; its nulls, and rows without a basket identifier, are left out."""
    pairs = df.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.explode(items).alias("item"))
    return pairs.where(F.col("item").isNotNull()).distinct()


def collapsed(held: DataFrame) -> DataFrame:
    """(items, weight): distinct sorted item sets and the number of baskets that have them."""
    return held.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def _small_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, weight) of every two items of each set."""
    rows = sets.where(F.size("items") > 1).select("items", "weight", F.posexplode("items").alias("k", "a"))
    return rows.select("a", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("b"), "weight")


def _large_pairs(held: DataFrame) -> DataFrame:
    """(a, b, weight) of every two items of each large basket (basket, item, n), block by block."""
    blocks = held.withColumn("block", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / BLOCK))).groupBy("basket", "block").agg(F.collect_list("item").alias("items"), F.max("n").alias("n"))
    salts = F.ceil(F.col("n") / (BLOCK * SIDE))
    x = blocks.select("basket", F.col("block").alias("i"), F.col("items").alias("x"), F.pmod("block", salts).alias("salt"))
    y = blocks.select("basket", F.col("block").alias("j"), F.col("items").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    both = x.join(y, ["basket", "salt"]).where(F.col("i") <= F.col("j"))
    pairs = both.select("i", "j", "y", F.explode("x").alias("p")).select("i", "j", "p", F.explode("y").alias("q")).where((F.col("i") < F.col("j")) | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(1).cast("bigint").alias("weight"))


def pair_counts(held: DataFrame) -> DataFrame:
    """(a, b, together): a < b by code point, and the baskets (basket, item) that hold both.

    Equal baskets are collapsed and their pairs made once. Baskets of more than LARGE items are cut into blocks and the blocks paired, spread
    over the cluster: no row holds more than a block, and no pair is left out.
    """
    large = materialize(held.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE), "large")
    pairs = _small_pairs(collapsed(held.join(large, "basket", "left_anti")))
    pairs = pairs.unionByName(_large_pairs(held.join(large, "basket")))
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("together"))


def linked_pairs(df: DataFrame, basket: str, items: Column, min_together: int = 3, min_lift: float = 8.0) -> DataFrame:
    """(a, b, together, n_a, n_b, baskets, lift, conviction): pairs in at least min_together baskets and with that lift.

    lift is together * N / (n_a * n_b) and conviction (1 - n_b / N) / (1 - together / n_a), null if a never comes without b;
    N counts the baskets with any item. Items in fewer than min_together baskets can have no such pair and are taken out
    before baskets are made; they count in N. An empty table gives no rows.
    """
    held = materialize(basket_items(df, basket, items), "items")
    total = held.select("basket").distinct().agg(F.count(F.lit(1)).alias("baskets"))
    often = held.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together)
    kept = materialize(held.join(often.select("item"), "item", "left_semi"), "kept")
    pairs = pair_counts(kept).where(F.col("together") >= min_together)
    out = (
        pairs.join(often.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(often.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("together") * F.col("baskets") >= min_lift * F.col("n_a") * F.col("n_b"))
    )
    return out.select(
        "a", "b", "together", "n_a", "n_b", "baskets",
        (F.col("together") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_a") > F.col("together"), (1 - F.col("n_b") / F.col("baskets")) / (1 - F.col("together") / F.col("n_a"))).alias("conviction"),
    )
