import random
from collections import Counter
from datetime import datetime
from itertools import combinations

from pyspark.sql import functions as F

from relweave.llm import survivor, together


def test_survivors(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        rows.append((rng.choice([1, 2, 3, None]), rng.randrange(12), i, rng.choice([None, "", "Ann", "Bob"]), rng.choice([None, 0.5, 0.9, 7.0]), rng.choice([None, 1, 2, 3]), rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)])))
    rows += rows[:50] + [(9, 0, 1000, "x", 0.1, 1, None), (9, 0, 1000, "x", 0.1, 1, None)]
    df = spark.createDataFrame(rows, "s bigint, p int, rel bigint, name string, conf double, trust int, at timestamp")
    fields = {"name": F.col("name") != "", "conf": F.col("conf").between(0, 1)}
    got = {(r.s, r.p): r for r in survivor.survivors(df, ["s", "p"], "rel", fields, F.col("trust"), "at", {"conf": "recency"}).collect()}
    groups = {}
    for r in set(rows):
        if r[0] is not None:
            groups.setdefault(r[:2], []).append(r)
    groups = {k: v for k, v in groups.items() if len({x[2] for x in v}) > 1}
    assert set(got) == set(groups)
    age = lambda x: -x[6].timestamp() if x[6] else 0
    for k, v in groups.items():
        name = min((x for x in v if x[3]), key=lambda x: (x[5] or 99, age(x), x[2]), default=None)
        conf = min((x for x in v if x[4] is not None and x[4] <= 1), key=lambda x: (age(x), x[2]), default=None)
        assert (got[k].name_record, got[k].name) == ((name[2], name[3]) if name else (None, None))
        assert got[k].conf_record == (conf[2] if conf else None)
        assert 1 <= got[k].skyline and 1 <= got[k].layers
    assert survivor.survivors(df.limit(0), ["s", "p"], "rel", fields, F.col("trust"), "at").count() == 0


def test_layers(spark):
    rows = [(1, 1, "a", 2, datetime(2024, 1, 1)), (1, 2, "a", 1, datetime(2024, 1, 2)), (1, 3, None, 1, datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "s bigint, rel bigint, name string, trust int, at timestamp")
    r = survivor.survivors(df, ["s"], "rel", {"name": F.col("name").isNotNull()}, F.col("trust"), "at").first()
    assert (r.skyline, r.layers, r.name_record) == (2, 2, 2)


def test_a_layer_decides(spark):
    day = lambda d: datetime(2024, 1, d)
    # 1 dominates 2 by the number of its fields, so that its group's c comes from the first layer's 3, though 2 is more trusted
    rows = [(1, 1, "a", "b", None, 1, day(9)), (1, 2, None, None, "c2", 1, day(8)), (1, 3, "a3", "b3", "c3", 3, day(1))]
    # here only 5 has c, and 4 dominates it: the second layer fills it
    rows += [(2, 4, "a", "b", None, 1, day(9)), (2, 5, None, None, "c5", 2, day(8)), (2, 6, None, None, "c6", 2, day(7))]
    df = spark.createDataFrame(rows, "s bigint, rel bigint, a string, b string, c string, trust int, at timestamp")
    fields = {f: F.col(f).isNotNull() for f in "abc"}
    run = lambda how: {r.s: r for r in survivor.survivors(df, ["s"], "rel", fields, F.col("trust"), "at", completeness=how).collect()}
    got = run("count")
    assert (got[1].c, got[1].c_layer, got[1].a, got[1].layers) == ("c3", 1, "a", 2)
    assert (got[2].c, got[2].c_layer, got[2].a, got[2].skyline) == ("c5", 2, "a", 1)
    got = run("fields")
    assert (got[1].c, got[1].c_layer) == ("c2", 1) and (got[2].c, got[2].c_layer) == ("c5", 1)


def test_pairs_against_counting(spark):
    rng = random.Random(1)
    baskets = {b: [rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))] for b in range(300)}
    baskets[1000] = [f"i{k}" for k in range(200)]
    baskets[1001] = [f"i{k}" for k in range(150)]
    rows = [(b, x, "t") for b, v in baskets.items() for x in v] + [(None, "a", "t"), (5000, None, "t"), (1, None, "t")]
    df = spark.createDataFrame(rows, "b bigint, x string, items string")
    n, pair = Counter(), Counter()
    for v in baskets.values():
        n.update(set(v))
        pair.update(combinations(sorted(set(v)), 2))
    total = len(baskets)
    want = {p for p, c in pair.items() if c >= 2 and c * total >= 1.1 * n[p[0]] * n[p[1]]}
    for large in (together.LARGE, 100):
        together.LARGE, old = large, together.LARGE
        got = {(r.a, r.b): r for r in together.linked_pairs(df, "b", F.array("x"), 2, 1.1).collect()}
        counted = {(r.a, r.b): r.together for r in together.pair_counts(together.basket_items(df, "b", F.array("x"))).collect()}
        together.LARGE = old
        assert set(got) == want and all(r.together == pair[p] and r.baskets == total for p, r in got.items())
        assert counted == pair
    assert together.linked_pairs(df.limit(0), "b", F.array("x")).count() == 0
