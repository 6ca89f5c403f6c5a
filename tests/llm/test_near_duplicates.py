import random
from collections import Counter

from relweave.llm import near_duplicates as N


def sim(a, b):
    a, b = Counter(a), Counter(b)
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return 1.0 if not total else shared / total


def test_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 3)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9001, ""), (9002, "..."), (9003, None), (None, "w1 w2"), (9004, "w1 " * 20_000), (9005, "w1 " * 20_000 + "w2")]
    rows += rows[:10]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "id bigint, text string, rep int, `key` string")
    data = {i: t.split() if t != "..." else [] for i, t in rows if i is not None and t is not None}
    want = {(a, b) for a in data for b in data if a < b and sim(data[a], data[b]) >= 0.7}
    got = {(r.id_a, r.id_b): r.similarity for r in N.near_duplicate_pairs(df, "id", "text", 0.7).collect()}
    assert set(got) == want and all(abs(v - sim(data[a], data[b])) < 1e-9 for (a, b), v in got.items()) and len(want) > 60
    groups = {r.id: r for r in N.near_duplicate_groups(df, "id", "text", 0.7).collect()}
    assert set(groups) == set(data) and all(groups[a].group_id == groups[b].group_id for a, b in want)


def test_hot_class_is_one_row_each(spark):
    df = spark.createDataFrame([(i, "the same old words") for i in range(3000)] + [(5000, "other")], "id bigint, text string")
    g = N.near_duplicate_groups(df, "id", "text")
    assert g.count() == 3001 and g.where("class_id = 0").count() == 3000


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert N.near_duplicate_pairs(df, "id", "text").count() == 0 and N.near_duplicate_groups(df, "id", "text").count() == 0
