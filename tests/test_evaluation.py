from pyspark.sql import functions as F

from relweave.operators import evaluation as E
from relweave.operators import kb as K


def pairs(spark, rows):
    return spark.createDataFrame(rows, "ent1 string, ent2 string")


def test_clean(spark):
    rows = [("Acme (old)", "r", "Oslo"), ("/m/1", "r", "x"), ("m/2", "r", "x"), ("Acme #3", "r", "x"), ("x", "r", " UNESCO"), ("12", "r", "x"), (None, "r", "x")]
    df = spark.createDataFrame(rows, "e1 string, r string, e2 string")
    assert [r.e1 for r in K.clean_facts(df).collect()] == ["Acme", "12"]
    listed = K.clean_listed_facts(df.withColumn("r", F.lit("Peer"))).collect()
    assert [r.e1 for r in listed] == ["Acme", "x"]
    assert K.clean_listed_facts(df).count() == 0


def test_swap_and_direction(spark):
    df = spark.createDataFrame([("a", "b", "x", True), ("a", "b", "is 's parent", False), ("a", "b", "a subsidiary of", True), ("a", "b", None, None)], "ent1 string, ent2 string, bet_words string, passive_voice boolean")
    assert [r.ent1 for r in K.swap_arguments(df, "acquired").collect()] == ["b", "b", "b", "a"]
    assert [r.ent1 for r in K.swap_arguments(df, "headquarters").collect()] == ["b", "a", "b", "a"]
    assert [r.ent1 for r in K.swap_arguments(df, "founder").collect()] == ["a"] * 4
    kb = spark.createDataFrame([("x", "y")], "e1 string, e2 string")
    assert K.directed(kb, "founder").first().e1 == "y" and K.directed(kb, "acquired").first().e1 == "x"


def test_matches(spark):
    kb = spark.createDataFrame([("Wal-Mart", "Ark"), ("Acme Inc.", "Oslo"), ("Borg", "Bergen Town"), (None, "x")], "e1 string, e2 string")
    p = pairs(spark, [("Wal-Mart Stores", "Ark"), ("Acmee", "Oslo"), ("Borg", "Bergen"), ("Acme Inc.", "Oslo"), ("None", "Such"), (None, "Oslo")])
    one = {r.ent1 for r in K.fuzzy_matches(p, kb, "arg1", True).collect()}
    assert one == {"Wal-Mart Stores", "Acmee", "Acme Inc."}
    known = K.known_pairs(p, kb)
    assert {r.ent1 for r in known.collect()} == {"Wal-Mart Stores", "Acmee", "Borg", "Acme Inc."}
    assert {r.ent1 for r in K.unknown_pairs(p, known).collect()} == {"None", None}
    assert K.known_pairs(p, kb.limit(0)).count() == 0


def test_acronyms(spark):
    df = spark.createDataFrame([("AB", "Alpha Beta"), ("AB", "Axe Bow"), ("A/B", "x"), ("C", "y/z"), ("AB", "Alpha Beta"), (None, "q")], "acronym string, expansion string")
    assert [(r.acronym, r.expansions) for r in K.acronym_map(df).where("acronym is not null").collect()] == [("AB", ["Alpha Beta", "Axe Bow"])]
    t = spark.createDataFrame([("NATO",), ("Nato",), ("A B",), ("12",)], "s string").select(K.is_acronym(F.col("s")).alias("a")).collect()
    assert [r.a for r in t] == [True, False, False, False]


def test_relation_types():
    import pytest

    assert K.relation_type("founder").e2_type == "PER"
    with pytest.raises(ValueError):
        K.relation_type("spouse")


def test_ratio_and_metrics(spark):
    rows = [("a", "b", True)] * 7 + [("a", "b", False)] * 10 + [("c", "d", True)] * 5 + [("e", "f", True)] + [("e", "f", False)] * 2
    got = {r.ent1: r.accepted for r in E.proximity_ratio(spark.createDataFrame(rows, "ent1 string, ent2 string, relational boolean")).collect()}
    assert got == {"a": True, "c": False, "e": False}
    n = lambda k, p: pairs(spark, [(f"{p}{i}", "x") for i in range(k)])
    m = E.metrics(n(2, "a"), n(3, "b"), n(10, "s"), n(2, "c"), n(1, "d")).first()
    assert (m.precision, m.recall, round(m.f1, 6)) == (0.5, 0.625, 0.555556)
    z = E.metrics(n(0, "a"), n(0, "b"), n(0, "s"), n(0, "c"), n(0, "d")).first()
    assert (z.precision, z.recall, z.f1) == (0, 0, 0)


def test_sentence_filters(spark):
    rel = spark.createDataFrame([(1, "a", "b", ["bought"]), (1, "b", "c", ["."]), (2, "a", "b", [","]), (3, "a", "b", ["bought"]), (4, "a", "zz", ["bought"]), (5, "a", "b", [])], "sent_id bigint, ent1 string, ent2 string, between array<string>")
    assert [r.sent_id for r in E.eligible_sentences(rel).orderBy("sent_id").collect()] == [3, 4]
    known = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "entity string")
    assert {r.sent_id: r.selected for r in E.selected_sentences(rel, known).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_proximity(spark):
    s = spark.createDataFrame([(i, f"x <ORG>A b</ORG> {'w ' * i}<LOC>C</LOC>") for i in (0, 3, 5, 6, 9)] + [(20, "<LOC>C</LOC> of <ORG>A b</ORG>"), (21, None)], "sent_id bigint, sentence string")
    hits = E.proximity_hits(E.term_positions(s), pairs(spark, [("A b", "C")]), "ORG", "LOC")
    assert sorted(r.sent_id for r in hits.collect()) == [0, 3, 5]
    assert E.proximity_hits(E.term_positions(s), pairs(spark, [("A b", "C")]), "ORG", "LOC", limit=2).count() == 2
