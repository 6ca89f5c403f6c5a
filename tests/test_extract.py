from pyspark.sql import functions as F

from relweave.config import Config
from relweave.operators import extract

# invented sentences: (sentence, types, expected (ent1, ent2, distance, before, between, after))
CASES = [
    ("<ORG>Norvik</ORG>, based in <LOC>Halden</LOC>, is the largest maker.", "ORG LOC", [("Norvik", "Halden", 4, "", ", based in", ", is")]),
    ("Because <ORG>Dyna</ORG>, headquartered in <LOC>Reston</LOC>, Va., won.", "ORG LOC", [("Dyna", "Reston", 4, "Because", ", headquartered in", ", Va.")]),
    ("firms like <ORG>Hand</ORG>, a company based in <LOC>Sil Valley</LOC> that looks", "ORG LOC", [("Hand", "Sil Valley", 6, "firms like", ", a company based in", "that looks")]),
    ("<ORG>Fizz</ORG> says it has hired <ORG>Morg Stan</ORG> to conduct", "ORG ORG", [("Fizz", "Morg Stan", 5, "", "says it has hired", "to conduct")]),
    ("<LOC>Suisse</LOC> and <LOC>Sud Africa</LOC> play", "LOC LOC", []),
    ("<LOC>Eire</LOC> beat <LOC>Ital</LOC>, then lost 43-31 to <LOC>Fran</LOC>.", "LOC LOC", [("Eire", "Ital", 2, "", "beat", ", then"), ("Ital", "Fran", 6, "Eire beat", ", then lost 43-31 to", ".")]),
    ("<PER>Burt</PER>'s engine passed <ORG>NASC</ORG> inspection following", "PER ORG", [("Burt", "NASC", 4, "", "'s engine passed", "inspection following")]),
    ("<ORG>A</ORG> met <ORG>A</ORG> here", "ORG ORG", []),
    ("only <ORG>one</ORG> here", "ORG LOC", []),
    ("", "ORG LOC", []),
]


def test_contexts(spark):
    for kinds in {c[1] for c in CASES}:
        a, b = kinds.split()
        rows = [(i, c[0]) for i, c in enumerate(CASES) if c[1] == kinds] + [(99, None)]
        df = spark.createDataFrame(rows, "sent_id bigint, sentence string")
        got = extract.relationships(df, Config(e1_type=a, e2_type=b), tagger=None).collect()
        for i, c in enumerate(CASES):
            if c[1] == kinds:
                mine = sorted((r.pos, (r.ent1, r.ent2, r.distance, " ".join(r.before), " ".join(r.between), " ".join(r.after))) for r in got if r.sent_id == i)
                assert [m[1] for m in mine] == c[2], c[0]
        assert not [r for r in got if r.sent_id == 99]


def test_locations_and_collisions(spark):
    s = "<ORG>New York</ORG> sued <ORG>New York Times</ORG> in <LOC>New York</LOC>"
    df = spark.createDataFrame([(1, s)], "sent_id bigint, sentence string")
    got = extract.locate(df, typed=False).select(F.explode("locs").alias("l")).select("l.start", "l.surface", "l.etype").collect()
    assert [tuple(r) for r in got] == [(1, "New York", "ORG"), (4, "New York Times", "ORG"), (8, "New York", "ORG")]
    one = spark.createDataFrame([(["Paris"], "Paris is in France and Paris is big".split())], "p array<string>, t array<string>")
    assert one.select(extract.find_locations(F.col("p"), F.col("t"))).first()[0] == [1, 6]


def test_window_zero_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y <ORG>A</ORG> bought <ORG>B</ORG> z", "p", "t")], "sent_id bigint, sentence string, note string, kind string")
    r = extract.relationships(df, Config(e1_type="ORG", e2_type="ORG", context_window_size=0), tagger=None).first()
    assert r.before == [] and r.after == [] and r.note == "p"


def test_tuple_key(spark):
    df = spark.createDataFrame([("a", "b c"), ("a b", "c"), ("a", "b c")], "x string, y string")
    assert df.select(extract.tuple_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == 2


def test_context_vectors(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "zz"], []), (2, [], None)], "id bigint, w array<string>, v array<string>")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<float>")
    got = {r.id: r for r in extract.context_vectors(rows, "id", {"wv": "w", "vv": "v"}, emb, 2).collect()}
    assert got[1].wv == [2.0, 3.0] and got[1].vv == [0.0, 0.0] and got[2].wv == [0.0, 0.0]
