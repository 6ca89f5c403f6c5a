from pyspark.sql import functions as F

from relweave.functions import relphrase, tagging
from relweave.functions import text as T
from relweave.functions.fuzzy import jaro_winkler, jaro_winkler_similarity, token_jaccard
from relweave.functions.tokenize import entity_parts, tokens

# (tokens with tags, kept phrase, passive, content words)
PHRASES = [
    ("is/VBZ based/VBN in/IN", "is based in", False, "based"),
    (",/, based/VBN in/IN", "based in", False, "based"),
    ("was/VBD acquired/VBN by/IN", "was acquired by", True, "acquired"),
    ("founded/VBN by/IN", "founded by", True, "founded"),
    ("was/VBD founded/VBN yesterday/NN by/IN", "was founded yesterday by", True, "founded yesterday"),
    ("sold/VBD yesterday/NN by/IN", "sold yesterday by", False, "sold yesterday"),
    ("has/VBZ helped/VBN in/IN developing/VBG tools/NNS", "has helped in", False, "helped"),
    ("wants/VBZ to/TO extend/VB", "wants to extend", False, "wants extend"),
    ("bought/VBD quickly/RB the/DT firm/NN from/IN", "bought quickly the firm from", False, "bought firm"),
    ("and/CC", "", False, ""),
    ("", "", False, ""),
]


def tagged(text):
    return [tuple(x.rsplit("/", 1)) for x in text.split()]


def test_phrases(spark):
    df = spark.createDataFrame([(i, tagged(p[0])) for i, p in enumerate(PHRASES)], "i int, t array<struct<tok:string,tag:string>>")
    phrase = relphrase.relational_phrase(F.col("t"))
    rows = df.select("i", F.array_join(F.transform(phrase, lambda x: x["tok"]), " ").alias("p"), relphrase.passive_voice(phrase).alias("v"), F.array_join(relphrase.content_words(F.col("t")), " ").alias("c"))
    for r in rows.collect():
        assert (r.p, r.v, r.c) == PHRASES[r.i][1:], PHRASES[r.i]


def test_phrase_scanner_against_a_loop(spark):
    import random

    rng = random.Random(3)
    seqs = [[rng.choice("VVRTNJPDIO") for _ in range(rng.randint(0, 14))] for _ in range(500)]

    def loop(s):
        out, i, n = [0] * len(s), 0, 0
        while i < len(s):
            if s[i] == "V":
                n += 1
                out[i] = n
                i += 1
                for allowed in ("VRT", "NJRPD", "IT"):
                    while i < len(s) and s[i] in allowed:
                        out[i] = n
                        i += 1
            i += 1
        return out

    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s array<string>")
    for r in df.select("i", relphrase.phrase_groups(F.col("s")).alias("g")).collect():
        assert r.g == loop(seqs[r.i]), seqs[r.i]


def test_universal_phrases(spark):
    df = spark.createDataFrame([(tagged("he/PRP was/VBD hired/VBN by/IN it/PRP and/CC left/VBD"),)], "t array<struct<tok:string,tag:string>>")
    got = df.select(relphrase.universal_phrases(F.col("t")).alias("p")).first().p
    assert [x.phrase for x in got] == ["was hired by ", "left "]


def test_tokens(spark):
    cases = {
        'The firm, based in Reston, Va., said: "It\'s fine."': "The firm , based in Reston , Va. , said : `` It 's fine . ''",
        "": "", "a": "a", "can't stop (now)": "ca n't stop ( now )", "43-31 to $5": "43-31 to $ 5",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string")
    for r in df.select("s", F.array_join(tokens(F.col("s")), " ").alias("t")).collect():
        assert r.t == cases.get(r.s, ""), r.s
    parts = spark.createDataFrame([("Reston, Va.",), (".",), ("Paris",)], "s string").select(entity_parts(F.col("s")).alias("p")).collect()
    assert [r.p for r in parts] == [["Reston", ",", "Va."], ["."], ["Paris"]]


def test_names_and_words(spark):
    df = spark.createDataFrame([(x,) for x in ["n/a", " [none] ", None, "", " ", "--", "Ann", "UNK", "7", "Na Li"]], "s string")
    assert [r[0] for r in df.select(T.holds_name(F.col("s"))).collect()] == [False] * 6 + [True, False, True, True]
    w = spark.createDataFrame([("<ORG>A-b</ORG>c_d É1",)], "s string").select(T.words(F.col("s"))).first()[0]
    assert w == ["a", "b", "c", "d", "é1"]
    b = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(T.bigrams(F.col("t")).alias("b")).collect()
    assert [r.b for r in b] == [["a b", "b c"], [], []]


def test_similarity(spark):
    assert abs(jaro_winkler("MARTHA", "MARHTA") - 0.9611111) < 1e-6 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    df = spark.createDataFrame([("Wal-Mart Stores", "Wal-Mart"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(token_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    assert df.select(jaro_winkler_similarity("a", "b")).collect()[1][0] is None


def test_tags():
    assert tagging.rule_tags(["It", "was", "acquired", "by", "Acme", "."]) == ["PRP", "VBD", "VBN", "IN", "NNP", "."]
    assert tagging.rule_tags([]) == []


def test_vectors(spark):
    from relweave.functions import vectors as V

    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], None), ([1.0], [1.0, 1.0], [2.0, 0.0])], "a array<float>, b array<float>, c array<float>")
    rows = df.select(V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b"), 2).alias("z"), V.weighted_unit({"a": 0.25, "b": 0.75, "c": 0.0}, 2).alias("w")).collect()
    assert [round(x, 6) for x in rows[0].u] == [0.6, 0.8] and rows[0].z == 0 and rows[1].z == 0
    assert [round(x, 6) for x in rows[0].w] == [0.3, 0.4, 0, 0, 0, 0] and [round(x, 4) for x in rows[1].w] == [0, 0, 0.6124, 0.6124, 0, 0]


def test_native_tags_are_the_rule_tagger(spark):
    import random

    from pyspark.sql import functions as F

    from relweave.functions import tagging

    rng = random.Random(5)
    words = [w for w in tagging._LEXICON] + "Firma firma Bought buying quickly fastest 12 1,000 3-4 -- , . ? `` '' ( ) ; Ürün ßx dress cars was To plan plans nation al ed zed".split()
    rows = [[rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = {r.i: r.g for r in df.select("i", tagging.pos_tags(F.col("t")).alias("g")).collect()}
    assert all(got[i] == (None if r is None else tagging.rule_tags(r)) for i, r in enumerate(rows))
    own = {r.i: r.g for r in df.select("i", tagging.pos_tags(F.col("t"), lambda t: ["X"] * len(t)).alias("g")).collect()}
    assert own[300] is None and all(own[i] == ["X"] * len(r) for i, r in enumerate(rows[:300]))


def test_jaro_winkler_of_many(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from relweave.functions import fuzzy

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé中 ") for _ in range(rng.choice([0, 1, 2, 5, 9, 30])))
    pairs = [(a := word(), a if rng.random() < 0.1 else "".join(rng.sample(a, len(a))) if rng.random() < 0.4 else word()) for _ in range(800)] + [("MARTHA", "MARHTA"), ("x" * 3000, "x" * 2999 + "y"), ("", "a"), ("", "")]
    want = [fuzzy.jaro_winkler(a, b) for a, b in pairs]
    for lot in (fuzzy.LOT, 50):
        monkeypatch.setattr(fuzzy, "LOT", lot)
        got = fuzzy.jaro_winkler_all([a for a, _ in pairs], [b for _, b in pairs])
        assert max(abs(g - w) for g, w in zip(got, want)) < 1e-12
    assert len(fuzzy.jaro_winkler_all([], [])) == 0
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(9000, None, "a"), (9001, "a", None)], "i int, a string, b string")
    rows = {r.i: r.s for r in df.select("i", fuzzy.jaro_winkler_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert rows[9000] is None and rows[9001] is None and all(abs(rows[i] - w) < 1e-12 for i, w in enumerate(want))
