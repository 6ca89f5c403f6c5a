from collections import Counter

from relweave.llm import frequency


def test_against_counting(spark):
    texts = [(1, "a b  a"), (1, "a b  a"), (70, "b\tC ,"), (5000, "c"), (3, None), (4, "  "), (6, "x" * 5000 + " b"), (None, "b z"), (None, "b z"), (-9, "b")]
    df = spark.createDataFrame([(i, t, "no", 1) for i, t in texts], "rel_id bigint, text string, term string, bits int")
    seen, docs = Counter(), Counter()
    for i, t in dict.fromkeys((i if i is not None else f"n{k}", t) for k, (i, t) in enumerate(texts)):
        words = (t or "").lower().split()
        seen.update(words)
        docs.update(set(words))
    got = {r.term: r for r in frequency.term_frequencies(df, "rel_id", "text", 2, 0.5).collect()}
    assert {k: (r.occurrences, r.records) for k, r in got.items()} == {k: (seen[k], docs[k]) for k in seen}
    assert got["b"].mark == "common" and got["a"].mark == "rare" and got["c"].mark == "useful"


def test_bitmaps(spark):
    df = spark.createDataFrame([(i, "t") for i in range(0, 9000, 3)] + [(0, "t")], "id bigint, text string")
    rows = frequency.term_bitmaps(df, "id", "text").where("term = 't'").collect()
    found = {w.word * 64 + b for r in rows for w in r.words for b in range(64) if (w.bits >> b) & 1}
    assert found == set(range(0, 9000, 3)) and sum(r.records for r in rows) == 3000
    assert max(len(r.words) for r in rows) <= 64


def test_records_without_identifier_are_apart(spark):
    df = spark.createDataFrame([(k, "t u") for k in range(-70, 70)] + [(None, "t t")] * 90, "id bigint, text string")
    got = {r.term: (r.occurrences, r.records, r.share) for r in frequency.term_frequencies(df, "id", "text").collect()}
    assert got == {"t": (320, 230, 1.0), "u": (140, 140, 140 / 230)}


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert frequency.term_frequencies(df, "id", "text").count() == 0
