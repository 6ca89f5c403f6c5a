from relweave.sources import corpus as C
from relweave.sources import facts as S


def written(folder):
    return "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*")))


def test_sentences_and_order(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one\n  two\t\n\nthree é", encoding="utf-8")
    rows = C.read_sentences(spark, str(tmp_path / "s.txt")).orderBy("sent_id").collect()
    assert [r.sentence for r in rows] == ["one", "two", "", "three é"]
    df = spark.range(100, 0, -1).toDF("k").repartition(7)
    got = {r.k: r.n for r in C.number_rows(df, "k", "n").collect()}
    assert got == {k: k - 1 for k in range(1, 101)}
    lines = spark.createDataFrame([("\n" * 100,), (None,), ("a",)], "t string")
    assert C.count_lines(lines, "t").first().lines == 100 and C.count_lines(lines.limit(0), "t").first().lines == 0


def test_seeds(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\ne1:ORG\ne2:LOC\n\n Nok ; Esp ;x\nNok;Esp\nearly;bird\n   \nbroken\n")
    seeds, types = C.read_seeds(spark, str(tmp_path / "p.txt"))
    assert sorted((r.ent1, r.ent2) for r in seeds.collect()) == [("Nok", "Esp"), ("early", "bird")]
    assert tuple(types.first()) == ("ORG", "LOC")


def test_word2vec(spark, tmp_path):
    C.write_word2vec(str(tmp_path / "v.bin"), {"a": [1.0, 2.0], "é": [0.5, -1.0]})
    got = {r.word: r.vec for r in C.read_word2vec(spark, str(tmp_path / "v.bin")).collect()}
    assert got == {"a": [1.0, 2.0], "é": [0.5, -1.0]}


def test_blocks_and_relations(spark, tmp_path):
    text = "instance: Acme\tOslo\tscore:0.9\nsentence: s one\npattern_bef: b\npattern_bet: based in\npattern_aft: a\npassive voice: True\n\ninstance: B\tC score:0.2\nsentence: s\n\nnoise\n\n"
    (tmp_path / "o.txt").write_text(text)
    rows = S.read_blocks(spark, str(tmp_path / "o.txt"), 0.1).orderBy("ent1").collect()
    assert [(r.ent1, r.ent2, r.score, r.bet_words, r.passive_voice) for r in rows] == [("Acme", "Oslo", 0.9, "based in", True), ("B", "C", 0.2, "", False)]
    out = spark.createDataFrame([("A", "é", 0.5, "s", "", None, "x", False)], S.OUTPUT_SCHEMA)
    S.write_relations(out, str(tmp_path / "rel"))
    assert '"bet_words":null' in written(tmp_path / "rel")
    assert S.read_relations(spark, str(tmp_path / "rel")).first().ent2 == "é"


def test_knowledge_bases(spark, tmp_path):
    (tmp_path / "dbpedia_x").write_text("<http://dbpedia.org/resource/Big_Co> <http://dbpedia.org/ontology/hq> <http://dbpedia.org/resource/Oslo_(city)> .\nshort line\n")
    (tmp_path / "freebase_x").write_text("# c\nAcme \trel\tOslo\n")
    (tmp_path / "yago_x").write_text("<Yo>\t<rel>\t<Ya> more\n")
    assert {r.entity for r in S.read_entities(spark, str(tmp_path)).collect()} == {"Big Co", "Oslo", "Acme", "Yo", "Ya"}
    r = S.parse_ntriples(spark.read.text(str(tmp_path / "dbpedia_x"))).first()
    assert (r.e1, r.r, r.e2) == ("Big Co", "hq", "Oslo")
    assert [tuple(r) for r in S.read_triples(spark, str(tmp_path / "freebase_x")).collect()] == [("Acme", "rel", "Oslo")]
    (tmp_path / "listed.tsv").write_text("A\tPeer\tB (x)\t.\nA\tother\tC\t.\n")
    assert [tuple(r) for r in S.read_listed(spark, str(tmp_path / "listed.tsv")).collect()] == [("A", "Peer", "B")]
    (tmp_path / "acr.tsv").write_text("AB\tnote\tAlpha Beta\nX/Y\tn\tz\n")
    assert S.read_acronyms(spark, str(tmp_path / "acr.tsv")).first().expansions == ["Alpha Beta"]
    S.write_triples(spark.createDataFrame([("a", "r", "b")], "e1 string, r string, e2 string"), str(tmp_path / "t"))
    assert written(tmp_path / "t") == "a\tr\tb\n"
    df = spark.createDataFrame([("x", True), ("x", True), ("y", False)], "sentence string, selected boolean")
    S.write_sentences(df, str(tmp_path / "sel"), str(tmp_path / "dis"))
    assert spark.read.text(str(tmp_path / "sel")).count() == spark.read.text(str(tmp_path / "dis")).count() == 1


def test_word2vec_in_small_blocks(tmp_path):
    import io

    import pytest

    vectors = {"a": [1.0, 2.0, 3.0], "long" * 50: [0.5, -1.0, 0.0], "é": [7.0, 8.0, 9.0]}
    C.write_word2vec(str(tmp_path / "x" / "v.bin"), vectors)
    data = (tmp_path / "x" / "v.bin").read_bytes()
    for block in (16, 64, 1 << 20):
        assert {w: v.tolist() for w, v in C.parse_word2vec(io.BytesIO(data), block)} == vectors
    with pytest.raises(ValueError):
        list(C.parse_word2vec(io.BytesIO(data[:-5])))
    C.write_word2vec(str(tmp_path / "none.bin"), {})
    assert list(C.parse_word2vec(io.BytesIO((tmp_path / "none.bin").read_bytes()))) == []


def test_release(spark, monkeypatch):
    from relweave import session

    monkeypatch.setattr(session, "_written", [])
    session.materialize(spark.range(3), "a")
    session.materialize(spark.range(4), "b")
    paths = list(session._written)
    assert session.release(spark) == 2 and session.release(spark) == 0
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_index_holds_eligible_sentences(spark, tmp_path):
    s = spark.createDataFrame([(1, "<ORG>A</ORG> in <LOC>B</LOC>"), (2, "<ORG>A</ORG> . <LOC>B</LOC>"), (3, None)], "sent_id bigint, sentence string")
    rel = spark.createDataFrame([(1, ["bought"]), (2, ["."]), (3, ["bought"])], "sent_id bigint, between array<string>")
    S.write_index(s, rel, str(tmp_path / "index"))
    got = sorted((r.sent_id, r.position, r.term) for r in S.read_index(spark, str(tmp_path / "index")).collect())
    assert got == [(1, 0, "<ORG>A</ORG>"), (1, 2, "<LOC>B</LOC>")]
