import random

import pytest
from pyspark.sql import functions as F

from relweave.llm import leakage, packing, splitting
from relweave.llm.tokens import encoding


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id bigint, text string, piece int, container_id string")


def test_leaks_against_windows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = {i: [rng.choice(words) for _ in range(rng.choice([5, 11, 12, 13, 30, 45]))] for i in range(40)}
    items[50] = ["a"] * 14
    texts = {}
    for d in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            src = items[rng.choice(list(items))]
            a = rng.randrange(len(src))
            part = src[a : a + rng.randint(8, 20)]
            k = rng.randrange(len(t) + 1)
            t[k:k] = part
        texts[d] = t
    texts[900] = ["a"] * 12
    texts[901] = ["b"] * 30_000
    want = set()
    for d, t in texts.items():
        grams = {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
        want |= {(d, i) for i, v in items.items() if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11))}
    shown = [(d, " ".join(f"<ORG>{w.upper()}</ORG>," if k % 5 == 0 else w for k, w in enumerate(t))) for d, t in texts.items()]
    shown += [(None, "x"), (999, None), (998, "")] + shown[:3]
    df = docs(spark, shown)
    it = spark.createDataFrame([(i, " ".join(v)) for i, v in items.items()] + [(None, "a"), (77, None), (78, "")], "item_id bigint, text string")
    for size in (leakage.SHARD_WORDS, 500):
        leakage.SHARD_WORDS, old = size, leakage.SHARD_WORDS
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
        leakage.SHARD_WORDS = old
        assert got == want and len(want) > 10
    near = {(r.doc_id, r.item_id) for r in leakage.near_passages(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert near
    index = leakage.build_index(df, "doc_id", "text")
    again = {(r.doc_id, r.item_id) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text", index=index).collect()}
    others = it.where("item_id < 9").withColumn("text", it.text)
    some = {(r.doc_id, r.item_id) for r in leakage.leaks(df, "doc_id", "text", others, "item_id", "text", index=index).collect()}
    assert again == want and some == {x for x in want if x[1] < 9}
    old, leakage.PLACES, leakage.BLOCK_WORDS = (leakage.PLACES, leakage.BLOCK_WORDS), 7, 100
    blocks = {(r.doc_id, r.item_id) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text", index=index).collect()}
    leakage.PLACES, leakage.BLOCK_WORDS = old
    assert blocks == want
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_edited_passages_are_near(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 40, 60]))] for i in range(60)}
    texts, want = {}, set()
    for d in range(60):
        t = [rng.choice(vocabulary) for _ in range(200)]
        w = list(items[d])
        if len(w) > 20:  # words added and changed, so that few runs of 12 are left; the second half of some is left out
            w = w[: len(w) // 2 + 5] if d % 2 else w
            for k in range(9, len(w), 9):
                w[k:k] = ["added"]
        t[50:50] = w
        texts[d], want = t, want | {(d, d)}
    texts[100] = [rng.choice(vocabulary) for _ in range(20_000)]
    df = docs(spark, [(d, " ".join(t)) for d, t in texts.items()] + [(0, " ".join(texts[0]))])
    it = spark.createDataFrame([(i, " ".join(v)) for i, v in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.places for r in leakage.near_passages(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert len(want & set(got)) >= 55 and len(set(got) - want) <= 3
    assert got[0, 0] == max(1, (len(items[0]) + 12) // 24)  # a repeated row counts once
    for d, i in ((df.limit(0), it), (df, it.limit(0)), (df, it.where("item_id = 0").withColumn("text", F.lit("..."))), (df.withColumn("text", F.lit(None).cast("string")), it)):
        assert leakage.near_passages(d, "doc_id", "text", i, "item_id", "text").count() == 0


def check_packing(rows, counts, capacity):
    full, seen = {}, {}
    for r in rows:
        full[r.container_id] = full.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(counts) and max(full.values(), default=0) <= capacity
    for d, n in counts.items():
        mine = sorted(seen[d], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in mine) == n and len(mine) == max(1, -(-n // capacity))
        assert [r.first_token for r in mine] == [capacity * k for k in range(len(mine))]
    used = sum(counts.values())
    return 1 - used / (capacity * len(full)) if full else 0


@pytest.mark.parametrize("kind", ["mixed", "small", "large", "equal", "zero"])
def test_packing(spark, kind):
    rng = random.Random(kind)
    draw = {
        "mixed": lambda: rng.choice([rng.randint(0, 60), rng.randint(100, 500), rng.randint(600, 3000), rng.randint(4000, 9000)]), "small": lambda: rng.randint(1, 300),
        "large": lambda: rng.randint(513, 4096), "equal": lambda: 700, "zero": lambda: 0,
    }[kind]
    counts = {i: draw() for i in range(1500)}
    rows = list(counts.items()) + [(None, 5), (0, counts[0])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")).collect()
    check_packing(got, counts, 4096)
    # at most so much above what the sum of lengths needs, and one container that is not full
    above = {"mixed": 1.01, "small": 1.0, "large": 1.08, "equal": 1.17, "zero": 1.0}[kind]
    assert len({r.container_id for r in got}) <= -(-sum(counts.values()) // 4096) * above + 1


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty).count() == 0 and packing.unused(packing.pack(empty)).first().containers == 0
    one = packing.pack_documents(docs(spark, [(1, None), (2, ""), (3, "a b c")]), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in one) == [(1, 0), (2, 0), (3, 3)]
    old, packing.RANKED = packing.RANKED, 100
    try:
        counts = {i: i % 7 for i in range(1000)}
        check_packing(packing.pack(spark.createDataFrame(list(counts.items()), "doc_id bigint, n_tokens bigint"), 64).collect(), counts, 64)
    finally:
        packing.RANKED = old


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n\n", "!\n"]) for _ in range(3000))
    return [prose, "x" * 30_000, "word " * 5000, "é" * 9000, "中文字符" * 3000, "😀" * 4000, "a\r\nb\r\n" * 4000, "\n" * 20_000, "no end of a line " * 1500, "short", ""]


@pytest.mark.parametrize("limit,overlap", [(512, 64), (4096, 64), (100, 0)])
def test_splitting(limit, overlap):
    enc = encoding()
    for t in texts():
        pieces = splitting.split_text(t, limit, overlap, enc)
        n = len(enc.encode_ordinary(t))
        assert (len(pieces) > 1) == (n > limit)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
        for s, e, k, _ in pieces:
            assert k == len(enc.encode_ordinary(t[s:e])) <= limit
        for (s, e, _, kind), (s2, e2, _, _) in zip(pieces, pieces[1:]):
            assert s < s2 <= e < e2
            if overlap and e > s2:
                assert len(enc.encode_ordinary(t[s2:e])) <= overlap * 2
            if kind in ("paragraph", "line", "sentence"):
                assert t[:e].rstrip() != t[:e] or t[e - 1] in ".!?"


def test_few_pieces_and_deepest_valley():
    enc = encoding()
    # natural boundaries only at the beginning: cuts go on
    assert len(splitting.split_text("One sentence. " * 300 + "x" * 40_000, 1000, 64, enc)) < 60
    topic = lambda w: " ".join(f"{w}{k % 7} {w}word{k % 5}" + ("." if k % 6 == 5 else "") for k in range(400))
    text = topic("alpha") + ". " + topic("bravo") + "."
    change = len(topic("alpha")) + 2
    tokens = len(enc.encode_ordinary(text[:change]))
    pieces = splitting.split_text(text, tokens + 300, 0, enc)
    assert pieces[0][1] == change and pieces[0][3] == "sentence"  # not the last sentence of the window, but where the topic changes


def test_documents(spark):
    rows = list(enumerate(texts())) + [(100, None), (None, "word " * 9000)]
    got = splitting.split_documents(docs(spark, rows), "doc_id", "text").collect()
    enc = encoding()
    assert {r.doc_id for r in got} == {i for i, t in rows if i is not None and t and len(enc.encode_ordinary(t)) > 4096}
    assert splitting.split_documents(docs(spark, []), "doc_id", "text").count() == 0
