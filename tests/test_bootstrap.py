"""The bootstrap loop against a plain one."""

import random

import numpy as np
import pytest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.config import Config, load_config, parse_config
from relweave.functions.vectors import dot
from relweave.operators import clustering, matching, scoring
from relweave.plans.bootstrap import bootstrap


class Plain:
    """Lists and sets only."""

    def __init__(self, tuples, pos, neg, c):
        self.t, self.seeds, self.neg, self.c = tuples, set(pos), set(neg), c
        self.patterns, self.cand = [], {}

    def vote(self, x, p):
        s = [float(np.dot(x, m)) for m in p["m"].values()]
        good = sum(v >= self.c.similarity for v in s)
        return (True, max([*s, 0.0])) if good >= len(s) - good else (False, 0.0)

    def run(self):
        c = self.c
        for turn in range(c.iterations + 1):
            matched = [t for t in self.t if (t["ent1"], t["ent2"]) in self.seeds]
            if not matched:
                return {}
            if not self.patterns:
                self.patterns.append(self.new(matched[0]))
            for t in matched:
                best, top = 0, 0.0
                for i, p in enumerate(self.patterns):
                    ok, s = self.vote(t["x"], p)
                    if ok and s > top:
                        best, top = i, s
                if top < c.similarity:
                    self.patterns.append(self.new(t))
                else:
                    self.patterns[best]["m"].setdefault(t["tuple_key"], t["x"])
            self.patterns = [p for p in self.patterns if len(p["m"]) >= c.min_pattern_support]
            if not self.patterns and turn == 0:
                return {}
            pairs, firsts = {(a.strip(), b.strip()) for a, b in self.seeds}, {a.strip() for a, _ in self.seeds}
            negs = {(a.strip(), b.strip()) for a, b in self.neg}
            for t in self.t:
                best, top = None, 0.0
                pair = (t["ent1"].strip(), t["ent2"].strip())
                for i, p in enumerate(self.patterns):
                    ok, s = self.vote(t["x"], p)
                    if ok:
                        if pair in pairs:
                            p["p"] += 1
                        else:
                            kin, bad = pair[0] in firsts, pair in negs
                            p["n"] += kin + bad
                            p["u"] += not kin and not bad
                        if s > top:
                            best, top = p, s
                if top >= c.similarity:
                    self.cand.setdefault(t["tuple_key"], (t, []))
                    have = self.cand[t["tuple_key"]][1]
                    if all(q is not best for q, _ in have):
                        have.append((best, top))
            for p in self.patterns:
                p["c"] = p["p"] / (p["p"] + p["u"] * c.unknown_weight + p["n"] * c.negative_weight) if p["p"] else 0
            out = {}
            for k, (t, have) in self.cand.items():
                rest = 1.0
                for q, s in have:
                    rest *= 1 - q["c"] * s
                out[k] = 1 - rest
                if out[k] >= c.confidence:
                    self.seeds.add((t["ent1"], t["ent2"]))
        return out

    @staticmethod
    def new(t):
        return {"m": {t["tuple_key"]: t["x"]}, "p": 0, "n": 0, "u": 0, "c": 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_loop(spark, seed):
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(4, 6))
    rows = []
    for i in range(60):
        x = centres[rng.randrange(4)] + gen.normal(scale=0.35, size=6) if rng.random() > 0.05 else np.zeros(6)
        n = np.linalg.norm(x)
        e = (f"o{rng.randrange(12)}" + rng.choice(["", "", " "]), f"l{rng.randrange(8)}")
        rows.append({"tuple_ord": i * 3, "tuple_key": f"{e}{rng.randrange(4)}", "ent1": e[0], "ent2": e[1], "x": (x / n if n else x).tolist(), "sentence": f"s{i}", "bef_words": "", "bet_words": "w", "aft_words": "", "passive_voice": False})
    pos = [(r["ent1"], r["ent2"]) for r in rng.sample(rows, 8)]
    neg = [(r["ent1"].strip(), r["ent2"]) for r in rng.sample(rows, 6)]
    c = Config(similarity=0.7, confidence=0.6, min_pattern_support=2, unknown_weight=0.1, iterations=2)
    want = Plain(rows, pos, neg, c).run()
    schema = "tuple_ord bigint, tuple_key string, ent1 string, ent2 string, x array<double>, sentence string, bef_words string, bet_words string, aft_words string, passive_voice boolean"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    res = bootstrap(df, spark.createDataFrame(pos, "ent1 string, ent2 string"), spark.createDataFrame(neg, "ent1 string, ent2 string"), c)
    got = [r.confidence for r in res.relations.collect()]
    assert res.status == "done" and len(got) == len(want)
    assert np.allclose(sorted(got), sorted(want.values()), atol=1e-9) and got == sorted(got, reverse=True)


def test_no_matches(spark):
    schema = "tuple_ord bigint, tuple_key string, ent1 string, ent2 string, x array<double>, sentence string, bef_words string, bet_words string, aft_words string, passive_voice boolean"
    df = spark.createDataFrame([(1, "k", "a", "b", [1.0], "s", "", "", "", False)], schema)
    none = spark.createDataFrame([], "ent1 string, ent2 string")
    res = bootstrap(df, none, none)
    assert res.status == "no seed matches" and res.relations.count() == 0
    one = spark.createDataFrame([("a", "b")], "ent1 string, ent2 string")
    assert bootstrap(df, one, none).status == "no patterns"


def vec(*x):
    n = np.linalg.norm(x)
    return (np.array(x) / n).tolist() if n else list(x)


def test_clustering_order(spark):
    t1, t2, t3, z = vec(1.0, 0.0), vec(1.0, 1.0), vec(0.0, 1.0), [0.0, 0.0]

    def run(order):
        df = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(order)], "tuple_ord bigint, tuple_key string, x array<double>")
        out = {}
        for r in clustering.cluster_pass(df, None, 0.6).collect():
            out.setdefault(r.pattern_id, set()).add(r.tuple_key)
        return sorted(map(sorted, out.values()))

    assert run([("1", t1), ("2", t2), ("3", t3)]) == [["1", "2", "3"]]
    assert run([("1", t1), ("3", t3), ("2", t2)]) == [["1", "2"], ["3"]]
    assert run([("z", z)]) == [["z"], ["z"]]


def votes(tuples: DataFrame, members: DataFrame, threshold: float, key: str = "tuple_ord") -> DataFrame:
    """(key, pattern_id, good, bad, accepted, score) for all tuples and patterns, as relational operators.

    A pattern accepts a tuple if at least as many members are similar to it as not; the score is the highest similarity, at least 0,
    and 0 if it does not accept. Members are the query set; this form is for reading and for checking match().
    """
    m = members.select("pattern_id", F.col("x").alias("__y"))
    sims = tuples.select(key, "x").crossJoin(m).select(key, "pattern_id", dot(F.col("x"), F.col("__y")).alias("s"))
    good = F.sum((F.col("s") >= threshold).cast("bigint"))
    v = sims.groupBy(key, "pattern_id").agg(good.alias("good"), (F.count(F.lit(1)) - good).alias("bad"), F.greatest(F.max("s"), F.lit(0.0)).alias("top"))
    ok = F.col("good") >= F.col("bad")
    return v.select(key, "pattern_id", "good", "bad", ok.alias("accepted"), F.when(ok, F.col("top")).otherwise(0.0).alias("score"))


def test_votes(spark):
    tuples = spark.createDataFrame([(1, [1.0, 0.0])], "tuple_ord bigint, x array<double>")
    members = spark.createDataFrame([(0, [0.7, 0.0]), (0, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.5, 0.0]), (1, [0.4, 0.0])], "pattern_id bigint, x array<double>")
    v = {r.pattern_id: (r.accepted, round(r.score, 6)) for r in votes(tuples, members, 0.6).collect()}
    assert v == {0: (True, 0.7), 1: (False, 0.0)}
    assert [tuple(r) for r in matching.match(tuples, members, 0.6).collect()] == [(1, 0, 0.7)]
    assert matching.match(tuples, members.limit(0), 0.6).count() == 0
    old, matching.SENT = matching.SENT, 8
    try:
        assert matching.match(tuples, members, 0.6).count() == 1  # in blocks
    finally:
        matching.SENT = old


def test_selectivity_and_confidence(spark):
    pos = spark.createDataFrame([("A", "X"), ("C", "Y")], "ent1 string, ent2 string")
    neg = spark.createDataFrame([("A", "Z"), ("D", "W")], "ent1 string, ent2 string")
    t = spark.createDataFrame([(1, "A ", " X"), (2, "A", "Q"), (3, "A", "Z"), (4, "D", "W"), (5, "E", "V"), (6, None, "V")], "tuple_ord bigint, ent1 string, ent2 string")
    got = {r.tuple_ord: (r.pos, r.neg, r.unk) for r in scoring.selectivity_classes(t, pos, neg).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 2, 0), 4: (0, 1, 0), 5: (0, 0, 1), 6: (0, 0, 1)}
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(3, 1, 2), (0, 1, 1)], "p bigint, n bigint, u bigint").select(scoring.pattern_confidence(F.col("p"), F.col("n"), F.col("u"), 2.0, 0.1)).collect()
    assert abs(p[0][0] - 3 / 5.2) < 1e-12 and p[1][0] == 0
    ev = spark.createDataFrame([("k", 0, 0.8), ("k", 1, 0.6)], "tuple_key string, pattern_id bigint, sim double")
    pat = spark.createDataFrame([(0, 0.5), (1, 0.25)], "pattern_id bigint, confidence double")
    assert abs(scoring.tuple_confidence(ev, pat).first().confidence - 0.49) < 1e-12


def test_config(tmp_path):
    assert Config().iterations == 2 and load_config(None).beta == 1.0
    c = parse_config("# c\nalpha=0.2 # left\nbeta=0.6\ngamma=0.2\nwUnk=0.1\nmin_pattern_support=2\n\n", iterations=4)
    assert (c.alpha, c.unknown_weight, c.min_pattern_support, c.iterations, c.max_tokens_away) == (0.2, 0.1, 2, 4, 6)
    for bad in ("alpha=0.5", "nothing", "similarity=0"):
        with pytest.raises(ValueError):
            parse_config(bad)
    assert "similarity" in c.report()


def test_best_and_counts_in_blocks_and_parts(spark, monkeypatch):
    g = np.random.default_rng(3)
    xs = g.normal(size=(60, 8))
    xs /= np.linalg.norm(xs, axis=1, keepdims=True)
    rows = [(i, x.tolist(), int(i % 3 == 0), int(i % 3 == 1), int(i % 3 == 2)) for i, x in enumerate(xs)]
    tuples = spark.createDataFrame(rows, "tuple_ord bigint, x array<double>, pos bigint, neg bigint, unk bigint")
    size = [30, 5, 1, 8, 2]
    members = spark.createDataFrame([(p, f"k{p}{k}", g.normal(size=8).tolist()) for p, n in enumerate(size) for k in range(n)], "pattern_id bigint, tuple_key string, x array<double>")
    voted = votes(tuples, members, 0.1).where("accepted").collect()
    best, counts = {}, {}
    for r in sorted(voted, key=lambda r: (-r.score, r.pattern_id)):
        if r.score > 0:
            best.setdefault(r.tuple_ord, (r.pattern_id, round(r.score, 6)))
        c = counts.setdefault(r.pattern_id, [0, 0, 0])
        c[r.tuple_ord % 3] += 1
    for sent in (matching.SENT, 600, 100):  # all at once, in blocks, and with the largest pattern in parts
        monkeypatch.setattr(matching, "SENT", sent)
        b, n = matching.best_and_counts(tuples, members, 0.1)
        assert {r.tuple_ord: (r.pattern_id, round(r.score, 6)) for r in b.collect()} == best
        assert {r.pattern_id: [r.positive, r.negative, r.unknown] for r in n.collect() if r.positive + r.negative + r.unknown} == counts
        hits = {(r.tuple_ord, r.pattern_id, round(r.score, 6)) for r in matching.match(tuples, members, 0.1).collect()}
        assert hits == {(r.tuple_ord, r.pattern_id, round(r.score, 6)) for r in voted}


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_is_matched_in_little_memory(spark, monkeypatch):
    # best_pattern, pattern_vote and what is made from them: a batch of 10,000 tuples against 6,000 members had all 60 million similarities at once
    g = np.random.default_rng(7)
    x, y, ids = g.normal(size=(10_000, 8)), g.normal(size=(6_000, 8)), np.arange(6_000) % 700
    total = []

    class Here:  # a broadcast without executors
        def __init__(self, m):
            self.value = m

    monkeypatch.setattr(matching, "_sent", lambda block, n=None: Here(matching.Members(*block, n)))
    for whole, parts in (([(ids, y)], []), ([], [(6_000, [(np.zeros(3_000, int), y[:3_000]), (np.zeros(3_000, int), y[3_000:])])])):
        patterns = matching.Patterns(whole, parts)
        found = []
        assert peak_mb(lambda: found.extend(len(i) for i, _, _ in patterns.accepted(x, 1.0))) < 100
        total.append(sum(found))
    s = x[:200] @ y.T
    want = {(i, int(p)) for p in range(700) for i in np.flatnonzero(2 * (s[:, ids == p] >= 1.0).sum(1) >= (ids == p).sum())}
    got = {(int(i), int(p)) for b in matching.Members(ids, y).accepted(x[:200], 1.0) for i, p in zip(b[0], b[1])}
    assert got == want and total[0]


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e30])
def test_odd_vectors_are_matched_exactly(odd):
    g = np.random.default_rng(9)
    x, y, ids = g.normal(size=(40, 6)), g.normal(size=(90, 6)), np.arange(90) % 11
    x[3, 2], y[5, 1] = odd, odd
    with np.errstate(all="ignore"):
        s = x @ y.T
        want = {(i, p) for p in range(11) for i in range(40) if 2 * (s[i, ids == p] >= 0.2).sum() >= (ids == p).sum()}
        got = {(int(i), int(p)) for b in matching.Members(ids, y).accepted(x, 0.2) for i, p in zip(b[0], b[1])}
    assert got == want and len(got) > 50


def test_a_fold_compares_blocks(monkeypatch):
    # single_pass_cluster: a product for each tuple read all members again
    g = np.random.default_rng(4)
    x = np.repeat(g.normal(size=(60, 6)), 5, 0) + g.normal(scale=0.5, size=(300, 6))
    x = np.concatenate([np.zeros((1, 6)), x / np.linalg.norm(x, axis=1, keepdims=True)])[g.permutation(301)]
    keys = [f"k{i % 250}" for i in range(301)]
    want, cl = [], []  # clusters of (key, vector)
    for i, (k, v) in enumerate(zip(keys, x)):
        if not cl:
            cl.append({k: v})
            want.append((i, 0))
        score = []
        for c in cl:
            s = [float(np.dot(m, v)) for m in c.values()]
            score.append(max(s) if 2 * sum(t >= 0.6 for t in s) >= len(s) else 0.0)
        best = int(np.argmax(score))
        if score[best] < 0.6:
            cl.append({})
            best = len(cl) - 1
        if k not in cl[best]:
            cl[best][k] = v
            want.append((i, best))
    for block, piece in ((512, 8192), (7, 16), (1, 1)):
        monkeypatch.setattr(clustering, "BLOCK", block)
        monkeypatch.setattr(clustering, "PIECE", piece)
        calls, real = [], clustering.similar
        monkeypatch.setattr(clustering, "similar", lambda *a: calls.append(1) or real(*a))
        state = clustering.Clusters(0.6)
        got = state.add(keys[:100], x[:100]) + [(i + 100, p) for i, p in state.add(keys[100:], x[100:])]
        assert got == want and len(set(p for _, p in got)) > 20
        assert block < 512 or len(calls) == 1
        monkeypatch.setattr(clustering, "similar", real)
