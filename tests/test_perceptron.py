import random

from pyspark.sql import functions as F

from relweave.functions import perceptron, tagging


def corpus(n, seed):
    """Sentences of a small grammar in which plans and names are nouns or verbs by what stands beside them, and endings tell new words."""
    rng = random.Random(seed)
    new = lambda end: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) + end
    out = []
    for _ in range(n):
        noun = lambda: (rng.choice(["plans", "names", "firm", "bank", new("ness"), new("tion")]), "NN")
        verb = lambda: (rng.choice(["plans", "names", "buys", new("ises")]), "VBZ")
        s = [("the", "DT"), *([(new("ous"), "JJ")] if rng.random() < 0.5 else []), noun(), *([(new("ly"), "RB")] if rng.random() < 0.3 else []), verb(), ("the", "DT"), noun(), (".", ".")]
        out.append(s)
    return out


def test_held_out_accuracy_and_files(spark, tmp_path):
    model = perceptron.train(corpus(400, 1))
    hit = total = 0
    for s in corpus(200, 2):
        got = model([w for w, _ in s])
        hit, total = hit + sum(g == t for g, (_, t) in zip(got, s)), total + len(s)
    assert hit / total > 0.97
    path = str(tmp_path / "m" / "tagger.json")
    model.save(path)
    words = [[w for w, _ in s] for s in corpus(30, 3)] + [[], None, ["x" * 5000]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t array<string>")
    got = {r.i: r.g for r in df.select("i", tagging.pos_tags(F.col("t"), perceptron.tagger(path)).alias("g")).collect()}
    assert all(got[i] == (None if w is None else model(w)) for i, w in enumerate(words))


def test_nothing_to_train_on():
    assert perceptron.train([]).tags == []
