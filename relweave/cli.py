"""Command line: bootstraps relations from tagged sentences, or from a tuple store that an earlier run wrote."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from relweave.config import load_config
from relweave.functions import perceptron
from relweave.functions.tagging import rule_tags
from relweave.operators.matching import matched_seeds
from relweave.plans.bootstrap import bootstrap, prepare
from relweave.session import get_spark, materialize, release, timed
from relweave.sources import corpus, facts

#: Lines of each report on the console.
REPORTED = 100


def arguments() -> argparse.ArgumentParser:
    """The options."""
    p = argparse.ArgumentParser(prog="relweave", description=__doc__)
    p.add_argument("--config", help="file of key=value lines")
    p.add_argument("--word2vec", help="binary word2vec file, or Parquet (word, vec)")
    p.add_argument("--sentences", help="text file of tagged sentences")
    p.add_argument("--stored", help="in place of sentences: a tuple store that --tuples wrote")
    p.add_argument("--positive_seeds", help="file of ent1;ent2 lines with e1: and e2: headers")
    p.add_argument("--negative_seeds", help="the same for wrong pairs")
    p.add_argument("--similarity", type=float, help="threshold of similarity to a pattern (0.6)")
    p.add_argument("--confidence", type=float, help="threshold of confidence to become a seed (0.6)")
    p.add_argument("--iterations", "--number_iterations", dest="iterations", type=int, help="further passes after the first (2)")
    p.add_argument("--output", default="relations", help="folder for the relations as JSON lines")
    p.add_argument("--tagger", help="weights of a trained tagger (functions.perceptron); by rule otherwise")
    p.add_argument("--tuples", help="folder to keep the tuple store in")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 if arguments are missing. Prints the parameters and the figures of each pass."""
    parser = arguments()
    argv = sys.argv[1:] if argv is None else argv
    a = parser.parse_args(argv)
    if not ((a.sentences or a.stored) and a.positive_seeds):
        parser.print_help()
        return 1
    spark = get_spark()
    positive, types = corpus.read_seeds(spark, a.positive_seeds)
    kinds = types.first().asDict()
    negative = corpus.read_seeds(spark, a.negative_seeds)[0] if a.negative_seeds else positive.limit(0)
    given = {k: getattr(a, k) for k in ("similarity", "confidence", "iterations")}
    config = load_config(a.config, **given, **kinds, word2vec_path=a.word2vec)
    print(config.report())
    if a.stored:
        tuples = corpus.read_tuples(spark, a.stored)
    else:
        source = config.word2vec_path
        vectors = spark.read.parquet(source) if source.endswith(".parquet") else materialize(corpus.read_word2vec(spark, source), "embeddings")
        head = vectors.select("vec").first()
        tuples = prepare(corpus.read_sentences(spark, a.sentences), vectors, len(head.vec) if head else 1, config, perceptron.tagger(a.tagger) if a.tagger else rule_tags)
        if a.tuples:
            corpus.write_tuples(tuples, a.tuples)
            tuples = corpus.read_tuples(spark, a.tuples)
    result = timed(bootstrap)(tuples, positive, negative, config)
    print("seed matches")
    for r in matched_seeds(tuples, positive).limit(REPORTED).collect():
        print(f"{r.ent1}\t{r.ent2}\t{r.matches}")
    for row in result.passes:
        print(", ".join(f"{k} {v}" for k, v in row.items()))
    if result.patterns is not None:
        print("patterns")
        for r in result.patterns.orderBy(F.col("confidence").desc(), "pattern_id").limit(REPORTED).collect():
            print(f"{r.pattern_id}\tpositive {r.positive}, negative {r.negative}, unknown {r.unknown}\t{r.confidence:.4f}")
    print(result.status)
    facts.write_relations(result.relations, a.output)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
