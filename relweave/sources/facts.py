"""Knowledge bases, extracted facts and the files that results are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.text import strip
from relweave.operators import evaluation as E
from relweave.operators import kb as K

OUTPUT_SCHEMA = "entity_1 string, entity_2 string, confidence double, sentence string, bef_words string, bet_words string, aft_words string, passive_voice boolean"


def _columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated text without quoting; lines starting with # are left out, others must have that many columns."""
    schema = ", ".join(f"{n} string" for n in names)
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="", mode="FAILFAST")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(e1, r, e2) of three-column files; another number of columns is an error."""
    d = _columns(spark, path, ["e1", "r", "e2"])
    return d.select(*[strip(F.col(c)).alias(c) for c in d.columns])


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """(e1, r, e2) of four-column files, cleaned and narrowed to the kept relations."""
    d = _columns(spark, path, ["e1", "r", "e2", "point"])
    return K.clean_listed_facts(d.select(*[strip(F.col(c)).alias(c) for c in ("e1", "r", "e2")]))


def parse_ntriples(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(e1, r, e2) of lines of four fields parted by white space, as local names without bracketed notes; others are left out."""
    v = strip(F.col(line))
    f = F.split(v, r"\s+")
    rows = lines.select(*(keep or []), v.alias("v"), f.alias("f")).where(~F.col("v").startswith("#") & (F.size("f") == 4))
    part = lambda i: K.without_brackets(K.local_name(F.get("f", F.lit(i))))
    return rows.select(*(keep or []), part(0).alias("e1"), part(1).alias("r"), part(2).alias("e2"))


def parse_yago(lines: DataFrame, line: str = "value") -> DataFrame:
    """(e1, r, e2) of three-column lines in angle brackets; of the third column only the first word."""
    v = F.col(line)
    rows = lines.where(~v.startswith("#")).select(F.split(v, "\t").alias("f")).where(F.size("f") == 3)
    bare = lambda c: strip(F.regexp_replace(c, "[<>]", ""))
    return rows.select(bare(F.get("f", F.lit(0))).alias("e1"), bare(F.get("f", F.lit(1))).alias("r"), bare(F.get(F.split(F.get("f", F.lit(2)), " "), F.lit(0))).alias("e2"))


def read_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(entity): distinct names of a folder of knowledge bases, each read by what its file name begins with: dbpedia_, freebase_ or yago_."""
    lines = lambda glob: spark.read.option("pathGlobFilter", glob).text(folder)
    three = lines("freebase_*").where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") == 3)
    three = three.select(strip(F.get("f", F.lit(0))).alias("e1"), strip(F.get("f", F.lit(2))).alias("e2"))
    every = parse_ntriples(lines("dbpedia_*")).select("e1", "e2").unionByName(three).unionByName(parse_yago(lines("yago_*")).select("e1", "e2"))
    return K.known_entities(every)


def read_acronyms(spark: SparkSession, path: str) -> DataFrame:
    """(acronym, expansions) of tab-separated lines: the first and the last column."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 2)
    return K.acronym_map(rows.select(F.get("f", F.lit(0)).alias("acronym"), F.element_at("f", -1).alias("expansion")))


def _after(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return strip(found)


_HEAD = r"(?m)^instance:[ ]*([^\t\n]*)\t(.*?)[ \t]*score:[ ]*([-+0-9.eE]+)[ \t]*$"


def block_columns(b: Column) -> dict[str, Column]:
    """The fields of a block; one that it lacks is empty."""
    return {
        "ent1": strip(F.regexp_extract(b, _HEAD, 1)), "ent2": strip(F.regexp_extract(b, _HEAD, 2)), "score": F.regexp_extract(b, _HEAD, 3).try_cast("double"),
        "sentence": _after(b, "sentence"), "bef_words": _after(b, "pattern_bef"), "bet_words": _after(b, "pattern_bet"), "aft_words": _after(b, "pattern_aft"),
        "passive_voice": _after(b, "passive voice") == "True",
    }


def parse_blocks(blocks: DataFrame, block: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Facts of text blocks: instance: e1, tab, e2 score:x, and lines sentence, pattern_bef, pattern_bet, pattern_aft, passive voice.

    A block without an instance is left out. keep names columns to take over.
    """
    return blocks.where(F.col(block).rlike(_HEAD)).select(*(keep or []), *[c.alias(n) for n, c in block_columns(F.col(block)).items()])


def read_blocks(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """parse_blocks of files, facts of at least the threshold."""
    return parse_blocks(spark.read.option("lineSep", "\n\n").text(path)).where(F.col("score") >= threshold)


def read_relations(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """The same facts of relations in JSON lines."""
    d = spark.read.schema(OUTPUT_SCHEMA).json(path)
    d = d.select(F.col("entity_1").alias("ent1"), F.col("entity_2").alias("ent2"), F.col("confidence").alias("score"), "sentence", "bef_words", "bet_words", "aft_words", "passive_voice")
    return d.where(F.col("score") >= threshold)


def write_relations(df: DataFrame, path: str) -> None:
    """Relations as JSON lines, best first over the part files in their order, with empty fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_triples(df: DataFrame, path: str) -> None:
    """e1, r, e2 tab-separated, one line for each fact."""
    df.select(F.concat_ws("\t", "e1", "r", "e2").alias("value")).write.mode("overwrite").text(path)


def write_sentences(df: DataFrame, selected: str, discarded: str) -> None:
    """Distinct sentences (sentence, selected) in two places."""
    df.where("selected").select("sentence").distinct().write.mode("overwrite").text(selected)
    df.where("not selected").select("sentence").distinct().write.mode("overwrite").text(discarded)


def write_report(facts: DataFrame, path: str) -> None:
    """Facts, highest score first."""
    facts.orderBy(F.col("score").desc(), "ent1", "ent2").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_index(sentences: DataFrame, relations: DataFrame, path: str, buckets: int | None = None) -> None:
    """Positions of the tagged entities of the eligible sentences (see operators.evaluation), laid out by term: files of one range of terms lie together,
    so a search reads few row groups. sentences: sent_id, sentence; relations: sent_id, between. buckets: files, else as many as adaptive execution makes."""
    held = sentences.join(E.eligible_sentences(relations).select("sent_id"), "sent_id", "left_semi")
    positions = E.entity_positions(held)
    laid = positions.repartitionByRange(buckets, "term") if buckets else positions.repartitionByRange("term")
    laid.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Positions as write_index left them; a filter on terms reaches the files."""
    return spark.read.parquet(path)
