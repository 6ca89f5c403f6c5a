"""Queries that write a table in one of the file formats and read it back, and equivalent SQL over the table; and matching on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.config import load_config
from relweave.functions import text as T
from relweave.operators import evaluation as E
from relweave.operators import kb as K
from relweave.plans import relation_queries as R
from relweave.plans.relation_queries import Spark, query
from relweave.plans.tables import table
from relweave.session import materialize, scratch_dir
from relweave.sources import corpus as C
from relweave.sources import facts as S
from relweave.sources import files
from relweave.streaming import extract as streaming

_strip = R._stripped


def _folder(spark: Spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{scratch_dir(spark)}/relweave-{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, path: str, *columns) -> str:
    df.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return path


@query(f"with {R.SENT} select {_strip('sentence')} as sentence, count(*) as lines from sent group by 1")
def sentence_file(spark: Spark, d: str) -> DataFrame:
    path = _text(R.sentences(spark, d), _folder(spark, "sentences"), "sentence")
    return C.read_sentences(spark, path).groupBy("sentence").agg(F.count(F.lit(1)).alias("lines"))


@query(f"with {R.STORED} select tuple_ord, ent1, ent2, bet_words from st")
def tuple_store(spark: Spark, d: str) -> DataFrame:
    path = _folder(spark, "store")
    C.write_tuples(R.stored(spark, d), path)
    return C.read_tuples(spark, path).select("tuple_ord", "ent1", "ent2", "bet_words")


@query(f"with {R.FACTS} select ent1, ent2, round(confidence, 6) as score, sentence, bef_words, bet_words, aft_words, passive_voice, count(*) as n from facts where confidence >= 0.5 and not isnan(confidence) group by all")
def relations_file(spark: Spark, d: str) -> DataFrame:
    path = _folder(spark, "relations")
    facts = R.extracted(spark, d).where(~F.isnan("confidence"))  # JSON has no such number
    S.write_relations(facts.select(F.col("ent1").alias("entity_1"), F.col("ent2").alias("entity_2"), "confidence", "sentence", "bef_words", "bet_words", "aft_words", "passive_voice"), path)
    got = S.read_relations(spark, path, 0.5).withColumn("score", F.round("score", 6))
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n"))


_FULL = "e1 is not null and r is not null and e2 is not null"


@query(f"select {_strip('e1')} as e1, {_strip('r')} as r, {_strip('e2')} as e2, count(*) as n from kb where {_FULL} group by all")
def triples_file(spark: Spark, d: str) -> DataFrame:
    path = _folder(spark, "triples")
    S.write_triples(table(spark, d, "kb").where(_FULL), path)
    return S.read_triples(spark, path).groupBy("e1", "r", "e2").agg(F.count(F.lit(1)).alias("n"))


@query(R.ORACLE["kb_clean_listed"].replace("select kb_id,", "select", 1).replace("from kb where", ", count(*) as n from kb where r is not null and", 1) + " group by all")
def listed_file(spark: Spark, d: str) -> DataFrame:
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R._LISTED.items() for x in kv]), "r"), "r")
    path = _text(table(spark, d, "kb").where(_FULL), _folder(spark, "listed"), "e1", named, "e2", F.lit("."))
    return S.read_listed(spark, path).groupBy("e1", "r", "e2").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with k as (select {_strip('e1')} as e1, {_strip('e2')} as e2, {R._bare('e1')} as b1, {R._bare('e2')} as b2 from kb where {_FULL})
select e1 as entity from k union select e2 from k union select b1 from k union select b2 from k union select split_part(e2, ' ', 1) from k""")
def entity_folder(spark: Spark, d: str) -> DataFrame:
    kb, base = table(spark, d, "kb").where(_FULL), _folder(spark, "kb")
    uri = lambda c, kind: F.concat(F.lit(f"<http://dbpedia.org/{kind}/"), F.regexp_replace(T.strip(F.col(c)), T.SPACE, "_"), F.lit(">"))
    angle = lambda c: F.concat(F.lit("<"), T.strip(F.col(c)), F.lit(">"))
    files.text_file(kb, f"{base}/dbpedia_a", F.concat_ws(" ", uri("e1", "resource"), uri("r", "ontology"), uri("e2", "resource"), F.lit(".")))
    files.text_file(kb, f"{base}/freebase_a", F.concat_ws("\t", "e1", "r", "e2"))
    files.text_file(kb, f"{base}/yago_a", F.concat_ws("\t", angle("e1"), angle("r"), angle("e2")))
    return S.read_entities(spark, base)


@query(R.ORACLE["acronym_map"])
def acronym_file(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "acronyms").where("acronym is not null and expansion is not null")
    path = _text(rows, _folder(spark, "acronyms"), "acronym", F.coalesce("note", F.lit("")), "expansion")
    return S.read_acronyms(spark, path).select("acronym", F.array_join("expansions", "; ").alias("expansions"))


@query(f"with picked as ({R.ORACLE['sentence_select']}), {R.SENT} select selected, {_strip('sentence')} as sentence from picked join sent using (sent_id) group by all")
def selected_files(spark: Spark, d: str) -> DataFrame:
    picked = E.selected_sentences(R.extracted(spark, d).select("sent_id", "ent1", "ent2", "between"), K.known_entities(table(spark, d, "kb")))
    rows = materialize(picked.join(R.sentences(spark, d), "sent_id").select("sentence", "selected"), "picked")
    yes, no = _folder(spark, "selected"), _folder(spark, "discarded")
    S.write_sentences(rows, yes, no)
    read = lambda path, value: C.read_sentences(spark, path).select(F.lit(value).alias("selected"), "sentence")
    return read(yes, True).unionByName(read(no, False)).distinct()


@query(f"with {R.FACTS} select ent1, ent2, round(max(confidence), 6) as score from facts where confidence between 0 and 1 and not isnan(confidence) group by all")
def report_file(spark: Spark, d: str) -> DataFrame:
    path = _folder(spark, "report")
    facts = R.extracted(spark, d).where(F.col("confidence").between(0, 1)).groupBy("ent1", "ent2").agg(F.max("confidence").alias("score"))
    S.write_report(facts, path)
    return spark.read.schema("ent1 string, ent2 string, score double").json(path).withColumn("score", F.round("score", 6))


@query("select 'w' || vec_id as word, len(embedding) as dim, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 4) as square from embeddings")
def word2vec_file(spark: Spark, d: str) -> DataFrame:
    path = f"{_folder(spark, 'word2vec')}/vectors.bin"
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec"))
    C.write_word2vec(path, ((r.word, r.vec) for r in rows.toLocalIterator()), rows.count())
    got = C.read_word2vec(spark, path)
    return got.select("word", F.size("vec").cast("bigint").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"))


_GIVEN = {"similarity": 0.7, "beta": 0.6, "alpha": 0.2, "gamma": 0.2, "wUnk": 0.1, "min_pattern_support": 2}


@query("select 0.7::double as similarity, 0.6::double as confidence, 0.2::double as alpha, 0.6::double as beta, 0.2::double as gamma, 0.1::double as unknown_weight, 2.0::double as negative_weight, 2 as min_pattern_support, 3 as iterations, 2 as context_window_size")
def parameter_file(spark: Spark, d: str) -> DataFrame:
    path = f"{_folder(spark, 'parameters')}/run.cfg"
    files.write_bytes(path, "# parameters\n\n" .encode() + "".join(f"{k}={v} # given\n" for k, v in _GIVEN.items()).encode())
    c = load_config(path, iterations=3)
    names = ["similarity", "confidence", "alpha", "beta", "gamma", "unknown_weight", "negative_weight", "min_pattern_support", "iterations", "context_window_size"]
    return spark.range(1).select(*[F.lit(getattr(c, n)).alias(n) for n in names])


@query(R.ORACLE["best_pattern"].replace("round(score, 4)", "round(score, 3)"))
def stream_match(spark: Spark, d: str) -> DataFrame:
    # the tuples come as a stream, the patterns are frozen
    path = _folder(spark, "arriving")
    C.write_tuples(R._named(spark, d).select("tuple_ord", "tuple_key", "ent1", *R.VECTORS), path)
    rows = C.read_tuples(spark, path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = streaming.drain(streaming.matches(R.with_x(stream), R.members(spark, d, rows), 0.3))
    return got.select("tuple_ord", "pattern_id", F.round("score", 3).alias("score"))


@query(f"with {R.PAIRS} select ent1, ent2, e1, round(jaro_winkler_similarity(upper(ent1), upper({R._ARG1})), 6) as winkler from pairs join k on ent2 = e2 where {R._jac('ent1', R._ARG1)} < 0.5 and jaro_winkler_similarity(upper(ent1), upper({R._ARG1})) >= 0.9")
def kb_jaro_winkler_first(spark: Spark, d: str) -> DataFrame:
    hits = K.fuzzy_matches(R._pairs(spark, d), table(spark, d, "kb"), "arg1", True)
    return hits.where("winkler is not null").select("ent1", "ent2", "e1", F.round("winkler", 6).alias("winkler"))


_EDITED = "pairs as (select distinct e1 as ent1, substr(e2, 1, 2) || substr(e2, 2) as ent2 from kb where e1 is not null and e2 is not null), k as (select distinct e1, e2 from kb where e1 is not null and e2 is not null)"


@query(f"with {_EDITED} select ent1, ent2, e2, round(jaro_winkler_similarity(upper(ent2), upper({R._ARG2})), 6) as winkler from pairs join k on ent1 = e1 where {R._jac('ent2', R._ARG2)} < 0.5 and jaro_winkler_similarity(upper(ent2), upper({R._ARG2})) >= 0.9")
def kb_jaro_winkler_edited(spark: Spark, d: str) -> DataFrame:
    # facts whose second name is typed with a letter doubled
    kb = table(spark, d, "kb")
    typed = kb.where("e1 is not null and e2 is not null").select(F.col("e1").alias("ent1"), F.expr("substring(e2, 1, 2) || substring(e2, 2)").alias("ent2"))
    hits = K.fuzzy_matches(typed, kb, "arg2", True)
    return hits.where("winkler is not null").select("ent1", "ent2", "e2", F.round("winkler", 6).alias("winkler"))
