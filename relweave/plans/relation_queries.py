"""Queries of the extraction, bootstrap and evaluation operators over the relation tables, and equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.config import Config
from relweave.functions import relphrase
from relweave.functions import text as T
from relweave.functions import vectors as V
from relweave.functions.fuzzy import jaro_winkler_similarity, token_jaccard
from relweave.functions.stopwords import FILTER_TAGS, NOT_VALID, STOPWORDS
from relweave.functions.tagging import pos_tags, rule_tags_sql
from relweave.functions.tokenize import tokens, tokens_sql
from relweave.operators import clustering, extract, matching, scoring
from relweave.operators import evaluation as E
from relweave.operators import kb as K
from relweave.plans import bootstrap as B
from relweave.plans import bootstrap_sql as BS
from relweave.plans.evaluate import evaluate
from relweave.plans.tables import table
from relweave.session import materialize, scratch_dir
from relweave.sources import corpus as C
from relweave.sources import facts as S
from relweave.streaming import extract as streaming

Spark = SparkSession
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VECTORS = {"bef_vector": 0.2, "bet_vector": 0.6, "aft_vector": 0.2}
DIM = 64


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- what the queries start from

SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
SENT = "sent as (select sent_id, max(sentence) as sentence from relationships where sentence is not null group by sent_id)"
REL = "rel as (select * from (select *, row_number() over (partition by rel_id order by ingested_at) as rn from relationships) where rn = 1)"


def _pieces(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{SPACE}+'), lambda x: x <> '')"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def sentences(spark: Spark, d: str) -> DataFrame:
    """Each sentence once."""
    return table(spark, d, "relationships").where("sentence is not null").groupBy("sent_id").agg(F.max("sentence").alias("sentence"))


def records(spark: Spark, d: str) -> DataFrame:
    """Relations; of those delivered again the copy that came first."""
    rows = table(spark, d, "relationships")
    late = F.to_timestamp(F.lit("9999-12-31"))
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "rel_id"]), F.coalesce(F.col("ingested_at").cast("timestamp"), late))
    return rows.groupBy("rel_id").agg(first.alias("__r")).select("rel_id", "__r.*")


def extracted(spark: Spark, d: str) -> DataFrame:
    """Relations as facts with their contexts as tokens."""
    cols = [F.col("entity_1").alias("ent1"), F.col("entity_2").alias("ent2")]
    parts = [T.pieces(F.col(f"{a}_words")).alias(b) for a, b in (("bef", "before"), ("bet", "between"), ("aft", "after"))]
    rows = records(spark, d).select("rel_id", "sent_id", "pos", *cols, "e1_type", "e2_type", "confidence", "sentence", "bef_words", "bet_words", "aft_words", "passive_voice", *parts)
    return rows.where(T.holds_name(F.col("ent1")) & T.holds_name(F.col("ent2")))


_BARE = "regexp_replace(lower(trim(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'))), '^[\\[(<{{ ]+|[\\])>}} ]+$', '', 'g')"
_HOLDS = "coalesce(" + _BARE + " not in " + _in(T.NO_NAME).replace("{", "{{") + " and regexp_matches(" + _BARE + ", '[\\p{{L}}\\p{{N}}]'), false)"
FACTS = f"""{REL}, facts as (select rel_id, sent_id, pos, entity_1 as ent1, entity_2 as ent2, e1_type, e2_type, confidence, sentence, bef_words, bet_words, aft_words, passive_voice,
  {_pieces("bef_words")} as before, {_pieces("bet_words")} as between_, {_pieces("aft_words")} as after_
  from rel where {_HOLDS.format(c="entity_1")} and {_HOLDS.format(c="entity_2")})"""

# ---- tagged sentences

ENTITY = "<([A-Z]+)>([^<]+)</[A-Z]+>"


@query(f"""with {SENT} select sent_id, nth, s[nth] as surface, t[nth] as etype from (
  select sent_id, s, t, unnest(range(1, len(s) + 1)) as nth from (
    select sent_id, regexp_extract_all(sentence, '{ENTITY}', 2) as s, regexp_extract_all(sentence, '{ENTITY}', 1) as t from sent))""")
def entity_extract(spark: Spark, d: str) -> DataFrame:
    return sentences(spark, d).select("sent_id", F.posexplode(extract.entities(F.col("sentence"))).alias("nth", "e")).select("sent_id", (F.col("nth") + 1).cast("bigint").alias("nth"), "e.surface", "e.etype")


@query(f"with {SENT} select sent_id, regexp_replace(sentence, '</?[A-Z]+>', '', 'g') as plain from sent")
def untag_text(spark: Spark, d: str) -> DataFrame:
    return sentences(spark, d).select("sent_id", extract.untagged(F.col("sentence")).alias("plain"))


_TOKS = tokens_sql("regexp_replace(sentence, '</?[A-Z]+>', '', 'g')")


@query(f"with {SENT} select sent_id, len(t) as n, array_to_string(t, ' ') as toks from (select sent_id, {_TOKS} as t from sent)")
def treebank_tokens(spark: Spark, d: str) -> DataFrame:
    t = sentences(spark, d).select("sent_id", tokens(extract.untagged(F.col("sentence"))).alias("t"))
    return t.select("sent_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("toks"))


LOCATED = f"""{SENT}, tk as (select sent_id, sentence, {_TOKS} as toks from sent where len(regexp_extract_all(sentence, '{ENTITY}')) >= 2),
ent0 as (select sent_id, toks, regexp_extract_all(sentence, '{ENTITY}', 2) as ss, regexp_extract_all(sentence, '{ENTITY}', 1) as ts from tk),
ent1 as (select sent_id, toks, ss[nth] as surface, ts[nth] as etype, nth from (select *, unnest(range(1, len(ss) + 1)) as nth from ent0)),
ent2 as (select sent_id, surface, etype, any_value(toks) as toks, min(nth) as nth from ent1 group by sent_id, surface, etype),
ent3 as (select *, {tokens_sql("surface")} as p0 from ent2),
ent4 as (select sent_id, surface, etype, toks, nth, case when len(p0) >= 2 and p0[-1] = '.' then list_concat(p0[1:len(p0) - 2], [p0[-2] || '.']) else p0 end as parts from ent3),
hit as (select *, len(parts) as k, unnest(list_filter(range(1, len(toks) - len(parts) + 2), lambda i: toks[i:i + len(parts) - 1] = parts)) as start from ent4 where len(parts) > 0),
loc as (select * from (select *, row_number() over (partition by sent_id, start order by k desc, nth) as best from hit) where best = 1)"""


@query(f"with {LOCATED} select sent_id, start, surface, etype, k as parts from loc")
def entity_positions(spark: Spark, d: str) -> DataFrame:
    rows = extract.locate(sentences(spark, d)).select("sent_id", F.explode("locs").alias("l"))
    return rows.select("sent_id", F.col("l.start").cast("bigint").alias("start"), "l.surface", "l.etype", (-F.col("l.longest")).cast("bigint").alias("parts"))


_VALID = f"len(list_filter(between_, lambda x: x not in {_in(NOT_VALID)})) > 0"
PAIRED = f"""{LOCATED}, nxt as (select sent_id, toks, row_number() over w - 1 as pos, surface as ent1, etype as e1_type, start, k,
  lead(surface) over w as ent2, lead(etype) over w as e2_type, lead(start) over w as start2, lead(k) over w as k2 from loc window w as (partition by sent_id order by start)),
pair as (select *, toks[greatest(start - 2, 1):start - 1] as before, toks[start + k:start2 - 1] as between_, toks[start2 + k2:start2 + k2 + 1] as after_
  from nxt where start2 - start between 1 and 6 and ent1 <> ent2)"""


@query(f"with {PAIRED} select sent_id, pos, ent1, ent2, e1_type, e2_type, start2 - start as distance from pair")
def entity_pairs(spark: Spark, d: str) -> DataFrame:
    rows = extract.neighbours(sentences(spark, d), typed=False).select("sent_id", F.explode("pairs").alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    return rows.select(
        "sent_id", F.col("p.pos").cast("bigint").alias("pos"), x["surface"].alias("ent1"), y["surface"].alias("ent2"), x["etype"].alias("e1_type"), y["etype"].alias("e2_type"),
        (y["start"] - x["start"]).cast("bigint").alias("distance"),
    )


_CONTEXT_SQL = f"""with {PAIRED} select sent_id, pos, ent1, ent2, array_to_string(before, ' ') as bef_words, array_to_string(between_, ' ') as bet_words, array_to_string(after_, ' ') as aft_words
from pair where {_VALID}"""


def _context_rows(rows: DataFrame) -> DataFrame:
    words = [F.array_join(a, " ").alias(f"{b}_words") for a, b in (("before", "bef"), ("between", "bet"), ("after", "aft"))]
    return rows.select("sent_id", F.col("pos").cast("bigint").alias("pos"), "ent1", "ent2", *words)


@query(_CONTEXT_SQL)
def context_windows(spark: Spark, d: str) -> DataFrame:
    return _context_rows(extract.relationships(sentences(spark, d), tagger=None, typed=False))


@query(_CONTEXT_SQL + " and e1_type = 'ORG' and e2_type = 'LOC'")
def typed_relationships(spark: Spark, d: str) -> DataFrame:
    return _context_rows(extract.relationships(sentences(spark, d), tagger=None))


@query(_CONTEXT_SQL)
def stream_extract(spark: Spark, d: str) -> DataFrame:
    return _context_rows(streaming.drain(streaming.relationships(streaming.sentence_stream(spark, f"{d}/relationships.parquet"), tagger=None, typed=False)).dropDuplicates(["sent_id", "pos"]))


@query(f"with {FACTS} select rel_id, {_VALID} as valid from facts")
def valid_between(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).select("rel_id", extract.valid_between(F.col("between")).alias("valid"))


@query(f"with {FACTS} select distinct ent1, ent2, bef_words, bet_words, aft_words from facts")
def distinct_tuples(spark: Spark, d: str) -> DataFrame:
    rows = extracted(spark, d).withColumn("k", extract.tuple_key(*[F.coalesce(F.col(c), F.lit("\u0000null")) for c in ("ent1", "ent2", "bef_words", "bet_words", "aft_words")]))
    return rows.dropDuplicates(["k"]).select("ent1", "ent2", "bef_words", "bet_words", "aft_words")


# ---- tagged contexts. The tags are made by a rule that SQL can repeat.


def _rule_tag(w: Column) -> Column:
    low = F.lower(w)
    return (
        F.when(low.isin(relphrase.BE), "VBD").when(low.isin("by", "in", "of", "at", "for", "with", "from", "on"), "IN").when(low == "to", "TO").when(low.isin("the", "a", "an", "its"), "DT")
        .when(low.endswith("ed"), "VBN").when(low.endswith("ly"), "RB").when(low.endswith("s"), "VBZ").when(low.endswith("al"), "JJ").otherwise("NN")
    )


_RULE = f"""case when lower(x) in {_in(relphrase.BE)} then 'VBD' when lower(x) in ('by', 'in', 'of', 'at', 'for', 'with', 'from', 'on') then 'IN' when lower(x) = 'to' then 'TO'
 when lower(x) in ('the', 'a', 'an', 'its') then 'DT' when lower(x) like '%ed' then 'VBN' when lower(x) like '%ly' then 'RB' when lower(x) like '%s' then 'VBZ' when lower(x) like '%al' then 'JJ' else 'NN' end"""
_LETTER = "case when t like 'VB%' then 'V' when t = 'RB' then 'R' when t = 'TO' then 'T' when t = 'NN' then 'N' when t = 'JJ' then 'J' when t = 'DT' then 'D' when t = 'IN' then 'I' else 'O' end"
_FOLD = """list_reduce(list_prepend({st: 0, f: '', c: ''}, list_transform(cl, lambda c: {st: 0, f: '', c: c})), lambda a, b: {
  st: case when a.st = 0 then case when b.c = 'V' then 1 else 0 end
    when a.st = 1 then case when b.c in ('V', 'R', 'T') then 1 when b.c in ('N', 'J', 'P', 'D') then 2 when b.c = 'I' then 3 else 0 end
    when a.st = 2 then case when b.c in ('N', 'J', 'R', 'P', 'D') then 2 when b.c in ('I', 'T') then 3 else 0 end
    else case when b.c in ('I', 'T') then 3 else 0 end end,
  f: a.f || case when (a.st = 0 and b.c = 'V') or (a.st = 1 and b.c in ('V', 'R', 'T', 'N', 'J', 'P', 'D', 'I')) or (a.st = 2 and b.c in ('N', 'J', 'R', 'P', 'D', 'I', 'T'))
    or (a.st = 3 and b.c in ('I', 'T')) then '1' else '0' end,
  c: b.c})"""
TAGGED = f"""{FACTS}, tagged as (select rel_id, between_ as w, list_transform(between_, lambda x: {_RULE}) as g from facts),
classed as (select *, list_transform(g, lambda t: {_LETTER}) as cl from tagged),
folded as (select *, {_FOLD}.f as flags from classed),
phrase as (select *, list_filter(w, lambda x, i: substr(flags, i, 1) = '1') as pw, list_filter(g, lambda x, i: substr(flags, i, 1) = '1') as pg,
  list_filter(cl, lambda x, i: substr(flags, i, 1) = '1') as pc from folded)"""


def _tagged(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).select("rel_id", F.transform("between", lambda w: F.struct(w.alias("tok"), _rule_tag(w).alias("tag"))).alias("tagged"))


@query(f"with {TAGGED} select rel_id, array_to_string(pw, ' ') as phrase, array_to_string(pc, '') as classes from phrase")
def relation_phrase(spark: Spark, d: str) -> DataFrame:
    rows = _tagged(spark, d).withColumn("p", relphrase.relational_phrase(F.col("tagged")))
    return rows.select("rel_id", extract.joined(F.col("p")).alias("phrase"), F.array_join(F.transform("p", lambda t: relphrase.tag_class(t["tag"])), "").alias("classes"))


@query(f"""with {TAGGED}, f as (select rel_id, len(pw) as n, pw, pg from phrase) select rel_id, coalesce(pw[n] = 'by' and (
  (n >= 3 and pg[1] like 'V%' and (pg[n - 1] in ('VBN', 'VBD') or (pw[1] in {_in(relphrase.BE)} and pg[2] in ('VBN', 'VBD')))) or (n = 2 and pg[1] in ('VBN', 'VBD'))), false) as passive from f""")
def passive_voice(spark: Spark, d: str) -> DataFrame:
    return _tagged(spark, d).select("rel_id", relphrase.passive_voice(relphrase.relational_phrase(F.col("tagged"))).alias("passive"))


@query(f"""with {TAGGED}, ch as (select rel_id, case when len(pw) > 0 then pw else w end as cw, case when len(pw) > 0 then pg else g end as cg from phrase)
select rel_id, array_to_string(list_filter(cw, lambda x, i: lower(x) not in {_in(STOPWORDS)} and cg[i] not in {_in(FILTER_TAGS)}), ' ') as content from ch""")
def content_filter(spark: Spark, d: str) -> DataFrame:
    return _tagged(spark, d).select("rel_id", F.array_join(relphrase.content_words(F.col("tagged")), " ").alias("content"))


@query(f"with {TAGGED} select rel_id, array_to_string(list_transform(g, lambda t: case when t like 'VB%' then 'VERB' when t = 'RB' then 'ADV' when t = 'TO' then 'PRT' when t = 'NN' then 'NOUN' when t = 'JJ' then 'ADJ' when t = 'DT' then 'DET' else 'ADP' end), ' ') as tags from tagged")
def universal_tags(spark: Spark, d: str) -> DataFrame:
    return _tagged(spark, d).select("rel_id", F.array_join(F.transform("tagged", lambda t: relphrase.universal_tag(t["tag"])), " ").alias("tags"))


_CLASS = "case " + " ".join(f"when t in {_in(v)} then '{k}'" for k, v in relphrase.CLASS_TAGS.items()) + " else 'O' end"
_UNIVERSAL = "case " + " ".join(f"when t in {_in([k for k, v in relphrase.UNIVERSAL.items() if v == u])} then '{u}'" for u in dict.fromkeys(relphrase.UNIVERSAL.values())) + " else 'X' end"
_UCLASS = "case " + " ".join(f"when u = '{k}' then '{v}'" for k, v in relphrase.UNIVERSAL_CLASS.items()) + " else 'O' end"
# the number of the phrase that holds each token, or 0
_GROUPS = """list_reduce(list_prepend({st: 0, n: 0, p: []::int[], c: ''}, list_transform(cl, lambda c: {st: 0, n: 0, p: []::int[], c: c})), lambda a, b: {
  st: case when a.st = 0 then case when b.c = 'V' then 1 else 0 end
    when a.st = 1 then case when b.c in ('V', 'R', 'T') then 1 when b.c in ('N', 'J', 'P', 'D') then 2 when b.c = 'I' then 3 else 0 end
    when a.st = 2 then case when b.c in ('N', 'J', 'R', 'P', 'D') then 2 when b.c in ('I', 'T') then 3 else 0 end
    else case when b.c in ('I', 'T') then 3 else 0 end end,
  n: case when a.st = 0 and b.c = 'V' then a.n + 1 else a.n end,
  p: list_append(a.p, case when (a.st = 0 and b.c = 'V') then a.n + 1 when (a.st = 1 and b.c in ('V', 'R', 'T', 'N', 'J', 'P', 'D', 'I')) or (a.st = 2 and b.c in ('N', 'J', 'R', 'P', 'D', 'I', 'T'))
    or (a.st = 3 and b.c in ('I', 'T')) then a.n else 0 end),
  c: b.c}).p"""
_PASSIVE = f"""coalesce(pw[len(pw)] = 'by' and ((len(pw) >= 3 and substr(pg[1], 1, 1) = 'V' and (pg[len(pw) - 1] in ('VBN', 'VBD') or (pw[1] in {_in(relphrase.BE)} and pg[2] in ('VBN', 'VBD'))))
  or (len(pw) = 2 and pg[1] in ('VBN', 'VBD'))), false)"""


# ---- the same over every tag: a word's tag is picked by its letters, so that all tags and all steps between them occur

_TAGS = sorted(relphrase.UNIVERSAL) + ["?"]
_PICKED = f"({_array(_TAGS)})[((length(x) * 31 + ascii(x) * 7 + ascii(substr(x, length(x), 1))) % {len(_TAGS)}) + 1]"


@query(f"""with {FACTS}, tg as (select rel_id, between_, list_transform(between_, lambda x: {_PICKED}) as g from facts),
cls as (select *, list_transform(g, lambda t: {_CLASS}) as cl from tg), gr as (select *, {_GROUPS} as grp from cls),
ph as (select *, list_filter(between_, lambda x, i: grp[i] > 0) as pw, list_filter(g, lambda x, i: grp[i] > 0) as pg from gr),
ch as (select *, case when len(pw) > 0 then pw else between_ end as cw, case when len(pw) > 0 then pg else g end as cg from ph)
select rel_id, array_to_string(pw, ' ') as phrase, array_to_string(list_transform(g, lambda t: {_UNIVERSAL}), ' ') as tags, {_PASSIVE} as passive,
  array_to_string(list_filter(cw, lambda x, i: lower(x) not in {_in(STOPWORDS)} and cg[i] not in {_in(FILTER_TAGS)}), ' ') as content from ch""")
def every_tag(spark: Spark, d: str) -> DataFrame:
    code = lambda w: F.get(F.array(*[F.lit(t) for t in _TAGS]), (F.length(w) * 31 + F.ascii(w) * 7 + F.ascii(F.substring(w, -1, 1))) % len(_TAGS))
    rows = extracted(spark, d).select("rel_id", F.transform("between", lambda w: F.struct(w.alias("tok"), code(w).alias("tag"))).alias("t"))
    rows = rows.withColumn("p", relphrase.relational_phrase(F.col("t")))
    return rows.select(
        "rel_id", extract.joined(F.col("p")).alias("phrase"), F.array_join(F.transform("t", lambda x: relphrase.universal_tag(x["tag"])), " ").alias("tags"),
        relphrase.passive_voice(F.col("p")).alias("passive"), F.array_join(relphrase.content_words(F.col("t")), " ").alias("content"),
    )


# ---- the same with the default tagger, over whole sentences

_TEXT = f"{SENT}, tk as (select sent_id, {_TOKS} as toks from sent), tg as (select *, {rule_tags_sql('toks')} as tags from tk)"
@query(f"with {_TEXT} select sent_id, array_to_string(tags, ' ') as tags from tg")
def sentence_tags(spark: Spark, d: str) -> DataFrame:
    plain = sentences(spark, d).select("sent_id", tokens(extract.untagged(F.col("sentence"))).alias("toks"))
    return plain.select("sent_id", F.array_join(pos_tags(F.col("toks")), " ").alias("tags"))


@query(f"""with {_TEXT}, cls as (select *, list_transform(tags, lambda t: {_CLASS}) as cl from tg), g as (select *, {_GROUPS} as grp from cls)
select sent_id, array_to_string(list_filter(toks, lambda x, i: grp[i] > 0), ' ') as phrase, array_to_string(list_filter(tags, lambda x, i: grp[i] > 0), ' ') as tags from g""")
def text_phrases(spark: Spark, d: str) -> DataFrame:
    plain = sentences(spark, d).select("sent_id", extract.untagged(F.col("sentence")).alias("plain"))
    rows = extract.text_phrases(plain, "plain")
    return rows.select("sent_id", extract.joined(F.col("phrases")).alias("phrase"), F.array_join(F.transform("phrases", lambda t: t["tag"]), " ").alias("tags"))


@query(f"""with {_TEXT}, uni as (select sent_id, toks, list_transform(tags, lambda t: {_UNIVERSAL}) as us from tg), cls as (select *, list_transform(us, lambda u: {_UCLASS}) as cl from uni),
g as (select *, {_GROUPS} as grp from cls), each as (select *, unnest(range(1, coalesce(list_max(grp), 0) + 1)) as k from g)
select sent_id, array_to_string(list_filter(toks, lambda x, i: grp[i] = k), ' ') || ' ' as phrase, array_to_string(list_filter(us, lambda x, i: grp[i] = k), ' ') as tags from each""")
def universal_phrases(spark: Spark, d: str) -> DataFrame:
    plain = sentences(spark, d).select("sent_id", extract.untagged(F.col("sentence")).alias("plain"))
    rows = extract.text_phrases(plain, "plain", universal=True)
    return rows.select("sent_id", F.explode("phrases").alias("p")).select("sent_id", "p.phrase", F.array_join(F.transform("p.tokens", lambda t: t["tag"]), " ").alias("tags"))


@query(f"""with {PAIRED}, tg as (select *, {rule_tags_sql('toks')} as tags from pair where {_VALID}),
cls as (select *, tags[start + k:start2 - 1] as g, list_transform(tags[start + k:start2 - 1], lambda t: {_CLASS}) as cl from tg), gr as (select *, {_GROUPS} as grp from cls),
ph as (select *, list_filter(between_, lambda x, i: grp[i] > 0) as pw, list_filter(g, lambda x, i: grp[i] > 0) as pg from gr),
ch as (select *, case when len(pw) > 0 then pw else between_ end as cw, case when len(pw) > 0 then pg else g end as cg from ph)
select sent_id, pos, ent1, ent2, array_to_string(before, ' ') as bef_words, array_to_string(between_, ' ') as bet_words, array_to_string(after_, ' ') as aft_words, {_PASSIVE} as passive_voice,
  array_to_string(list_filter(cw, lambda x, i: lower(x) not in {_in(STOPWORDS)} and cg[i] not in {_in(FILTER_TAGS)}), ' ') as content from ch""")
def tagged_relationships(spark: Spark, d: str) -> DataFrame:
    rows = extract.tuples(extract.relationships(sentences(spark, d), typed=False))
    content = F.array_join("bet_filtered", " ").alias("content")
    return rows.select("sent_id", F.col("pos").cast("bigint").alias("pos"), "ent1", "ent2", "bef_words", "bet_words", "aft_words", "passive_voice", content)


# ---- vectors. A word's vector is that of the identifier made of its length and first letter.


def word_vectors(spark: Spark, d: str) -> DataFrame:
    """(word, vec) of the words between entities."""
    words = extracted(spark, d).select(F.explode("between").alias("word")).distinct()
    keyed = words.withColumn("vec_id", ((F.length("word") * 31 + F.ascii("word")) % 200).cast("bigint"))
    return keyed.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


WORDS = """flat as (select rel_id, unnest(between_) as word from facts),
vecs as (select rel_id, e.embedding as v from flat join embeddings e on e.vec_id = (length(word) * 31 + ascii(word)) % 200)"""


@query(f"""with {FACTS}, {WORDS}, sums as (select rel_id, d, sum(v[d]::double) as s from (select rel_id, v, unnest(range(1, 65)) as d from vecs) group by all),
one as (select rel_id, round(sum(s * s), 6) as square, round(max(case when d = 1 then s end), 6) as first from sums group by rel_id)
select rel_id, coalesce(square, 0) as square, coalesce(first, 0) as first from facts left join one using (rel_id)""")
def context_vector_sum(spark: Spark, d: str) -> DataFrame:
    rows = extract.context_vectors(extracted(spark, d).select("rel_id", "between"), "rel_id", {"vec": "between"}, word_vectors(spark, d), DIM)
    return rows.select("rel_id", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("square"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


def _cos_sql(v: str) -> str:
    square = "list_sum(list_transform({0}, lambda x: x::double * x))"
    return f"case when len(a.{v}) = 64 and len(b.{v}) = 64 and {square.format('a.' + v)} > 0 and {square.format('b.' + v)} > 0 then list_cosine_similarity(a.{v}::double[], b.{v}::double[]) else 0 end"


_NEXT = "(select *, lead(tuple_id) over (order by tuple_id) as other from tuples) a join tuples b on b.tuple_id = a.other"


def _neighbours(spark: Spark, d: str) -> DataFrame:
    """Each tuple beside the next one."""
    t = table(spark, d, "tuples")
    ids = C.number_rows(t.select("tuple_id"), "tuple_id", "n")
    pairs = ids.withColumnRenamed("tuple_id", "a").join(ids.select(F.col("tuple_id").alias("b"), (F.col("n") - 1).alias("n")), "n").select("a", "b")
    x, y = t.select([F.col(c).alias(f"x_{c}") for c in t.columns]), t.select([F.col(c).alias(f"y_{c}") for c in t.columns])
    return pairs.join(x, F.col("a") == F.col("x_tuple_id")).join(y, F.col("b") == F.col("y_tuple_id"))


@query(f"select a.tuple_id as a, b.tuple_id as b, round({_cos_sql('bet_vector')}, 6) as cosine from {_NEXT}")
def cosine_pairs(spark: Spark, d: str) -> DataFrame:
    return _neighbours(spark, d).select("a", "b", F.round(V.cosine(F.col("x_bet_vector"), F.col("y_bet_vector"), DIM), 6).alias("cosine"))


_SIM = f"0.2 * {_cos_sql('bef_vector')} + 0.6 * {_cos_sql('bet_vector')} + 0.2 * {_cos_sql('aft_vector')}"


@query(f"select a.tuple_id as a, b.tuple_id as b, round({_SIM}, 6) as similarity from {_NEXT}")
def context_similarity(spark: Spark, d: str) -> DataFrame:
    x = V.weighted_unit({f"x_{c}": w for c, w in VECTORS.items()}, DIM)
    y = V.weighted_unit({f"y_{c}": w for c, w in VECTORS.items()}, DIM)
    return _neighbours(spark, d).select("a", "b", F.round(V.dot(x, y), 6).alias("similarity"))


# ---- seeds, patterns and confidence, over the stored tuples


def _named(spark: Spark, d: str) -> DataFrame:
    """The stored tuples with their relation's names: tuple_ord, tuple_key, ent1, ent2, the context vectors and the output's columns."""
    t, r = table(spark, d, "tuples"), extracted(spark, d)
    rows = t.select("tuple_id", "rel_id", *VECTORS).join(r, "rel_id")
    key = extract.tuple_key(*[F.col(c) for c in ("ent1", "ent2", "bef_words", "bet_words", "aft_words")])
    return rows.select(F.col("tuple_id").alias("tuple_ord"), key.alias("tuple_key"), "ent1", "ent2", *VECTORS, *B.OUTPUT[3:])


def with_x(rows: DataFrame) -> DataFrame:
    """The context vectors as one."""
    at = rows.columns.index("bef_vector")
    rest = [c for c in rows.columns if c not in VECTORS]
    return rows.select(*rest[:at], V.weighted_unit(VECTORS, DIM).alias("x"), *rest[at:])


def stored(spark: Spark, d: str) -> DataFrame:
    """The stored tuples: tuple_ord, tuple_key, ent1, ent2, x and the output's columns."""
    return with_x(_named(spark, d))


def kept(spark: Spark, d: str, *columns: str) -> DataFrame:
    """These columns of the stored tuples and their vectors, written once: x, which takes several times as much, is made of them as they are read."""
    return materialize(_named(spark, d).select(*columns, *VECTORS), "stored")


STORED = f"{FACTS}, st as (select t.tuple_id as tuple_ord, t.rel_id, f.ent1, f.ent2, t.bef_vector, t.bet_vector, t.aft_vector, f.bef_words, f.bet_words, f.aft_words from tuples t join facts f using (rel_id))"
SEEDS = f"""pos as (select {_squeezed("ent1")} as ent1, {_squeezed("ent2")} as ent2 from seeds where polarity = 'positive' union select e1, e2 from kb where r = 'headquarters' and e1 is not null and e2 is not null),
neg as (select distinct {_squeezed("ent1")} as ent1, {_squeezed("ent2")} as ent2 from seeds where polarity = 'negative')"""


def seed_pairs(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Positive seeds (and the known headquarters) and negative ones, without stray white space."""
    s = table(spark, d, "seeds").select(T.squeeze(F.col("ent1")).alias("ent1"), T.squeeze(F.col("ent2")).alias("ent2"), "polarity")
    known = table(spark, d, "kb").where("r = 'headquarters' and e1 is not null and e2 is not null").select(F.col("e1").alias("ent1"), F.col("e2").alias("ent2"))
    positive = s.where("polarity = 'positive'").select("ent1", "ent2").unionByName(known).distinct()
    return positive, s.where("polarity = 'negative'").select("ent1", "ent2").distinct()


def seeded_names(spark: Spark, d: str) -> DataFrame:
    """Positive seeds whose first name alone is compared: enough matches at every size."""
    return seed_pairs(spark, d)[0].select("ent1").distinct()


@query(f"with {STORED}, {SEEDS} select tuple_ord, ent1, ent2 from st semi join pos using (ent1, ent2)")
def seed_match(spark: Spark, d: str) -> DataFrame:
    return matching.seed_matches(stored(spark, d), seed_pairs(spark, d)[0]).select("tuple_ord", "ent1", "ent2")


@query(f"with {FACTS}, {SEEDS} select ent1, ent2, count(*) as matches from facts semi join pos using (ent1, ent2) group by all")
def seed_match_counts(spark: Spark, d: str) -> DataFrame:
    return matching.seed_match_counts(extracted(spark, d), seed_pairs(spark, d)[0])


MEMBERS = "names as (select distinct ent1 from pos), ids as (select ent1, row_number() over (order by ent1) - 1 as pattern_id from names), mem as (select pattern_id, st.* from st join ids using (ent1))"
_VOTED = f"""{STORED}, {SEEDS}, {MEMBERS},
sims as (select a.tuple_ord, b.pattern_id, {_SIM} as s from st a, mem b),
votes as (select tuple_ord, pattern_id, count(*) filter (s >= 0.3) as good, count(*) filter (s < 0.3) as bad, greatest(max(s), 0) as top from sims group by all),
voted as (select tuple_ord, pattern_id, good, bad, top as score from votes where good >= bad)"""


def members(spark: Spark, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Patterns of the stored tuples (rows, if they are kept) that share a first name with a positive seed: one for each name."""
    names = C.number_rows(seeded_names(spark, d), "ent1", "pattern_id")
    named = (_named(spark, d) if rows is None else rows).join(names, "ent1")
    return with_x(materialize(named.select(F.col("pattern_id").cast("bigint").alias("pattern_id"), "tuple_key", "tuple_ord", *VECTORS), "members"))


def _votes(spark: Spark, d: str) -> DataFrame:
    rows = kept(spark, d, "tuple_ord", "tuple_key", "ent1")
    return matching.match(with_x(rows), members(spark, d, rows), 0.3)


@query(f"with {_VOTED} select tuple_ord, pattern_id, round(score, 6) as score from voted")
def pattern_vote(spark: Spark, d: str) -> DataFrame:
    return _votes(spark, d).select("tuple_ord", "pattern_id", F.round("score", 6).alias("score"))


@query(f"with {_VOTED}, r as (select *, row_number() over (partition by tuple_ord order by round(score, 9) desc, pattern_id) as k from voted where score > 0) select tuple_ord, pattern_id, round(score, 4) as score from r where k = 1")
def best_pattern(spark: Spark, d: str) -> DataFrame:
    hits = _votes(spark, d).withColumn("score", F.round("score", 9))
    return matching.best_patterns(hits.withColumn("accepted", F.lit(True))).select("tuple_ord", "pattern_id", F.round("score", 4).alias("score"))


_CLASSED = f"""{STORED}, {SEEDS}, keyed as (select *, trim(ent1) as a, trim(ent2) as b from st),
flags as (select *, exists (select 1 from pos where pos.ent1 = a and pos.ent2 = b) as p, exists (select 1 from pos where pos.ent1 = a) as first_, exists (select 1 from neg where neg.ent1 = a and neg.ent2 = b) as n from keyed),
classed as (select tuple_ord, p::bigint as pos, (not p and first_)::bigint + (not p and n)::bigint as neg, (not p and not first_ and not n)::bigint as unk from flags)"""


@query(f"with {_CLASSED} select * from classed")
def pattern_selectivity(spark: Spark, d: str) -> DataFrame:
    positive, negative = seed_pairs(spark, d)
    return scoring.selectivity_classes(stored(spark, d), positive, negative).select("tuple_ord", "pos", "neg", "unk")


_CONF = f"""{_VOTED}, {_CLASSED.split(SEEDS + ", ", 1)[1]},
counts as (select pattern_id, sum(pos)::bigint as positive, sum(neg)::bigint as negative, sum(unk)::bigint as unknown from voted join classed using (tuple_ord) group by 1),
conf as (select *, case when positive > 0 then positive / (positive + unknown * 0.1 + negative * 2.0) else 0 end as confidence from counts)"""


def _confident(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    positive, negative = seed_pairs(spark, d)
    named = materialize(_named(spark, d), "stored")
    rows = with_x(named)
    hits = materialize(matching.match(rows, members(spark, d, named), 0.3), "hits")
    counts = scoring.pattern_counts(hits, scoring.selectivity_classes(rows, positive, negative))
    sure = scoring.pattern_confidence(F.col("positive"), F.col("negative"), F.col("unknown"), 2.0, 0.1)
    return rows, hits, counts.withColumn("confidence", sure)


@query(f"with {_CONF} select pattern_id, positive, negative, unknown, round(confidence, 6) as confidence from conf")
def pattern_confidence(spark: Spark, d: str) -> DataFrame:
    return _confident(spark, d)[2].withColumn("confidence", F.round("confidence", 6))


_EVIDENCE = f"""{_CONF}, keyed2 as (select tuple_ord, hash(coalesce(ent1, '') || chr(1) || coalesce(ent2, '') || chr(1) || coalesce(bef_words, '') || chr(1) || coalesce(bet_words, '') || chr(1) || coalesce(aft_words, '')) as tuple_key from st),
ev as (select tuple_key, pattern_id, arg_min(score, tuple_ord) as sim from voted join keyed2 using (tuple_ord) where score >= 0.3 group by all),
tc as (select tuple_key, 1 - product(1 - confidence * sim) as confidence from ev join conf using (pattern_id) group by 1),
cand as (select ent1, ent2, tuple_ord, tc.confidence from tc join keyed2 using (tuple_key) join st using (tuple_ord) join (select tuple_key, min(tuple_ord) as tuple_ord from keyed2 semi join ev using (tuple_key) group by 1) using (tuple_key, tuple_ord))"""


def _candidates(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, hits, patterns = _confident(spark, d)
    keyed = hits.join(rows.select("tuple_ord", "tuple_key"), "tuple_ord")
    evidence = materialize(scoring.new_evidence(keyed, None, 0.3), "evidence")
    return rows, evidence, materialize(scoring.tuple_confidence(evidence, patterns), "confidence")


def _firsts(rows: DataFrame, confidence: DataFrame) -> DataFrame:
    first = rows.groupBy("tuple_key").agg(F.min_by(F.struct("tuple_ord", "ent1", "ent2"), "tuple_ord").alias("t"))
    return confidence.join(first, "tuple_key").select("t.tuple_ord", "t.ent1", "t.ent2", "confidence")


@query(f"with {_EVIDENCE} select tuple_ord, ent1, ent2, round(confidence, 6) as confidence from cand")
def tuple_confidence(spark: Spark, d: str) -> DataFrame:
    rows, _, confidence = _candidates(spark, d)
    return _firsts(rows, confidence).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_EVIDENCE} select ent1, ent2 from pos union select ent1, ent2 from cand where round(confidence, 9) >= 0.2")
def seed_promotion(spark: Spark, d: str) -> DataFrame:
    rows, _, confidence = _candidates(spark, d)
    sure = _firsts(rows, confidence.withColumn("confidence", F.round("confidence", 9)))
    return scoring.with_seeds(seed_pairs(spark, d)[0], scoring.promoted(sure, 0.2))


@query(f"""with {_EVIDENCE.replace("f.aft_words from", "f.aft_words, f.sentence, f.passive_voice from")} select ent1 as entity_1, ent2 as entity_2, round(cand.confidence, 6) as confidence, sentence, bef_words, bet_words, aft_words, passive_voice from cand join st using (tuple_ord, ent1, ent2)""")
def ranked_output(spark: Spark, d: str) -> DataFrame:
    rows, evidence, confidence = _candidates(spark, d)
    first = rows.groupBy("tuple_key").agg(F.min("tuple_ord").alias("first_ord"))
    ranked = B.ranked_output(rows, evidence.drop("first_ord").join(first, "tuple_key"), confidence)
    return ranked.withColumn("confidence", F.round("confidence", 6))


_SX = f"""{STORED.replace("f.aft_words from", "f.aft_words, f.sentence, f.passive_voice from")}, {SEEDS},
sx as (select tuple_ord as ord, coalesce(ent1, '') || chr(1) || coalesce(ent2, '') || chr(1) || coalesce(bef_words, '') || chr(1) || coalesce(bet_words, '') || chr(1) || coalesce(aft_words, '') as key,
  ent1, ent2, {BS.vectors(VECTORS, DIM)} as x, bef_words, bet_words, aft_words, sentence, passive_voice from st)"""


@query(f"""with recursive {_SX}, m as (select row_number() over (order by ord) as n, ord, key, x from sx semi join pos using (ent1)), {BS.fold("fold", "m", 0.6)}, {BS.members("mem", "fold")}
select pattern_id, ord as tuple_ord from mem semi join (select pattern_id from mem group by 1 having count(distinct key) >= 2) using (pattern_id)""")
def single_pass_cluster(spark: Spark, d: str) -> DataFrame:
    matched = materialize(_named(spark, d).join(seeded_names(spark, d), "ent1", "left_semi").select("tuple_ord", "tuple_key", *VECTORS), "matched")
    # written, as it is read twice and the fold is not to run twice
    members = materialize(clustering.cluster_pass(with_x(matched), None, 0.6).select("pattern_id", "tuple_key", "tuple_ord"), "members")
    return clustering.supported(members, 2).select("pattern_id", "tuple_ord")


@query(f"""with recursive {_SX}, seeds0 as (select ent1, ent2 from pos), {BS.passes(2, 0.6, 0.6, 2.0, 0.1, lambda c: f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')")}
select ent1 as entity_1, ent2 as entity_2, round(confidence, 6) as confidence, sentence, bef_words, bet_words, aft_words, passive_voice from sure1 join sx on ord = first_ord""")
def bootstrap_relations(spark: Spark, d: str) -> DataFrame:
    positive, negative = seed_pairs(spark, d)
    config = Config(alpha=0.2, beta=0.6, gamma=0.2, min_pattern_support=1, unknown_weight=0.1, iterations=1)
    return B.bootstrap(stored(spark, d), positive, negative, config).relations.withColumn("confidence", F.round("confidence", 6))


@query(f"with {STORED}, {SEEDS}, {MEMBERS} select pattern_id, array_to_string(list_sort(list(distinct bet_words)), '|') as words from mem where bet_words is not null group by 1")
def pattern_words(spark: Spark, d: str) -> DataFrame:
    w = clustering.pattern_words(members(spark, d), stored(spark, d))
    return w.select("pattern_id", F.array_join("words", "|").alias("words"))


# ---- knowledge base


def _facts_of(kb: DataFrame) -> DataFrame:
    return kb.select("kb_id", "e1", "r", "e2")


_CLEAN = f"""select kb_id, {_squeezed("regexp_replace(e1, '\\(.*\\)', '', 'g')")} as e1, r, {_squeezed("regexp_replace(e2, '\\(.*\\)', '', 'g')")} as e2 from kb
where e1 is not null and e2 is not null and not regexp_matches(e1, '^(/|m/)|#[0-9]+$') and not regexp_matches(e2, '^(/|m/)|#[0-9]+$') and trim(e2) not in {_in(K.NOT_FOUNDED)}"""


@query(_CLEAN)
def kb_clean(spark: Spark, d: str) -> DataFrame:
    rows = K.clean_facts(_facts_of(table(spark, d, "kb")))
    return rows.select("kb_id", T.squeeze(F.col("e1")).alias("e1"), "r", T.squeeze(F.col("e2")).alias("e2"))


_LISTED = {"founder": "Organization founded", "employer": "Employment history", "acquired": "Organization acquired", "headquarters": "Place founded", "spouse": "Married To", "capital_of": "Capital of"}
_LISTED_SQL = "case " + " ".join(f"when r = '{k}' then '{v}'" for k, v in _LISTED.items()) + " else r end"


@query(f"""select kb_id, trim(regexp_replace(e1, '\\(.*\\)', '', 'g')) as e1, {_LISTED_SQL} as r, trim(regexp_replace(e2, '\\(.*\\)', '', 'g')) as e2 from kb where {_LISTED_SQL} in {_in(K.WHITELIST)}
 and e1 is not null and e2 is not null and not regexp_matches(e1, '^(/|m/|[0-9]+$|DVD Region|Area code|US Census)|#[0-9]+$') and not regexp_matches(e2, '^(/|m/|[0-9]+$|DVD Region|Area code)|#[0-9]+$')""")
def kb_clean_listed(spark: Spark, d: str) -> DataFrame:
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _LISTED.items() for x in kv]), "r"), "r")
    return K.clean_listed_facts(_facts_of(table(spark, d, "kb")).withColumn("r", named))


@query("select kb_id, case when r in ('founder', 'employer') then e2 else e1 end as e1, r, case when r in ('founder', 'employer') then e1 else e2 end as e2 from kb where r is not null")
def kb_direction(spark: Spark, d: str) -> DataFrame:
    kb = _facts_of(table(spark, d, "kb")).where("r is not null")
    flipped = K.directed(kb.where(F.col("r").isin(K.FLIPPED)), "founder")
    return flipped.unionByName(K.directed(kb.where(~F.col("r").isin(K.FLIPPED)), "acquired"))


@query(f"""with {FACTS}, f as (select *, coalesce(passive_voice, false) or contains(coalesce(bet_words, ''), '''s parent') or contains(coalesce(bet_words, ''), 'subsidiary of') or coalesce(bet_words, '') = 'subsidiary' as turn from facts)
select rel_id, case when turn then ent2 else ent1 end as ent1, case when turn then ent1 else ent2 end as ent2 from f""")
def argument_swap(spark: Spark, d: str) -> DataFrame:
    return K.swap_arguments(extracted(spark, d), "acquired").select("rel_id", "ent1", "ent2")


@query(f"with {FACTS} select rel_id, case when coalesce(passive_voice, false) then ent2 else ent1 end as ent1, case when coalesce(passive_voice, false) then ent1 else ent2 end as ent2 from facts")
def passive_swap(spark: Spark, d: str) -> DataFrame:
    return K.swap_arguments(extracted(spark, d), "headquarters").select("rel_id", "ent1", "ent2")


PAIRS = f"{FACTS}, pairs as (select distinct ent1, ent2 from facts), k as (select distinct e1, e2 from kb where e1 is not null and e2 is not null)"


def _pairs(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).select("ent1", "ent2").distinct()


@query(f"with {PAIRS} select ent1, ent2 from pairs where exists (select 1 from k where e1 = ent1 and e2 = ent2)")
def kb_exact(spark: Spark, d: str) -> DataFrame:
    return K.exact_matches(_pairs(spark, d), table(spark, d, "kb"))


def _jac(x: str, y: str) -> str:
    a, b = f"list_distinct(string_split({x}, ' '))", f"list_distinct(string_split({y}, ' '))"
    return f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


_SUFFIX = "regexp_replace({0}, ' Corporation| Inc\\.', '', 'g')"
_ARG1, _ARG2 = _SUFFIX.format("e1"), _SUFFIX.format("e2")


@query(f"with {PAIRS} select ent1, ent2, e1, round({_jac('ent1', _ARG1)}, 6) as jaccard from pairs join k on ent2 = e2 where {_jac('ent1', _ARG1)} >= 0.5")
def kb_jaccard(spark: Spark, d: str) -> DataFrame:
    hits = K.fuzzy_matches(_pairs(spark, d), table(spark, d, "kb"), "arg1", True, winkler=2.0)
    return hits.select("ent1", "ent2", "e1", F.round("jaccard", 6).alias("jaccard"))


@query(f"with {PAIRS} select ent1, ent2, e2, round(jaro_winkler_similarity(upper(ent2), upper({_ARG2})), 6) as winkler from pairs join k on ent1 = e1 where {_jac('ent2', _ARG2)} < 0.5 and jaro_winkler_similarity(upper(ent2), upper({_ARG2})) >= 0.9")
def kb_jaro_winkler(spark: Spark, d: str) -> DataFrame:
    hits = K.fuzzy_matches(_pairs(spark, d), table(spark, d, "kb"), "arg2", True)
    return hits.where("winkler is not null").select("ent1", "ent2", "e2", F.round("winkler", 6).alias("winkler"))


KNOWN = f"""{PAIRS}, known as (select distinct ent1, ent2 from pairs join k on ent2 = e2 where {_jac('ent1', _ARG1)} >= 0.5 or jaro_winkler_similarity(upper(ent1), upper({_ARG1})) >= 0.9
 union select ent1, ent2 from pairs join k on ent1 = e1 where {_jac('ent2', _ARG2)} >= 0.5 or jaro_winkler_similarity(upper(ent2), upper({_ARG2})) >= 0.9
 union select ent1, ent2 from pairs join k on ent1 = e1 and ent2 = e2)"""


@query(f"with {KNOWN} select ent1, ent2 from pairs anti join known using (ent1, ent2)")
def kb_anti(spark: Spark, d: str) -> DataFrame:
    pairs = materialize(_pairs(spark, d), "pairs")
    return K.unknown_pairs(pairs, K.known_pairs(pairs, table(spark, d, "kb")))


# the other engine's Jaro-Winkler compares bytes, so letters beyond ASCII are told apart there by a code of one byte each
@query(f"""with {FACTS},
named as (select rel_id, ent1, ent2, upper(ent1) as a, upper(ent2) as b from facts),
own as (select rel_id, list_sort(list_distinct(list_filter(string_split(a || b, ''), lambda c: ascii(c) > 127))) as o, list_filter(range(1, 127), lambda k: k <> 34 and not contains(a || b, chr(k::int))) as free, * exclude (rel_id) from named),
coded as (select rel_id, ent1, ent2, array_to_string(list_transform(string_split(a, ''), lambda c: case when ascii(c) > 127 then chr(free[list_position(o, c)]::int) else c end), '') as a,
  array_to_string(list_transform(string_split(b, ''), lambda c: case when ascii(c) > 127 then chr(free[list_position(o, c)]::int) else c end), '') as b from own)
select rel_id, round({_jac('ent1', 'ent2')}, 6) as jaccard, round(jaro_winkler_similarity(a, b), 6) as winkler from coded""")
def name_similarity(spark: Spark, d: str) -> DataFrame:
    rows = extracted(spark, d)
    return rows.select("rel_id", F.round(token_jaccard(F.col("ent1"), F.col("ent2")), 6).alias("jaccard"), F.round(jaro_winkler_similarity(F.upper("ent1"), F.upper("ent2")), 6).alias("winkler"))


@query("select trim(acronym) as acronym, array_to_string(list_sort(list(distinct trim(expansion))), '; ') as expansions from acronyms where acronym is not null and expansion is not null and not contains(acronym, '/') and not contains(expansion, '/') group by 1")
def acronym_map(spark: Spark, d: str) -> DataFrame:
    return K.acronym_map(table(spark, d, "acronyms")).select("acronym", F.array_join("expansions", "; ").alias("expansions"))


@query(f"with {FACTS} select distinct ent1, not contains(ent1, ' ') and ent1 = upper(ent1) and regexp_matches(ent1, '[A-Z]') as acronym from facts")
def acronym_test(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).select("ent1", K.is_acronym(F.col("ent1")).alias("acronym")).distinct()


# ---- texts

@query("select doc_id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') as pairs from (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as t from documents)")
def bigrams(spark: Spark, d: str) -> DataFrame:
    t = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.bigrams(t), "|").alias("pairs"))


_HQ = K.RELATIONS["headquarters"]
_BIG = "list_transform(range(1, len(between_)), lambda i: between_[i] || ' ' || between_[i + 1])"
_KEYWORD = f"(list_has_any(before, {_array(_HQ.unigrams)}) or list_has_any(between_, {_array(_HQ.unigrams)}) or list_has_any(after_, {_array(_HQ.unigrams)}) or list_has_any({_BIG}, {_array(_HQ.bigrams)}))"


@query(f"with {FACTS} select rel_id, {_KEYWORD} as keyword from facts")
def keyword_filter(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).select("rel_id", E.has_keyword(F.col("before"), F.col("between"), F.col("after"), _HQ.unigrams, _HQ.bigrams).alias("keyword"))


def _keyword(r: K.RelationType) -> str:
    u, b = f"{_array(r.unigrams)}::varchar[]", f"{_array(r.bigrams)}::varchar[]"
    return f"(list_has_any(before, {u}) or list_has_any(between_, {u}) or list_has_any(after_, {u}) or list_has_any({_BIG}, {b}))"


@query(f"with {FACTS} " + " union all ".join(f"select rel_id, '{n}' as relation, '{r.e1_type}' as e1, '{r.e2_type}' as e2 from facts where {_keyword(r)}" for n, r in K.RELATIONS.items()))
def keyword_relations(spark: Spark, d: str) -> DataFrame:
    rows = extracted(spark, d)
    said = [F.when(E.has_keyword(F.col("before"), F.col("between"), F.col("after"), r.unigrams, r.bigrams), F.struct(F.lit(n).alias("relation"), F.lit(r.e1_type).alias("e1"), F.lit(r.e2_type).alias("e2"))) for n, r in ((n, K.relation_type(n)) for n in K.RELATIONS)]
    return rows.select("rel_id", F.inline(F.filter(F.array(*said), lambda x: x.isNotNull())))


_SAYS = f"len(list_filter(between_, lambda x: x not in {_in(NOT_VALID)})) > 0"


@query(f"with {FACTS} select rel_id from facts where {_SAYS} and (not list_contains(between_, ',') or between_[1] = ',')")
def superset_filter(spark: Spark, d: str) -> DataFrame:
    return extracted(spark, d).where(E.plausible(F.col("between"))).select("rel_id")


@query(f"with {FACTS}, n as (select sent_id, count(*) filter (not bad) as valid, count(*) filter (bad) as invalid from (select sent_id, list_contains(between_, '.') or not ({_SAYS}) as bad from facts) group by 1) select * from n where valid > invalid")
def index_eligible(spark: Spark, d: str) -> DataFrame:
    return E.eligible_sentences(extracted(spark, d).select("sent_id", "between"))


@query(f"""with {FACTS}, known as (select e1 as e from kb where e1 is not null union select e2 from kb where e2 is not null)
select sent_id, not bool_or(ent1 not in (from known) or ent2 not in (from known) or coalesce(len(between_) = 1 and between_[1] in (',', '(', ')'), false)) as selected from facts group by 1""")
def sentence_select(spark: Spark, d: str) -> DataFrame:
    return E.selected_sentences(extracted(spark, d).select("sent_id", "ent1", "ent2", "between"), K.known_entities(table(spark, d, "kb")))


_W = r"[\p{L}\p{N}\p{M}_]"
TERMS = f"""{SENT}, terms as (select sent_id, k - 1 as position, t[k] as term from (select sent_id, t, unnest(range(1, len(t) + 1)) as k from (
  select sent_id, regexp_extract_all(sentence, '({_W}+(?:-{_W}+)+|<[A-Z]+>[^<]+</[A-Z]+>|{_W}+)', 1) as t from sent)))"""


@query(f"with {TERMS} select * from terms")
def term_positions(spark: Spark, d: str) -> DataFrame:
    return E.term_positions(sentences(spark, d)).select("sent_id", F.col("position").cast("bigint").alias("position"), "term")


HITS = f"""{TERMS}, {FACTS}, p as (select distinct ent1, ent2 from facts),
near0 as (select distinct ent1, ent2, x.sent_id from p join terms x on x.term = '<ORG>' || ent1 || '</ORG>' join terms y on y.term = '<LOC>' || ent2 || '</LOC>' and x.sent_id = y.sent_id and y.position - x.position between 1 and 6),
near_ as (select ent1, ent2, sent_id from near0)"""


def _hits(spark: Spark, d: str, limit: int | None = None) -> DataFrame:
    return E.proximity_hits(E.entity_positions(sentences(spark, d)), extracted(spark, d), "ORG", "LOC", limit=limit)


@query(f"with {HITS} select * from near_")
def proximity_hits(spark: Spark, d: str) -> DataFrame:
    return _hits(spark, d)


@query(f"with {HITS} select ent1, ent2, sent_id from (select *, row_number() over (partition by ent1, ent2 order by sent_id) as r from near_) where r <= 2")
def proximity_top(spark: Spark, d: str) -> DataFrame:
    # here the limit is the feature: the first sentences of each pair
    return _hits(spark, d, 2)


ELIGIBLE = f"n as (select sent_id from (select sent_id, list_contains(between_, '.') or not ({_SAYS}) as bad from facts) group by 1 having count(*) filter (not bad) > count(*) filter (bad))"


@query(f"with {HITS}, {ELIGIBLE} select near_.* from near_ semi join n using (sent_id)")
def index_search(spark: Spark, d: str) -> DataFrame:
    # an index of the sentences that are worth it, written once and then searched
    path = f"{scratch_dir(spark)}/relweave-index-{uuid.uuid4().hex}"
    S.write_index(sentences(spark, d), extracted(spark, d).select("sent_id", "between"), path)
    return E.proximity_hits(S.read_index(spark, path), extracted(spark, d), "ORG", "LOC")


@query(f"""with {HITS}, j as (select f.ent1, f.ent2, ({_SAYS}) and (list_has_any(between_, {_array(_HQ.unigrams)}) or list_has_any({_BIG}, {_array(_HQ.bigrams)})) as relational from facts f semi join near_ n on n.ent1 = f.ent1 and n.ent2 = f.ent2 and n.sent_id = f.sent_id),
c as (select ent1, ent2, count(*) filter (relational) as with_words, count(*) filter (not relational) as without_words from j group by all)
select *, with_words > 0 and without_words > 0 and with_words / without_words >= 0.7 as accepted from c""")
def proximity_ratio(spark: Spark, d: str) -> DataFrame:
    rows = extracted(spark, d).select("sent_id", "ent1", "ent2", "between").join(_hits(spark, d), ["sent_id", "ent1", "ent2"], "left_semi")
    judged = rows.withColumn("relational", E.relational_by_words(F.col("between"), _HQ.unigrams, _HQ.bigrams))
    return E.proximity_ratio(judged).select("ent1", "ent2", "with_words", "without_words", "accepted")


def _evaluation(spark: Spark, d: str, cache: str | None = None):
    rows = extracted(spark, d)
    facts = rows.where((F.col("e1_type") == "ORG") & (F.col("e2_type") == "LOC") & (F.col("confidence") >= 0.6) & ~F.isnan("confidence"))
    kb = K.directed(table(spark, d, "kb").where(F.col("r") == "headquarters"), "headquarters")
    return evaluate(facts, kb, rows, sentences(spark, d), "headquarters", cache=cache)


_KB_SETS = KNOWN.split("k as (", 1)[0].replace("select distinct ent1, ent2 from facts", "select distinct ent1, ent2 from facts where e1_type = 'ORG' and e2_type = 'LOC'") + "k as (" + KNOWN.split("k as (", 1)[1].replace("where e1 is not null", "where r = 'headquarters' and e1 is not null", 1)
_SETS = f"""{_KB_SETS}, {TERMS},
s as (select distinct ent1, ent2, sentence, bet_words from facts where e1_type = 'ORG' and e2_type = 'LOC' and confidence >= 0.6 and not isnan(confidence)),
typed as (select * from facts where e1_type = 'ORG' and e2_type = 'LOC'),
near0 as (select distinct ent1, ent2, x.sent_id from pairs join terms x on x.term = '<ORG>' || ent1 || '</ORG>' join terms y on y.term = '<LOC>' || ent2 || '</LOC>' and x.sent_id = y.sent_id and y.position - x.position between 1 and 6),
near_ as (select ent1, ent2, sent_id from near0),
b as (select * from s semi join known using (ent1, ent2)), rest as (select * from s anti join known using (ent1, ent2)),
hit as (select t.* from typed t semi join near_ n on n.ent1 = t.ent1 and n.ent2 = t.ent2 and n.sent_id = t.sent_id),
ja as (select h.ent1, h.ent2, {_KEYWORD} or exists (select 1 from rest r where r.ent1 = h.ent1 and r.ent2 = h.ent2 and {tokens_sql("r.bet_words")} = h.between_) as relational from hit h where exists (select 1 from rest r where r.ent1 = h.ent1 and r.ent2 = h.ent2)),
oka as (select ent1, ent2 from ja group by all having count(*) filter (relational) > 0 and count(*) filter (not relational) > 0 and count(*) filter (relational) / count(*) filter (not relational) >= 0.7),
a as (select * from rest semi join oka using (ent1, ent2)),
worded as (select distinct ent1, ent2, sentence from typed where {_SAYS} and (not list_contains(between_, ',') or between_[1] = ',') and {_KEYWORD}),
c as (select * from worded w where exists (select 1 from known where known.ent1 = w.ent1 and known.ent2 = w.ent2) and not exists (select 1 from b where b.ent1 = w.ent1 and b.ent2 = w.ent2 and b.sentence = w.sentence)),
jd as (select ent1, ent2, ({_SAYS}) and (list_has_any(between_, {_array(_HQ.unigrams)}) or list_has_any({_BIG}, {_array(_HQ.bigrams)})) as relational from hit),
okd as (select ent1, ent2 from jd group by all having count(*) filter (relational) > 0 and count(*) filter (not relational) > 0 and count(*) filter (relational) / count(*) filter (not relational) >= 0.7),
d as (select * from worded w where not exists (select 1 from known where known.ent1 = w.ent1 and known.ent2 = w.ent2) and exists (select 1 from okd where okd.ent1 = w.ent1 and okd.ent2 = w.ent2)
  and not exists (select 1 from a where a.ent1 = w.ent1 and a.ent2 = w.ent2 and a.sentence = w.sentence))"""


@query(f"with {_SETS} select 'a' as part, ent1, ent2, sentence from a union all select 'b', ent1, ent2, sentence from b union all select 'c', ent1, ent2, sentence from c union all select 'd', ent1, ent2, sentence from d")
def eval_sets(spark: Spark, d: str) -> DataFrame:
    e = _evaluation(spark, d)
    out = None
    for name in ("a", "b", "c", "d"):
        part = getattr(e, name).select(F.lit(name).alias("part"), "ent1", "ent2", "sentence")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {_SETS} select ent1, ent2 from a union select ent1, ent2 from b union select ent1, ent2 from c union select ent1, ent2 from d")
def eval_truth(spark: Spark, d: str) -> DataFrame:
    e = _evaluation(spark, d)
    return E.truth(e.a, e.b, e.c, e.d)


@query(f"""with {_SETS}, n as (select (select count(*) from a) as a, (select count(*) from b) as b, (select count(*) from s) as s, (select count(*) from (select distinct ent1, ent2 from c)) as c, (select count(*) from (select distinct ent1, ent2 from d)) as d),
m as (select *, case when s > 0 then (a + b) / s else 0 end as p, case when a + b + c + d > 0 then (a + b) / (a + b + c + d) else 0 end as r from n)
select a, b, s, c, d, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m""")
def eval_metrics(spark: Spark, d: str) -> DataFrame:
    m = _evaluation(spark, d).metrics
    return m.select("a", "b", "s", "c", "d", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(ORACLE["eval_metrics"])
def eval_again(spark: Spark, d: str) -> DataFrame:
    # a second run takes over what the first left
    cache = f"{scratch_dir(spark)}/relweave-cache-{uuid.uuid4().hex}"
    _evaluation(spark, d, cache)
    m = _evaluation(spark, d, cache).metrics
    return m.select("a", "b", "s", "c", "d", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("select coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0)::bigint as lines from documents")
def line_count(spark: Spark, d: str) -> DataFrame:
    return C.count_lines(table(spark, d, "documents"), "text")


# ---- file formats, read back from lines made of the tables

def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(f"""with {FACTS} select rel_id, {_stripped("ent1")} as ent1, {_stripped("ent2")} as ent2, round(confidence, 6) as score, {_stripped("coalesce(bet_words, '')")} as bet_words from facts
where confidence is not null and not isnan(confidence)""")
def legacy_blocks(spark: Spark, d: str) -> DataFrame:
    # a block without a number for its score is none
    block = F.format_string("instance: %s\t%s\tscore:%s\nsentence: %s\npattern_bef: x\npattern_bet: %s\npattern_aft: y\npassive voice: %s\n", "ent1", "ent2", F.col("confidence").cast("string"), F.coalesce("sentence", F.lit("")), F.coalesce("bet_words", F.lit("")), F.when(F.col("passive_voice"), "True").otherwise("False"))
    got = S.parse_blocks(extracted(spark, d).select("rel_id", block.alias("value")), keep=["rel_id"])
    return got.select("rel_id", "ent1", "ent2", F.round("score", 6).alias("score"), "bet_words")


def _bare(c: str) -> str:
    """What is left of a name that was written as a local name: underscores are blanks, white space parts fields and is written as an underscore."""
    named = f"replace(regexp_replace({_stripped(c)}, '{SPACE}', '_', 'g'), '_', ' ')"
    return _stripped(f"regexp_replace({named}, '\\(.*\\)', '', 'g')")


@query(f"select kb_id, {_bare('e1')} as e1, {_bare('r')} as r, {_bare('e2')} as e2 from kb where e1 is not null and e2 is not null and r is not null")
def ntriples(spark: Spark, d: str) -> DataFrame:
    uri = lambda c, kind: F.concat(F.lit(f"<http://dbpedia.org/{kind}/"), F.regexp_replace(T.strip(F.col(c)), T.SPACE, "_"), F.lit(">"))
    line = F.concat_ws(" ", uri("e1", "resource"), uri("r", "ontology"), uri("e2", "resource"), F.lit("."))
    kb = table(spark, d, "kb").where("e1 is not null and e2 is not null and r is not null")  # a fact lacking a part has no line
    return S.parse_ntriples(kb.select("kb_id", line.alias("value")), keep=["kb_id"]).select("kb_id", "e1", "r", "e2")


@query(f"select distinct {_squeezed('ent1')} as ent1, {_squeezed('ent2')} as ent2 from seeds where ent1 is not null and ent2 is not null")
def seed_lines(spark: Spark, d: str) -> DataFrame:
    lines = table(spark, d, "seeds").select(F.concat_ws(";", "ent1", "ent2").alias("value"))
    seeds, _ = C.parse_seeds(lines)
    return seeds.select(T.squeeze(F.col("ent1")).alias("ent1"), T.squeeze(F.col("ent2")).alias("ent2")).distinct()


@query("select doc_id, row_number() over (order by doc_id) - 1 as n from documents")
def dense_order(spark: Spark, d: str) -> DataFrame:
    return C.number_rows(table(spark, d, "documents").select("doc_id"), "doc_id", "n").select("doc_id", F.col("n").cast("bigint").alias("n"))
