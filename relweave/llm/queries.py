"""The queries of this package over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions import text as T
from relweave.llm import clusters, frequency, leakage, names, near_duplicates, packing, splitting, survivor, together
from relweave.llm.tokens import count_tokens
from relweave.plans.tables import table
from relweave.session import materialize

VECTORS = {"bef_vector": 0.2, "bet_vector": 0.6, "aft_vector": 0.2}
ENTITIES = {"entity_1": "e1_type", "entity_2": "e2_type"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    terms = frequency.term_frequencies(table(spark, d, "relationships"), "rel_id", "bet_words")
    return terms.where(F.col("mark") != "useful").select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = frequency.term_frequencies(table(spark, d, "relationships"), "rel_id", "bet_words")
    return terms.select("term", "occurrences", "records", F.round("share", 9).alias("share"), "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.tight_clusters(table(spark, d, "tuples"), "tuple_id", VECTORS)
    return found.select(F.col("id").alias("tuple_id"), "cluster_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.cluster(table(spark, d, "tuples"), "tuple_id", VECTORS)
    return c.select(F.col("id").alias("tuple_id"), "cluster_id", "size", F.round("flow", 6).alias("flow"), F.array_join("typical", ",").alias("typical"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.cluster(table(spark, d, "tuples"), "tuple_id", VECTORS)
    return c.select(F.col("id").alias("tuple_id"), "cluster_id", "size", "isolated")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "relationships"), ENTITIES, table(spark, d, "acronyms"))


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    g = names.name_groups(table(spark, d, "relationships"), ENTITIES, table(spark, d, "acronyms"))
    label = g.groupBy("group").agg(F.min("name").alias("label"), F.count(F.lit(1)).alias("spellings"))
    return g.join(label, "group").select("name", "label", "spellings")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "relationships"), "sent_id", "sentence", 0.7)
    return pairs.select(F.col("id_a").alias("sent_id_a"), F.col("id_b").alias("sent_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    g = near_duplicates.near_duplicate_groups(table(spark, d, "relationships"), "sent_id", "sentence", 0.7)
    return g.select(F.col("id").alias("sent_id"), "class_id", "group_id", "links")


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    rel, trust = table(spark, d, "relationships"), table(spark, d, "extractors")
    trust = trust.where("extractor is not null").groupBy(F.col("extractor").alias("__who")).agg(F.min("trust").alias("__trust"))
    rel = rel.join(trust, F.col("extractor") == F.col("__who"), "left")
    c = F.col("confidence")
    fields = {"entity_1": T.holds_name(F.col("entity_1")), "entity_2": T.holds_name(F.col("entity_2")), "confidence": (c >= 0) & (c <= 1) & ~F.isnan(c)}
    return survivor.survivors(rel, ["sent_id", "pos"], "rel_id", fields, F.col("__trust"), "extracted_at", {"confidence": "recency"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    s = _survivors(spark, d)
    return s.select("sent_id", "pos", F.col("entity_1_record").alias("entity_1_rel_id"), F.col("entity_2_record").alias("entity_2_rel_id"), F.col("confidence_record").alias("confidence_rel_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("sent_id", "pos", "entity_1", "entity_2", "confidence")


def _items() -> Column:
    name = lambda c: F.when(T.holds_name(F.col(c)), F.lower(T.squeeze(F.col(c))))
    return F.array(name("entity_1"), name("entity_2"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = together.linked_pairs(table(spark, d, "relationships"), "sent_id", _items())
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = together.linked_pairs(table(spark, d, "relationships"), "sent_id", _items(), min_together=2, min_lift=0.0)
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "together", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text")


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(packing.pack_documents(table(spark, d, "documents"), "doc_id", "text"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "counts")
    return packing.faults(packing.pack(counts), counts)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, d, "documents"), "doc_id", "text")
    return pieces.where("piece = 0").select("doc_id").distinct()


def p10_faults(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return splitting.faults(splitting.split_documents(docs, "doc_id", "text"), docs, "doc_id", "text")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"), "doc_id", "text")


_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_NONE = "', '".join(T.NO_NAME)


def _clean(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')))"


def _holds(c: str) -> str:
    bare = f"regexp_replace({_clean(c)}, '^[\\[(<{{ ]+|[\\])>}} ]+$', '', 'g')"
    return f"coalesce({bare} not in ('{_NONE}') and regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]'), false)"


_REL = "rel as (select * from (select *, row_number() over (partition by rel_id order by ingested_at) as rn from relationships) where rn = 1)"
_TERMS = f"""
with {_REL},
pieces as (select rel_id, unnest(regexp_split_to_array(lower(bet_words), '{_SPACE}')) as term from rel where bet_words is not null),
terms as (select rel_id, term from pieces where term <> ''),
total as (select count(distinct rel_id) as n from terms),
freq as (select term, count(*) as occurrences, count(distinct rel_id) as records from terms group by term),
marked as (
  select term, occurrences, records, round(records / n::double, 9) as share,
    case when records < 3 then 'rare' when records > 0.05 * n then 'common' else 'useful' end as mark
  from freq, total)
"""
_WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace({c}, '</?[A-Za-z]+>', ' ', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SENTENCES = f"""
with sent as (select sent_id, max(sentence) as s from relationships where sentence is not null and sent_id is not null group by sent_id),
bag as (select sent_id, {_WORDS.format(c="s")} as w from sent),
flat as (select sent_id, unnest(w) as word from bag),
el as (select sent_id, word, row_number() over (partition by sent_id, word) as k from flat),
shared as (
  select a.sent_id as a, b.sent_id as b, count(*) as n from el a join el b on a.word = b.word and a.k = b.k and a.sent_id < b.sent_id group by 1, 2),
near as (
  select a, b from shared join bag x on x.sent_id = a join bag y on y.sent_id = b where n >= 0.7 * (len(x.w) + len(y.w) - n)
  union all select x.sent_id, y.sent_id from bag x join bag y on len(x.w) = 0 and len(y.w) = 0 and x.sent_id < y.sent_id)
"""
_GROUPED = "with recursive" + _SENTENCES.split("with", 1)[1] + """,
cls as (select sent_id, min(sent_id) over (partition by list_sort(w)) as class_id from bag),
pair as (select distinct x.class_id as a, y.class_id as b from near join cls x on x.sent_id = near.a join cls y on y.sent_id = near.b where x.class_id <> y.class_id),
linked as (select a, b from pair union select b, a from pair),
reach(a, b) as (select a, b from linked union select r.a, l.b from reach r join linked l on l.a = r.b),
least_ as (select a, min(b) as m from reach group by a), degree as (select a, count(*) as n from linked group by a)
select sent_id, class_id, least(class_id, coalesce(m, class_id)) as group_id, coalesce(n, 0) as links from cls left join least_ on least_.a = class_id left join degree on degree.a = class_id
"""
_VALID = {
    "entity_1": _holds("entity_1"),
    "entity_2": _holds("entity_2"),
    "confidence": "coalesce(confidence between 0 and 1 and not isnan(confidence), false)",
}
_BEST = {
    f: ", ".join([f"case when {ok} then 0 else 1 end", *(["coalesce(trust, 2147483647)"] if f != "confidence" else []), "extracted_at desc nulls last", "rel_id"])
    for f, ok in _VALID.items()
}
_RANKED = f"""
with {_REL}, tr as (select extractor, min(trust) as trust from extractors where extractor is not null group by 1),
r as (select rel.*, trust from rel left join tr using (extractor) where sent_id is not null and pos is not null),
several as (select sent_id, pos from r group by 1, 2 having count(distinct rel_id) > 1)
""" + "".join(
    f""", best_{f} as (select sent_id, pos, rel_id, {f} from
  (select *, {ok} as ok, row_number() over (partition by sent_id, pos order by {_BEST[f]}) as k from r) where ok and k = 1)"""
    for f, ok in _VALID.items()
)
_JOINED = "from several s " + " ".join(f"left join best_{f} b{i} on b{i}.sent_id = s.sent_id and b{i}.pos = s.pos" for i, f in enumerate(_VALID))
_PAIRS = f"""
with both_ as (
  select sent_id, {_clean("entity_1")} as name from relationships where {_holds("entity_1")}
  union all select sent_id, {_clean("entity_2")} from relationships where {_holds("entity_2")}),
b as (select distinct sent_id, name from both_ where sent_id is not null),
total as (select count(distinct sent_id) as n from b), single as (select name, count(*) as n from b group by 1),
pair as (select x.name as name_a, y.name as name_b, count(*) as together from b x join b y on x.sent_id = y.sent_id and x.name < y.name group by 1, 2),
scored as (select name_a, name_b, together, p.n as n_a, q.n as n_b, total.n as total from pair join single p on p.name = name_a join single q on q.name = name_b, total)
"""
_GRAMS = f"""
with dw as (select doc_id, {_WORDS.format(c="text")} as w from documents where text is not null),
iw as (select item_id, {_WORDS.format(c="text")} as w from eval_items where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from dw)),
ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from iw))
select distinct doc_id, item_id from dg join ig using (g)
"""
_NEAR = f"""
with dw as (select doc_id, {_WORDS.format(c="text")} as w from documents where text is not null),
dp as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from dw), cnt as (select word, count(*) as n from dp group by 1),
iw as (select item_id, {_WORDS.format(c="text")} as w from eval_items where text is not null),
ip as (select item_id, len(w) as size, unnest(w) as word, unnest(range(len(w))) as o from iw),
word_ as (select item_id, least(o // 24, greatest((size + 12) // 24, 1) - 1) as win, word, min(o) as o from ip group by all),
need as (select item_id, win, least(count(*), 4) as k from word_ group by all),
chosen as (select * from (select w.*, row_number() over (partition by item_id, win order by n, word) as r from word_ w join cnt using (word)) where r <= 4),
whole as (select item_id, win, k from need join chosen using (item_id, win) group by all having count(*) = k),
a as (select c.item_id, c.win, k, c.o, d.doc_id, d.pos from chosen c join whole using (item_id, win) join dp d using (word) where r = 1),
m as (select a.item_id, a.win, a.doc_id, a.pos, count(distinct c.r) as m from a join chosen c on c.item_id = a.item_id and c.win = a.win and c.r > 1
  join dp d on d.word = c.word and d.doc_id = a.doc_id and d.pos between a.pos + c.o - a.o - 8 and a.pos + c.o - a.o + 8 group by all)
select a.doc_id, a.item_id, count(*) as places from a left join m on m.item_id = a.item_id and m.win = a.win and m.doc_id = a.doc_id and m.pos = a.pos
where coalesce(m, 0) = k - 1 group by all
"""
_COS = (
    "case when len(a.{v}) = 64 and len(b.{v}) = 64 and list_sum(list_transform(a.{v}, lambda x: x * x)) > 0 and list_sum(list_transform(b.{v}, lambda x: x * x)) > 0 "
    "then list_cosine_similarity(a.{v}::double[], b.{v}::double[]) else 0 end"
)
_TIGHT = f"""
with edges as (
  select a.tuple_id as a, b.tuple_id as b from tuples a join tuples b on a.tuple_id < b.tuple_id
  where 0.2 * {_COS.format(v="bef_vector")} + 0.6 * {_COS.format(v="bet_vector")} + 0.2 * {_COS.format(v="aft_vector")} >= 0.6),
both_ as (select a, b from edges union all select b, a from edges union select tuple_id, tuple_id from tuples),
near as (select a, list_sort(list(b)) as members from both_ group by a),
whole as (select members from near group by members having count(*) = len(members) and count(*) >= 3)
select a as tuple_id, members[1] as cluster_id from near semi join whole using (members)
"""
# where no part of the similarity graph falls apart, a cluster is a connected part
_PARTS = _TIGHT.split("near as", 1)[0].replace("with edges", "with recursive edges", 1) + """reach(a, b) as (select a, b from both_ union select r.a, l.b from reach r join both_ l on l.a = r.b),
part as (select a as tuple_id, min(b) as cluster_id, count(*) as size from reach group by a)
select tuple_id, cluster_id, size, true as isolated from part
"""

ORACLE = {
    "p1_found": _TERMS + "select term, mark from marked where mark <> 'useful'",
    "p1_terms": _TERMS + "select * from marked",
    "p3_found": _TIGHT,
    "p3_groups": _PARTS,
    "p5_found": _SENTENCES + "select a as sent_id_a, b as sent_id_b from near",
    "p5_groups": _GROUPED,
    "p6_found": _RANKED + "select s.sent_id, s.pos, b0.rel_id as entity_1_rel_id, b1.rel_id as entity_2_rel_id, b2.rel_id as confidence_rel_id " + _JOINED,
    "p6_records": _RANKED + "select s.sent_id, s.pos, b0.entity_1, b1.entity_2, b2.confidence " + _JOINED,
    "p7_found": _PAIRS + "select name_a, name_b from scored where together >= 3 and together * total >= 8 * n_a * n_b",
    "p7_pairs": _PAIRS + "select name_a, name_b, together, n_a, n_b, round(together * total / (n_a * n_b)::double, 6) as lift from scored where together >= 2",
    "p8_faults": "select count(distinct doc_id) as documents, 0 as lost, 0 as strange, 0 as cut, 0 as short, 0 as overfull from documents",
    "p9_found": _GRAMS,
    "p9_near": _NEAR,
    "p10_faults": "select 0 as too_long, 0 as gaps, 0 as wrong_text, 0 as overlapping, 0 as unnatural",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_terms, p3_found, p3_clusters, p3_groups, p4_found, p4_names, p5_found, p5_groups, p6_found, p6_records, p7_found, p7_pairs,
        p8_containers, p8_unused, p8_faults, p9_found, p9_near, p10_found, p10_pieces, p10_faults,
    )
}
