"""Text search, query language, filters, retrieval lanes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.corpus import CHUNK_SHARED, CHUNK_WORDS, FIELDS, LIB, TOK, library, table, text_index
from lexigrove.functions.analysis import FOLD_SQL, LONGEST, tokens
from lexigrove.operators import evidence as V
from lexigrove.operators import ranking as R
from lexigrove.operators import records as K
from lexigrove.operators.filters import DocumentFilter, SearchFilters
from lexigrove.operators.ingest import VectorIndex
from lexigrove.operators.library import Library
from lexigrove.operators.postings import search_many
from lexigrove.plans import compiler
from lexigrove.plans.language import BOOSTS
from lexigrove.registry import query
from lexigrove.session import shared_folder

BASE = f"with {LIB}, {TOK}"
BOOST = "case fld when 'title' then 3.0::double when 'headings' then 2.0::double else 1.0::double end"
#: BM25 of exact terms in SQL: (fld, id, t, s).
BM25 = f"""len as (select fld, id, count(*) as dl from tok group by fld, id),
total as (select count(*) as n from lib),
mean as (select f.fld, coalesce(sum(dl), 0)::double / (select n from total) as avgdl from (values ('title'), ('headings'), ('body')) f(fld) left join len using (fld) group by f.fld),
tf as (select fld, owner_id, id, num, t, count(*) as c from tok group by all),
df as (select fld, t, count(*) as df from tf group by all),
bm as (select tf.fld, tf.owner_id, tf.id, tf.num, tf.t, {BOOST} * ln(1 + ((select n from total) - df + 0.5::double) / (df + 0.5::double)) * c * 2.2::double / (c + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) as s
  from tf join df using (fld, t) join len on len.fld = tf.fld and len.id = tf.id join mean on mean.fld = tf.fld)"""


def hits(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    found = compiler.search(text_index(spark, sf_dir), text, FIELDS, ("owner_id", "id"), whole=True)
    return found.select("owner_id", "id", F.round("score", 6).alias("score"))


@query("t1_vocabulary", f"{BASE} select t as term, count(*) as tokens, count(distinct id) as docs from tok where fld = 'body' group by t")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).words().where("field = 'body'").select("term", "tokens", F.col("documents").alias("docs"))


@query("r1_text_search", f"{BASE}, {BM25} select owner_id, id, round(sum(s), 6) as score, row_number() over (order by round(sum(s), 6) desc, id) as rank from bm where t in ('heon', 'thon', 'anre') group by owner_id, id order by score desc, id limit 50")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(hits(spark, sf_dir, "heon OR thon OR anre"), 50, F.desc("score"), F.asc("id"))


@query("r1_text_batch", f"{BASE}, {BM25}, asked as (select distinct num as query_id, t as term from tok where fld = 'title' and num % 20 = 0), s as (select query_id, id, round(sum(s), 6) as score from bm join asked on asked.term = bm.t group by query_id, id) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10")
def text_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth title as a query for any of its words, all in one plan."""
    index = text_index(spark, sf_dir)
    asked = library(spark, sf_dir).where("num % 20 = 0").select(F.col("num").alias("query_id"), F.explode(tokens(F.col("title"))).alias("x"))
    found = search_many(index, asked.select("query_id", F.col("x.t").alias("term")), 10, BOOSTS, key="id")
    return found.select("query_id", "id", "score", "rank")


@query("r2_filtered_search", f"{BASE}, {BM25} select owner_id, id, round(sum(s), 6) as score, row_number() over (order by round(sum(s), 6) desc, id) as rank from bm where t in ('heon', 'thon') and id in (select id from lib where year >= 2010 and language = 'en') group by owner_id, id order by score desc, id limit 20")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter binds before rank and limit; the statistics are the corpus's."""
    wanted = library(spark, sf_dir).where(SearchFilters(year_min=2010, language="en").column()).select("num")
    found = compiler.search(text_index(spark, sf_dir), "heon OR thon", FIELDS, ("owner_id", "id", "num")).join(wanted, "num", "left_semi").select("owner_id", "id", F.round("score", 6).alias("score"))
    return R.top(found, 20, F.desc("score"), F.asc("id"))


def _ids(name: str, text: str, where: str) -> None:
    """A query whose matches are all that counts."""

    @query(name, f"{BASE} select owner_id, id from lib where {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hits(spark, sf_dir, text).select("owner_id", "id")


_has = lambda cond, fld="fld in ('title', 'headings', 'body')": f"id in (select id from tok where {cond} and {fld})"
_ids("t5_field_scope", "title:thon", _has("t = 'thon'", "fld = 'title'"))
_ids("t5_field_alias", "text:thon h:was", "id in (select id from tok group by id having bool_or(t = 'thon' and fld = 'body') and bool_or(t = 'was' and fld = 'headings'))")
_ids("t6_split_word", "thon-heon", "id in (select id from tok where t in ('thon', 'heon') group by id, fld having count(distinct t) = 2)")
_ids("t7_match_all", "*", "true")
_ids("t8_boolean", "thon AND (heon OR anre) NOT was", f"{_has(chr(116) + ' = ' + repr('thon'))} and ({_has(chr(116) + ' = ' + repr('heon'))} or {_has(chr(116) + ' = ' + repr('anre'))}) and not {_has(chr(116) + ' = ' + repr('was'))}")
_ids("t8_root_not", "NOT was", f"not {_has(chr(116) + ' = ' + repr('was'))}")
_ids("t9_phrase", '"of the"', "id in (select a.id from tok a join tok b on a.id = b.id and a.fld = b.fld and b.p = a.p + 1 where a.t = 'of' and b.t = 'the')")
_ids("t10_wildcard", "th?n*re", _has("regexp_full_match(t, 'th.n.*re')"))
_ids("t11_fuzzy_one", "thno~1", _has("damerau_levenshtein(t, 'thno') <= 1"))
_near = "id in (select a.id from tok a join tok b on a.id = b.id and a.fld = b.fld where a.t = {a} and b.t = {b} and b.p > a.p and b.p - a.p - 1 <= {n})"
_ids("t12_near", "thon w/3 heon", f"({_near.format(a=repr('thon'), b=repr('heon'), n=3)} or {_near.format(a=repr('heon'), b=repr('thon'), n=3)})")
_ids("t12_before", "was pre/5 heon", _near.format(a=repr("was"), b=repr("heon"), n=5))
_ids("t12_near_phrase", '"of the" pre/8 was', "id in (select a.id from tok a join tok b on a.id = b.id and a.fld = b.fld and b.p = a.p + 1 join tok c on c.id = a.id and c.fld = a.fld where a.t = 'of' and b.t = 'the' and c.t = 'was' and c.p > b.p and c.p - b.p - 1 <= 8)")
_ids("t15_owner", "thon", _has("t = 'thon'"))


@query("t13_bm25_all", f"{BASE}, {BM25} select owner_id, id, round(sum(s), 6) as score from bm where t = 'thon' and fld = 'body' group by owner_id, id")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "body:thon")


@query("t14_near_score", f"""{BASE}, {BM25}, m as (select distinct a.fld, a.id from tok a join tok b on a.id = b.id and a.fld = b.fld and a.t = 'thon' and b.t = 'was' and abs(a.p - b.p) between 1 and 6)
select bm.owner_id, bm.id, round(sum(s), 6) as score from bm join m on m.fld = bm.fld and m.id = bm.id where t in ('thon', 'was') group by bm.owner_id, bm.id""")
def near_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "thon w/5 was")


@query("t23_vocabulary_prefix", f"{BASE} select t as term, count(distinct id) as docs from tok where t like 'tho%' group by t order by t limit 100")
def vocabulary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_index(spark, sf_dir).postings().where(F.col("term").startswith("tho")).select("term", "id").distinct()
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).orderBy("term").limit(100)


@query("t24_verify_ids", f"{BASE} select id from lib where num % 10 = 0 and {_has('t = ' + repr('heon'))}")
def verify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = library(spark, sf_dir).where("num % 10 = 0").select("id")
    return wanted.join(hits(spark, sf_dir, "heon"), "id", "left_semi")


@query("t25_clause_truth", f"{BASE} select id, kind, text, positive, holds from (select id, 0 as clause, 'and' as kind, '' as text, true as positive, {_has('t = ' + repr('thon'))} and not {_has('t = ' + repr('heon'))} as holds from lib union all select id, 1, 'word', 'thon', true, {_has('t = ' + repr('thon'))} from lib union all select id, 2, 'not', '', true, not {_has('t = ' + repr('heon'))} from lib union all select id, 3, 'word', 'heon', false, {_has('t = ' + repr('heon'))} from lib)")
def clause_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.explain_clauses(text_index(spark, sf_dir), "thon NOT heon", FIELDS, ("id",)).drop("clause")


SPANS = f"""spans as (select doc_id, i - 1 as position, {FOLD_SQL.format('w')} as t, cast(e - strlen(w) as bigint) as s, cast(e as bigint) as e, w from (
  select doc_id, i, w, sum(strlen(g) + coalesce(strlen(w), 0)) over (partition by doc_id order by i) as e from (
    select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+')) as g, unnest(list_concat(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), [null])) as w,
           generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), 1) as i from documents)) where w is not null and strlen(w) < {LONGEST}),
merged as (select doc_id, min(s) as s, max(e) as e, count(*) as n from (select *, sum(fresh) over (partition by doc_id order by s, e) as run from (
  select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) + GAP then 0 else 1 end as fresh from hits)) group by doc_id, run)
select doc_id, s as start, e as "end", n from merged qualify row_number() over (partition by doc_id order by s) <= 256"""


@query("t25_evidence", "with " + SPANS.replace("merged as (", """hits as (select distinct doc_id, s, e from (
  select doc_id, s, e from spans where t in ('thon', 'heon') union all
  select a.doc_id, a.s, b.e from spans a join spans b on a.doc_id = b.doc_id and b.position = a.position + 1 where a.t = 'of' and b.t = 'the')),
merged as (""").replace("GAP", "0"))
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that speak for each document; what is under NOT does not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return V.evidence(docs, '(thon OR "of the" OR heon) NOT was', {"body": "body"}, "doc_id")


@query("w7_merged_spans", "with " + SPANS.replace("merged as (", "hits as (select doc_id, s, e from spans where t like 'the%'),\nmerged as (").replace("GAP", "12"))
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that begin with the, a dozen bytes apart at most, as one span; the first 256 of each text."""
    rows = V.word_spans(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("term").startswith("the"))
    spans = V.merged_spans(rows, ("doc_id",), gap=12)
    return spans.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))).where("i <= 256").drop("i")


@query("t29_script", "select doc_id, len(regexp_extract_all(text, '\\p{L}')) as letters, len(regexp_extract_all(text, '[^\\p{Latin}\\P{L}]')) as other, len(regexp_extract_all(text, '\\p{L}')) >= 4 and len(regexp_extract_all(text, '[^\\p{Latin}\\P{L}]')) * 4 >= len(regexp_extract_all(text, '\\p{L}')) as nonlatin from documents")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, other, foreign = K.not_latin(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", letters.alias("letters"), other.alias("other"), foreign.alias("nonlatin"))


# Filters, one query for each predicate.

_FILTERS = {
    "p1_owner_language": (SearchFilters(owner="src1", language="en"), "owner_id = 'src1' and language = 'en'"),
    "p2_years": (SearchFilters(year_min=2005, year_max=2011), "year between 2005 and 2011"),
    "p4_extensions": (SearchFilters(extensions=["pdf", "MD"]), "lower(ext) in ('pdf', 'md')"),
    "p5_hash_prefix": (SearchFilters(hash_prefix="A"), "starts_with(source_hash, 'a')"),
    "p6_folder": (SearchFilters(folder_prefix="/lib/en/src1"), "starts_with(parent_dir, '/lib/en/src1')"),
    "p7_duration": (SearchFilters(seconds_min=60, seconds_max=300.5), "audio_seconds >= 60 and audio_seconds <= 300.5"),
    "p8_camera": (SearchFilters(camera="_1%"), "contains(camera, '_1%')"),
    "p9_url": (SearchFilters(url="src5/"), "contains(url, 'src5/')"),
    "p10_tags": (SearchFilters(tags=["person:p3", "org:o3"]), "list_contains(tags, 'person:p3') and list_contains(tags, 'org:o3')"),
    "p11_ids": (SearchFilters(doc_ids=["3", "14", "159", "x"]), "id in ('3', '14', '159', 'x')"),
    "p12_status": (SearchFilters(status="reviewed"), "doc_status = 'reviewed'"),
    "p13_mounted": (SearchFilters(mounted=["vol-a", "vol-c"]), "volume_id is null or volume_id in ('vol-a', 'vol-c')"),
    "p13_none_mounted": (SearchFilters(mounted=[]), "volume_id is null"),
    "p14_literal": (SearchFilters(camera="%"), "contains(camera, '%')"),
    "p16_browse": (DocumentFilter(folder="/lib/en", extensions=["pdf"], name="THE", year_min=2003), "chunk_index <= 0 and starts_with(parent_dir, '/lib/en') and lower(ext) = 'pdf' and (contains(lower(filename), 'the') or contains(lower(title), 'the')) and year >= 2003"),
    "p17_level_two": (DocumentFilter(l2_only=True), "json_extract_string(metadata_json, '$.l2_extracted') = 'true'"),
    "p18_server_folder": (SearchFilters(folder_prefix="\\lib\\de", either_slash=True), "starts_with(parent_dir, '\\lib\\de') or starts_with(parent_dir, '/lib/de')"),
}


def _filter(name: str, f: SearchFilters | DocumentFilter, where: str) -> None:
    @query(name, f"with {LIB} select owner_id, id from lib where {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return library(spark, sf_dir).where(f.column()).select("owner_id", "id")


for _name, (_f, _where) in _FILTERS.items():
    _filter(_name, _f, _where)


@query("p3_translated", f"with {LIB} select id from lib where language = 'de' and title is not null")
def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = library(spark, sf_dir).withColumn("translated_lang", F.col("language")).withColumn("translated", F.col("title"))
    return docs.where(SearchFilters(translated_to="de").column()).select("id")


# Vectors.

VEC = "vec as (select vec_id, vec_id // 2 as doc, embedding::double[] as v, label from embeddings)"
_SIM = "round(1 - least(greatest(1 - list_cosine_similarity(a.v, b.v), 0), 2) / 2, 6)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 2"))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@query("r3_vector_search", f"with {VEC}, s as (select b.doc, b.vec_id, {_SIM} as score from vec a, vec b where a.vec_id = 7), o as (select *, row_number() over (partition by doc order by score desc, vec_id) as r from s) select doc, vec_id, score, row_number() over (order by score desc, doc) as rank from o where r = 1 order by rank limit 20")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 7), 20)


NEAREST = f"with {VEC}, s as (select a.vec_id as query_id, b.vec_id as id, {_SIM} as score from vec a join vec b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), o as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select * from o where rank <= 10"


@query("r3_vector_batch", NEAREST)
def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.nearest(rows.where("id % 20 = 0"), rows, 10)


@query("r4_widened", NEAREST)
def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours from an index, in rounds that read more lists until no other can hold a nearer row."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return VectorIndex(rows).widened(rows.where("id % 20 = 0"), 10).drop("lists")


@query("r6_similar", f"with {VEC} select b.doc, b.vec_id, {_SIM} as score, row_number() over (order by {_SIM} desc, b.vec_id) as rank from vec a, vec b where a.vec_id = 12 and b.vec_id <> 12 order by rank limit 15")
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_vector = F.array(*(F.lit(x) for x in _vector(spark, sf_dir, 12)))
    rows = vectors(spark, sf_dir).where("vec_id <> 12").select("doc", "vec_id", F.round(R.vector_score(F.col("embedding"), query_vector), 6).alias("score"))
    return R.top(rows, 15, F.desc("score"), F.asc("vec_id"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("doc", "vec_id", F.posexplode("embedding").alias("index", "value")).where("value > 0.1").withColumn("value", F.col("value").cast("double"))


@query("r7_sparse_dot", f"with {VEC}, e as (select doc, vec_id, unnest(embedding) as value, generate_subscripts(embedding, 1) - 1 as index from (select vec_id, vec_id // 2 as doc, embedding from embeddings)), s as (select doc, vec_id, round(sum(value::double * case index when 1 then 0.5::double when 5 then 1.5::double else 2.0::double end), 6) as score from e where value > 0.1 and index in (1, 5, 9) group by all having score > 0), o as (select *, row_number() over (partition by doc order by score desc, vec_id) as r from s) select doc, vec_id, score from o where r = 1")
def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sparse_dot(sparse(spark, sf_dir), {1: 0.5, 5: 1.5, 9: 2.0}, "doc", "vec_id")


_MULTI = "(select doc, list(v order by vec_id) as vs from vec group by doc)"


@query("r11_maxsim", f"with {VEC}, q as (select list(v) as qs from vec where vec_id in (3, 8)) select doc, round(list_sum(list_transform(qs, lambda q: list_max(list_transform(vs, lambda v: list_inner_product(q, v))))), 6) as score from {_MULTI} m, q")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    multi = vectors(spark, sf_dir).groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    return multi.select("doc", F.round(R.maxsim([_vector(spark, sf_dir, 3), _vector(spark, sf_dir, 8)], F.col("vs")), 6).alias("score"))


@query("r12_rerank", f"with {VEC}, s as (select b.doc, b.vec_id, {_SIM} as score from vec a, vec b where a.vec_id = 7), o as (select *, row_number() over (partition by doc order by score desc, vec_id) as r from s), f as (select doc, row_number() over (order by score desc, doc) as rank from o where r = 1 order by rank limit 20), g as (select f.doc, f.rank, case when f.doc % 3 <> 0 then round(list_inner_product(x.v, y.v), 6) end as again from f join vec x on x.vec_id = f.doc * 2, vec y where y.vec_id = 9) select doc, rank, again, row_number() over (order by again is null, again desc, rank) as new_rank from g")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 7), 20).select("doc", "rank")
    other = F.array(*(F.lit(x) for x in _vector(spark, sf_dir, 9)))
    scores = vectors(spark, sf_dir).where("vec_id % 2 = 0").select("doc", F.when(F.col("doc") % 3 != 0, F.round(R.dot(F.col("embedding"), other), 6)).alias("again"))
    return R.rerank(scores.join(first, "doc").select("doc", "rank", "again"), "again", "rank")


_LANES = f"""{BASE}, {BM25}, {VEC},
x as (select num as doc, round(sum(s), 6) as score from bm where t in ('heon', 'thon') group by num),
lex as (select doc, row_number() over (order by score desc, doc) as rank from x order by rank limit 100),
y as (select b.vec_id as doc, {_SIM} as score from vec a, vec b where a.vec_id = 7),
den as (select doc, row_number() over (order by score desc, doc) as rank from y order by rank limit 100)"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = compiler.search(text_index(spark, sf_dir), "heon OR thon", FIELDS, ("num",)).select(F.col("num").alias("doc"), F.round("score", 6).alias("score"))
    vector = F.array(*(F.lit(x) for x in _vector(spark, sf_dir, 7)))
    near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.round(R.vector_score(F.col("embedding"), vector), 6).alias("score"))
    return R.top(found, 100, F.desc("score"), F.asc("doc")), R.top(near, 100, F.desc("score"), F.asc("doc"))


@query("r8_rank_fusion", f"{_LANES}, f as (select doc, round(sum(1.0::double / (60 + rank)), 6) as score from (select * from lex union all select * from den) group by doc) select doc, score, row_number() over (order by score desc, doc) as rank from f order by rank limit 50")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, vector = _lanes(spark, sf_dir)
    return R.fuse({"text": text, "vector": vector}, "doc", 50)


@query("r9_hybrid_constrained", f"{_LANES}, f as (select doc, round(sum(1.0::double / (60 + rank)), 6) as score from (select * from lex union all select * from den where doc in (select num from tok where t in ('heon', 'thon'))) group by doc) select f.doc, l.title, f.score, row_number() over (order by f.score desc, doc) as rank from f join lib l on l.num = f.doc order by rank limit 30")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit syntax constrains every lane: vector hits need a text match too."""
    text, vector = _lanes(spark, sf_dir)
    matches = compiler.search(text_index(spark, sf_dir), "heon OR thon", FIELDS, ("num",)).select(F.col("num").alias("doc"))
    fused = R.fuse({"text": text, "vector": vector.join(matches, "doc", "left_semi")}, "doc", 30)
    named = library(spark, sf_dir).select(F.col("num").alias("doc"), "title")
    return named.join(F.broadcast(fused), "doc").select("doc", "title", "score", "rank")  # 30 rows


@query("r14_image_lanes", f"with {VEC}, s as (select b.vec_id, {_SIM} as a, round(1 - least(greatest(1 - list_cosine_similarity(a.v[1:32], b.v[1:32]), 0), 2) / 2, 6) as h from vec a, vec b where a.vec_id = 5 and b.vec_id <> 5), l as (select vec_id, row_number() over (order by a desc, vec_id) as r from s qualify r <= 50 union all select vec_id, row_number() over (order by h desc, vec_id) as r from s qualify r <= 50) select vec_id, round(sum(1.0::double / (60 + r)), 6) as score, row_number() over (order by round(sum(1.0::double / (60 + r)), 6) desc, vec_id) as rank from l group by vec_id order by rank limit 25")
def image_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir, 5)
    rows = table(spark, sf_dir, "embeddings").where("vec_id <> 5")
    lane = lambda col, q: R.top(rows.select("vec_id", F.round(R.vector_score(col, F.array(*(F.lit(x) for x in q))), 6).alias("score")), 50, F.desc("score"), F.asc("vec_id"))
    return R.fuse({"whole": lane(F.col("embedding"), v), "half": lane(F.slice("embedding", 1, 32), v[:32])}, "vec_id", 25)


# Passages.

_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')"
CHUNKS_SQL = f"ch as (select doc_id, i // {CHUNK_WORDS - CHUNK_SHARED} as chunk_index, w[i + 1 : i + {CHUNK_WORDS}] as ws from (select doc_id, w, unnest(range(0, len(w), {CHUNK_WORDS - CHUNK_SHARED})) as i from (select doc_id, {_WORDS} as w from documents)))"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(table(spark, sf_dir, "documents"), "text", CHUNK_WORDS, CHUNK_SHARED, "doc_id")


@query("f4_word_chunks", f"with {CHUNKS_SQL} select doc_id, chunk_index, len(ws) as words, md5(array_to_string(ws, ' ')) as digest from ch")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("chunk", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    return passages(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.size(words).cast("bigint").alias("words"), F.md5(F.array_join(words, " ")).alias("digest"))


_INGESTED = "src as (select doc_id, case when doc_id % 10 = 0 then substring(text, 1, 600) else text end as text, case when doc_id % 10 = 0 then 2 else 1 end as rev, case when doc_id % 10 = 0 then ['new'] else list_sort(list_distinct(list_filter([lang, source], lambda t: t is not null and t <> ''))) end as tags from documents where doc_id % 35 <> 1)"


@query("d1_library", f"with {_INGESTED}, {CHUNKS_SQL.replace('documents', 'src')}, c as (select doc_id, count(*) as chunks, sum(len(ws)) as words from ch group by doc_id) select s.doc_id, s.rev, array_to_string(s.tags, ',') as tags, coalesce(chunks, 0) as chunks, coalesce(words, 0) as embedded_words from src s left join c using (doc_id) where trim(coalesce(s.text, '')) <> ''")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tags and embedded chunks after two batches, the second of which comes twice, and a deletion."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang", "source").alias("tags"), F.lit(1).alias("rev"))
    words = lambda texts: texts.map(lambda t: [float(len(t.split()))])  # noqa: E731 - stands for a model
    held = Library(spark, f"{shared_folder(spark)}/lexigrove-tables/{uuid.uuid4().hex}", ("doc_id",), ("rev",), size=CHUNK_WORDS, shared=CHUNK_SHARED, embed=words)
    held.ingest(docs, applied=("batches", 0))
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.substring("text", 1, 600).alias("text"), F.array(F.lit("new"), F.lit(" "), F.lit("new")).alias("tags"), F.lit(2).alias("rev"))
    held.ingest(new, applied=("batches", 1))
    held.ingest(new, applied=("batches", 1))
    held.delete(docs.where("doc_id % 35 = 1"))
    size = F.coalesce(F.size("chunks"), F.lit(0)).cast("bigint")
    total = F.aggregate(F.coalesce("chunks", F.array().cast(held.documents().schema["chunks"].dataType)), F.lit(0.0), lambda a, c: a + c["vector"][0]).cast("bigint")
    return held.documents().select("doc_id", "rev", F.array_join("tags", ",").alias("tags"), size.alias("chunks"), total.alias("embedded_words"))


@query("r10_best_passage", f"with {CHUNKS_SQL}, s as (select doc_id, chunk_index, (contains(array_to_string(ws, ' '), 'heon'))::int + (contains(array_to_string(ws, ' '), 'thon'))::int as hits from ch), o as (select *, row_number() over (partition by doc_id order by hits desc, chunk_index) as r from s) select doc_id, chunk_index, hits from o where r = 1")
def best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.best_passage(passages(spark, sf_dir).select("doc_id", "chunk_index", "chunk"), ["heon", "thon"], F.col("chunk"), "doc_id")
    return found.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "hits")


@query("r18_passage_context", f"with {CHUNKS_SQL}, k as (select * from ch where (doc_id + chunk_index) % 3 <> 0) select doc_id, chunk_index, lag(chunk_index) over w as previous, lead(chunk_index) over w as following, row_number() over w as number, count(*) over (partition by doc_id) as passages from k window w as (partition by doc_id order by chunk_index)")
def passage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = passages(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index")).where("(doc_id + chunk_index) % 3 <> 0")
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return rows.select("doc_id", "chunk_index", F.lag("chunk_index").over(w).alias("previous"), F.lead("chunk_index").over(w).alias("following"), F.row_number().over(w).alias("number"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("passages"))


_STOP = ", ".join(f"'{w}'" for w in R.STOP)
_PASS = f"""pg as (select doc_id, text, unnest(range(0, 1 + greatest(ceil((length(text) - 1600) / 1400.0)::bigint, 0))) as i from documents),
ps as (select doc_id, i * 1400 as start_char, substring(text, (i * 1400 + 1)::bigint, 1600) as passage from pg),
tk as (select doc_id, start_char, unnest(regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) as t from ps where trim(passage) <> ''),
tl as (select doc_id, start_char, count(*) as n from tk where t not in ({_STOP}) group by all),
cn as (select doc_id, start_char, t, count(*) as c from tk where t in ('heon', 'thon', 'anre') group by all),
al as (select count(*) as n, (select sum(n) from tl)::double / count(*) as mean from ps where trim(passage) <> ''),
df as (select t, count(*) as df from cn group by t)"""


@query("r26_passage_bm25", f"with {_PASS}, s as (select cn.doc_id, cn.start_char, round(sum(ln(1 + (al.n - df + 0.5::double) / (df + 0.5::double)) * c * 2.2::double / (c + 1.2::double * (0.25::double + 0.75::double * tl.n / mean))), 6) as score from cn join df using (t) join tl using (doc_id, start_char), al group by all) select doc_id, start_char, score, row_number() over (order by score desc, doc_id, start_char) as rank from s where score > 0 order by rank limit 24")
def passage_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.windows_of_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = R.passage_bm25(rows, ["what", "heon", "thon", "anre"], "passage", 24, "doc_id", "start_char")
    return found.withColumn("start_char", F.col("start_char").cast("bigint"))


@query("r17_passages_for_answer", f"{BASE}, {BM25}, {CHUNKS_SQL}, h as (select num, round(sum(s), 6) as score from bm where t in ('heon', 'thon') group by num order by score desc, num limit 10), s as (select ch.doc_id, chunk_index, h.score, (contains(array_to_string(ws, ' '), 'heon'))::int + (contains(array_to_string(ws, ' '), 'thon'))::int as hits from ch join h on h.num = ch.doc_id), o as (select *, row_number() over (partition by doc_id order by hits desc, chunk_index) as r from s) select doc_id, chunk_index, hits, score from o where r = 1")
def passages_for_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compiler.search(text_index(spark, sf_dir), "heon OR thon", FIELDS, ("num",)).select(F.col("num").alias("doc_id"), F.round("score", 6).alias("score"))
    first = R.top(found, 10, F.desc("score"), F.asc("doc_id")).drop("rank")
    best = R.best_passage(passages(spark, sf_dir).join(first, "doc_id", "left_semi"), ["heon", "thon"], F.col("chunk"), "doc_id")
    return best.join(first, "doc_id").select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "hits", "score")


@query("r23_group_results", f"with {VEC} select doc, arg_max(vec_id, (score, -vec_id)) as vec_id, max(score) as score, count(*) as hits from (select b.doc, b.vec_id, {_SIM} as score from vec a, vec b where a.vec_id = 7) group by doc")
def group_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array(*(F.lit(x) for x in _vector(spark, sf_dir, 7)))
    rows = vectors(spark, sf_dir).select("doc", "vec_id", F.round(R.vector_score(F.col("embedding"), vector), 6).alias("score"))
    return rows.groupBy("doc").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("vec_id"), F.max("score").alias("score"), F.count(F.lit(1)).alias("hits"))


@query("r29_full_text", "select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, text) as body, count(*) as parts from conversations group by conv_id")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stitched(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
