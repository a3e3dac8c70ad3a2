"""Scans, pages, facets, aggregates, duplicates, graphs, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.corpus import FIELDS, LIB, TOK, library, table, text_index
from lexigrove.operators import browse as B
from lexigrove.operators import complete as C
from lexigrove.operators import duplicates as U
from lexigrove.operators import records as K
from lexigrove.operators import sync as S
from lexigrove.operators.filters import DocumentFilter
from lexigrove.registry import query


@query("s1_scan", "select doc_id, lang, source, n_chars, length(text) as chars from documents")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("chars"))


@query("s2_projection", f"with {LIB} select owner_id, id, title, year, tags from lib")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).select("owner_id", "id", "title", "year", "tags")


@query("s3_predicate_text", "select doc_id, n_chars from documents where n_chars > 500 and lang in ('de', 'fr') and doc_id % 3 = 1")
def predicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("n_chars > 500 and lang in ('de', 'fr') and doc_id % 3 = 1").select("doc_id", "n_chars")


@query("s5_ordered_page", f"with {LIB} select id, year from lib order by year desc nulls last, num offset 15 limit 20")
def ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page(B.ordered(library(spark, sf_dir), "year", True, "num"), 20, 15).select("id", "year")


@query("s6_counts", "select count(*) as n, count(*) filter (lang = 'en' and n_chars > 1000) as long_english from documents")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("lang") == "en") & (F.col("n_chars") > 1000)).alias("long_english"))


@query("s8_hashes", "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("o1_browse_sorts", f"with {LIB}, r as (select 'filename' as by, id, row_number() over (order by filename nulls last, num) as place from lib union all select 'title', id, row_number() over (order by title desc nulls last, num) from lib union all select 'year', id, row_number() over (order by year nulls last, num) from lib union all select 'indexed_at', id, row_number() over (order by indexed_at desc nulls last, num) from lib) select * from r where place <= 30")
def browse_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for by, down in (("filename", False), ("title", True), ("year", False), ("indexed_at", True)):
        first = F.col(by).desc_nulls_last() if down else F.col(by).asc_nulls_last()
        part = B.ordered(library(spark, sf_dir), by, down, "num").limit(30).withColumn("place", F.row_number().over(Window.orderBy(first, "num")))
        part = part.select(F.lit(by).alias("by"), "id", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query("o3_keyset_page", f"with {LIB} select indexed_at, owner_id, id from lib where (indexed_at, owner_id, id) > (1620000000000, 'src3', '5') order by indexed_at, owner_id, id limit 26")
def keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.keyset_page(library(spark, sf_dir).select("indexed_at", "owner_id", "id"), (1620000000000, "src3", "5"), 25)


@query("o2_page", f"with {LIB}, r as (select id, year, row_number() over (order by year desc nulls last, num) as place, count(*) over () as total from lib where language = 'de') select id, year, total, case when total > 60 then '60' end as next from r where place > 40 and place <= 60")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 of one language's documents."""
    docs = library(spark, sf_dir).where(DocumentFilter(language="de").column())
    found = B.paged(docs, "year", True, ("num",), 20, "40")
    return found.rows.select("id", "year", F.lit(found.total).cast("bigint").alias("total"), F.lit(found.next).cast("string").alias("next"))


_COMPLETE = f"with {LIB}, {TOK}, m as (select * from lib where id in (select id from tok where t = 'thon') and id not in (select id from tok where t = 'was'))"


def _complete(spark: SparkSession, sf_dir: str) -> C.Complete:
    return C.Complete(text_index(spark, sf_dir), library(spark, sf_dir), "thon NOT was", FIELDS, ("owner_id", "id"))


@query("r19_complete_matches", f"{_COMPLETE} select owner_id, id, year, row_number() over (order by year is null, year desc, owner_id, id) as place from m")
def complete_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir).ranked("year_desc").select("owner_id", "id", "year", "place")


@query("r20_complete_page", f"{_COMPLETE} select owner_id, id, filename, title from m where (lower(filename), owner_id, id) > ('f12.pdf', 'src0', '0') order by lower(filename), owner_id, id limit 40")
def complete_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir).page("filename", 40, ("f12.pdf", "src0", "0")).select("owner_id", "id", "filename", "title")


@query("r15_filename_channel", f"with {LIB} select id, filename, 0.4::double as score from lib where lower(filename) like '%12%' order by filename, num limit 12")
def filename_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.filename_hits(library(spark, sf_dir), "12", 12, "filename", "num").select("id", "filename", "score")


@query("r16_translated_snippet", f"with {LIB} select id, case when language = 'de' then substring(body, 1, 400) else title end as snippet from lib")
def translated_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.translated_snippets(library(spark, sf_dir), "language", "body", "title", "de").select("id", "snippet")


@query("r30_passages_by_key", "select c.conv_id, c.turn, c.text from conversations c where c.conv_id % 7 = 0 and c.turn = 1 and trim(c.text) <> ''")
def passages_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return K.hydrated(rows, rows.where("conv_id % 7 = 0 and turn = 1").select("conv_id", "turn"), "text").select("conv_id", "turn", "text")


@query("r31_occurrences", f"with {LIB} select parent_dir, id, source_hash from lib where parent_dir = '/lib/en/src0/d1' or source_hash in (select source_hash from lib where num = 3)")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = library(spark, sf_dir)
    return K.at_location(docs, "/lib/en/src0/d1", docs.where("num = 3")).select("parent_dir", "id", "source_hash")


@query("r32_vectors_since", "select vec_id, label from embeddings where 1600000000000 + vec_id * 1000 > 1600000100000 order by vec_id limit 50")
def vectors_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.newer_vectors(table(spark, sf_dir, "embeddings"), F.lit(1600000000000) + F.col("vec_id") * 1000, 1600000100000, "vec_id", 50).select("vec_id", "label")


@query("a1_corpus_stats", f"""with {LIB} select 'documents' as kind, '' as value, count(*) as n from lib union all select 'chunks', '', count(*) from lib union all select 'bytes', '', sum(json_extract_string(metadata_json, '$.fs_size')::bigint)::bigint from lib
union all select 'ext', lower(ext), count(*) from lib where ext <> '' group by lower(ext) union all select 'language', language, count(*) from lib group by language union all select 'year', year::varchar, count(*) from lib where year is not null group by year
union all (select 'tag', tag, count(*) as n from (select unnest(tags) as tag from lib) group by tag order by n desc, tag limit 50)""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.corpus_stats(library(spark, sf_dir))


@query("a2_tag_facets", f"with {LIB} select tag, count(*) as n from (select unnest(tags) as tag from lib where language = 'en') where tag <> '' and not starts_with(tag, 'collection:') group by tag order by n desc, tag limit 40")
def tag_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tag_facets(library(spark, sf_dir).where("language = 'en'"), 40)


def _facet(kind: str, value: str, missing: str) -> str:
    return f"select '{kind}' as kind, v as value, n, row_number() over (order by n desc, v) as rank, (select count(*) from {kind}_c) as distinct, greatest((select count(*) from {kind}_c) - 25, 0) as omitted, (select count(*) from m where {missing}) as missing from {kind}_c qualify rank <= 25"


@query("a3_search_facets", f"{_COMPLETE}, extension_c as (select lower(ext) as v, count(*) as n from m where ext <> '' group by 1), language_c as (select language as v, count(*) as n from m where language <> '' group by 1), year_c as (select year::varchar as v, count(*) as n from m where year is not null group by 1), tag_c as (select v, count(*) as n from (select unnest(tags) as v from m) group by 1) {_facet('extension', 'ext', chr(101) + 'xt = ' + repr(''))} union all {_facet('language', '', 'language is null')} union all {_facet('year', '', 'year is null')} union all {_facet('tag', '', 'false')}")
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir).facets()


@query("a4_url_duplicates", f"with {LIB} select url as key, count(*) over w as n, min(id) over w as first, id as member from lib where url <> '' window w as (partition by url) qualify n > 1")
def url_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.groups_of(library(spark, sf_dir), F.col("url"), "id")


@query("a5_folder_children", f"with {LIB} select split_part(substring(parent_dir, 9), '/', 1) as name, count(*) as n from lib where starts_with(parent_dir, '/lib/en/') group by 1")
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.folder_children(library(spark, sf_dir), "/lib/en")


@query("a6_exact_groups", f"with {LIB} select source_hash as key, count(*) over w as n, min(id) over w as first, id as member from lib window w as (partition by source_hash) qualify n > 1")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.groups_of(library(spark, sf_dir), F.col("source_hash"), "id")


@query("a7_verified_duplicates", "with c as (select strlen(text) as size, count(*) as n from documents group by 1 having n > 1) select sha256(text) as key, strlen(text) as size, count(*) as n, min(doc_id) as first_id from documents where strlen(text) in (select size from c) group by 1, 2 having count(*) > 1")
def verified_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes first; only texts whose size is shared are hashed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("bigint").alias("size"))
    shared = docs.groupBy("size").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("size")
    hashed = docs.join(shared, "size", "left_semi").select("doc_id", "size", F.sha2("text", 256).alias("key"))
    return hashed.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_ITEMS = {
    "place": "doc_id",
    "path": "case when doc_id % 11 = 0 then concat('/d/', cast(cast(floor(doc_id / 2) as bigint) as {string})) when doc_id % 17 = 0 then concat('drive://', cast(doc_id as {string})) else concat('/d/', cast(doc_id as {string})) end",
    "status": "case when doc_id % 9 = 0 then 'done' else 'ready' end",
}
_SCAN = (
    "with i as (select " + ", ".join(f"{e.format(string='varchar')} as {n}" for n, e in _ITEMS.items()) + ", cast(strlen(text) as bigint) as size, case when doc_id % 23 <> 0 then sha256(text) end as h from documents), "
    "y as (select *, case when path like '%://%' then 'remote document' when status = 'done' then 'busy or sorted already' when size is null then 'size unknown' when size > 20000 then 'too large to verify' end as why from i), "
    "f as (select *, row_number() over (partition by path order by place) as k from y where why is null), c as (select *, count(*) over (partition by size) as n from f where k = 1), "
    "g as (select size, h, min(place) as grp, count(*) as m from c where n > 1 and h is not null group by 1, 2 having count(*) > 1) "
    "select place, path, size, 'skipped' as outcome, why as reason, null as sha256, null::bigint as grp, null::bigint as members from y where why is not null "
    "union all select place, path, size, 'skipped', 'the path is in the list already', null, null, null from f where k > 1 "
    "union all select c.place, c.path, c.size, case when n = 1 then 'unique' when c.h is null then 'failed' when g.grp is null then 'unique' else 'duplicate' end, case when n > 1 and c.h is null then 'no SHA-256' end, case when n > 1 then c.h end, g.grp, g.m from c left join g on c.n > 1 and g.size = c.size and g.h = c.h"
)


@query("a7_duplicate_scan", _SCAN)
def duplicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: duplicates with their group, and why others were not looked at."""
    items = table(spark, sf_dir, "documents").select(*(F.expr(e.format(string="string")).alias(n) for n, e in _ITEMS.items()), F.octet_length("text").cast("bigint").alias("size"), "text")
    return U.duplicate_scan(items, F.when(F.col("place") % 23 != 0, F.sha2("text", 256)), 20_000).withColumnRenamed("group", "grp")


@query("a9_entity_graph", f"with {LIB}, t as (select distinct owner_id, id, unnest(tags) as tag from lib), f as (select tag, count(*) as n from t where starts_with(tag, 'person:') or starts_with(tag, 'org:') group by tag order by n desc, tag limit 100) select a.tag as a, b.tag as b, count(*) as weight from t a join t b on a.owner_id = b.owner_id and a.id = b.id and a.tag < b.tag where a.tag in (select tag from f) and b.tag in (select tag from f) group by 1, 2 having weight >= 2")
def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.entity_graph(library(spark, sf_dir))


@query("j9_tag_pairs", f"with {LIB}, t as (select distinct owner_id, id, unnest(tags) as tag from lib) select a.tag as a, b.tag as b, count(*) as n from t a join t b on a.owner_id = b.owner_id and a.id = b.id and a.tag < b.tag group by 1, 2")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tag_pairs(library(spark, sf_dir))


_BITS = "((vec_id // 3) * 2654435761 * 97 + (1::bigint << (vec_id % 23)))"


@query("j8_near_hashes", f"with v as (select min(vec_id) as k, xor(((vec_id // 3) * 2654435761 * 97)::bigint, (1::bigint << (vec_id % 23))) as h from embeddings group by 2) select a.k as a, b.k as b, bit_count(xor(a.h, b.h)) as distance from v a join v b on a.k < b.k where bit_count(xor(a.h, b.h)) <= 6")
def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.expr("((vec_id div 3) * 2654435761 * 97) ^ shiftleft(1L, cast(vec_id % 23 as int))")
    return B.hamming_pairs(table(spark, sf_dir, "embeddings").select("vec_id", h.alias("h")), "vec_id", "h", 6)


@query("a8_near_groups", "select vec_id as k, vec_id // 3 * 3 as first from embeddings")
def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links between hashes at most two bits apart: here three hashes each that differ in single bits."""
    from lexigrove.operators.graph import components

    h = F.expr("((vec_id div 3) * 2654435761 * 97) ^ shiftleft(1L, cast(vec_id % 3 as int)) ^ shiftleft(cast(vec_id div 3 as bigint), 40)")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", h.alias("h"))
    found = components(B.hamming_pairs(rows, "vec_id", "h", 2).select("a", "b"))
    return rows.select(F.col("vec_id").alias("k")).join(found.select(F.col("node").alias("k"), "root"), "k", "left").select("k", F.coalesce("root", "k").alias("first"))


@query("a10_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("a11_top_terms", r"with t as (select lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:200]) as term from documents), p as (select lang, doc_id, term, count(*) as c from t group by all), d as (select term, count(*) as df from p group by term), s as (select lang, term, round(sum(c) * ln((select count(*) from documents)::double / any_value(df)), 6) as score from p join d using (term) group by lang, term) select lang, term, score, row_number() over (partition by lang order by score desc, term) as rank from s qualify rank <= 10")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_terms(table(spark, sf_dir, "documents"), "lang", "text", 10)


@query("a12_audit_counts", "select event_type as action, count(*) as n, max(event_id) as last from events where event_id >= 100 group by 1")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.audit_counts(table(spark, sf_dir, "events"), 100, "event_type", "event_id")


@query("a12_audit_page", "select event_id, user_id, event_type from events where event_type = 'click' order by ts desc, event_id desc offset 10 limit 25")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.audit_page(table(spark, sf_dir, "events"), "click", 25, 10, "event_type", key="event_id").select("event_id", "user_id", "event_type")


@query("a13_author_counters", "select p_brand as author, count(*) as n from part where contains(lower(p_name), 'a') group by 1")
def author_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.named_counts(table(spark, sf_dir, "part"), "p_brand", "a", "p_name")


@query("a14_representatives", "select conv_id, arg_min(text, turn) as first_text, list_sort(list(distinct role)) as roles from conversations group by conv_id")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.representatives(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role").withColumnRenamed("tags", "roles")


@query("a15_catalogue_totals", "select lang as catalogue, count(*) as files, sum(n_chars)::bigint as size from documents group by 1")
def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.catalogue_totals(table(spark, sf_dir, "documents"), "lang", "n_chars")


_RUNS = "r as (select doc_id % 17 as query_id, doc_id, row_number() over (partition by doc_id % 17 order by n_chars desc, doc_id) as rank from documents), j as (select doc_id % 17 as query_id, doc_id, quality * 2 + toxic as grade from labels)"


@query("a17_retrieval_metrics", f"with {_RUNS}, s as (select r.query_id, r.rank, j.grade from r left join j using (query_id, doc_id) where rank <= 20), g as (select query_id, count(*) filter (grade > 0) as hits, sum(case when grade > 0 then (pow(2.0, grade) - 1) / log2(rank + 1.0) else 0 end) as dcg, max(case when grade > 0 then 1.0 / rank else 0 end) as mrr, count(*) filter (grade is null) as unjudged from s group by 1), b as (select query_id, grade, row_number() over (partition by query_id order by grade desc, doc_id) as r from j where grade > 0), i as (select query_id, count(*) as relevant, sum(case when r <= 20 then (pow(2.0, grade) - 1) / log2(r + 1.0) else 0 end) as idcg from b group by 1) select query_id, relevant, coalesce(unjudged, 0) as unjudged, round(coalesce(hits, 0) / 20.0::double, 6) as precision, round(coalesce(hits, 0) / relevant::double, 6) as recall, round(coalesce(dcg, 0) / idcg, 6) as ndcg, round(coalesce(mrr, 0)::double, 6) as mrr from i left join g using (query_id)")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 17).alias("query_id"), "doc_id", "n_chars")
    runs = docs.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    judged = table(spark, sf_dir, "labels").select((F.col("doc_id") % 17).alias("query_id"), "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("grade"))
    return B.retrieval_metrics(runs, judged, 20)


@query("a17_percentiles", "select f as fraction, (select value from (select value, row_number() over (order by value) as r, count(*) over () as n from events where value is not null) where r = greatest(ceil(n * f), 1)::bigint) as value from (values (0.5::double), (0.95::double)) t(f)")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nearest_rank(table(spark, sf_dir, "events"), "value", 0.5, 0.95)


@query("a18_leaderboard", "select l_returnflag as device, l_linestatus as engine_id, count(*) as units, count(*) filter (l_quantity < 40) as ok, count(*) filter (l_quantity >= 40) as failed, round(avg(l_discount) filter (l_quantity < 40), 6) as mean_cer, round(avg(case when l_quantity < 40 then l_discount else 1.0 end), 6) as penalised_cer, round(median(l_tax) filter (l_quantity < 40), 6) as median_seconds, max(l_extendedprice) as peak from lineitem group by 1, 2")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.leaderboard(table(spark, sf_dir, "lineitem"), {"device": "l_returnflag", "engine_id": "l_linestatus"}, F.col("l_quantity") < 40, "l_discount", "l_tax", "l_extendedprice")


@query("a19_job_status", "select o_orderstatus as status, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as urgent from orders group by 1")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", urgent=F.col("o_orderpriority") == "1-URGENT")


@query("a20_queue_statistics", "select count(*) as total, count(*) filter (event_type = 'click') as clicks, count(*) filter (value > 50) as large, count(*) filter (user_id % 5 = 0 and value <= 10) as purged from events")
def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return K.queue_statistics(table(spark, sf_dir, "events"), clicks=c("event_type") == "click", large=c("value") > 50, purged=(c("user_id") % 5 == 0) & (c("value") <= 10))


@query("a21_approved_values", "select p_brand as label, min(p_type) as value, count(distinct p_type) as different, count(distinct p_type) > 1 as conflict from part where p_size > 45 group by 1")
def approved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.approved_values(table(spark, sf_dir, "part").where("p_size > 45"), "p_brand", "p_type")


@query("d12_jobs", "with t as (select event_id as id, event_id % 50 as priority, event_id % 900 as due, row_number() over (order by event_id % 50 desc, event_id % 900, event_id) as r from events where event_id % 3 <> 0 and event_id % 900 <= 500) select e.event_id as id, case when r is null then case when e.event_id % 3 = 0 then 'done' else 'queued' end when e.event_id % 2 = 0 then 'done' else 'queued' end as status, case when r is not null and e.event_id % 2 = 1 then 560 else e.event_id % 900 end as due, case when r is not null then 1 else 0 end as attempts from events e left join t on t.id = e.event_id and r <= 100")
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker claims a hundred jobs and reports that every second one failed."""
    none = F.lit(None)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("queued").alias("status"), (F.col("event_id") % 50).alias("priority"), (F.col("event_id") % 900).alias("due"))
    queue = events.select("*", none.cast("string").alias("worker"), none.cast("bigint").alias("leased_until"), F.lit(0).alias("attempts"))
    taken = K.claim(queue, "w", 500, 100, 60)
    results = taken.where("worker = 'w'").select("id", "worker", (F.col("id") % 2 == 0).alias("ok"))
    return K.settle(taken, results, 500).select("id", "status", "due", "attempts")


@query("x6_coalesced", "with e as (select user_id % 40 as path, case event_id % 3 when 0 then 'created' when 1 then 'modified' else 'deleted' end as event, event_id as ts from events) select path, arg_max(event, ts) as event, max(ts) as ts, count(*) as n from e group by path having not (arg_min(event, ts) = 'created' and arg_max(event, ts) = 'deleted')")
def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_id % 3 when 0 then 'created' when 1 then 'modified' else 'deleted' end")
    return K.coalesced(table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("path"), kind.alias("event"), F.col("event_id").alias("ts")))


@query("w3_latest_rows", "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("w4_versions", f"with {LIB} select parent_dir, id, row_number() over (partition by parent_dir order by indexed_at, num) as version, lead(1) over (partition by parent_dir order by indexed_at, num) is null as current from lib")
def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.versions(library(spark, sf_dir), "parent_dir", "indexed_at", "num").select("parent_dir", "id", "version", "current")


@query("w8_citation_keys", "select c_custkey, concat(split_part(c_name, '#', 1), cast(c_nationkey as varchar), case when r > 1 then '_' || r else '' end) as key from (select *, row_number() over (partition by c_nationkey order by c_custkey) as r from customer)")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.substring_index("c_name", "#", 1), F.col("c_nationkey").cast("string"))
    return K.citation_keys(table(spark, sf_dir, "customer"), base, "c_nationkey", "c_custkey").select("c_custkey", "key")


@query("c8_shards", """with recursive f as (select lang as g, 'f' || lpad(doc_id::varchar, 9, '0') as path, n_chars as size, row_number() over (partition by lang order by doc_id) as i, sum(n_chars) over (partition by lang) / 4.0 as share from documents),
r as (select g, path, i, share, 0 as shard, size as held from f where i = 1 union all select f.g, f.path, f.i, f.share, case when r.held >= r.share and r.shard < 3 then r.shard + 1 else r.shard end, case when r.held >= r.share and r.shard < 3 then f.size else r.held + f.size end from r join f on f.g = r.g and f.i = r.i + 1)
select g as "group", path, shard from r""")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.shards(docs.select(F.col("lang").alias("group"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("n_chars").alias("size")), 4)


# Sync.

_SIDES = "l as (select doc_id, concat('p/', cast(doc_id as varchar)) as path, n_chars as size, case when doc_id % 11 = 0 then 0 else 1000 + doc_id % 50 end as mtime, sha256(text) as source_hash, substring(text, 1, 20) as title, case when doc_id % 9 = 0 then null else 1000 + doc_id % 40 end as updated_at from documents where doc_id % 4 <> 3), r as (select doc_id, concat('p/', cast(doc_id as varchar)) as path, n_chars + case when doc_id % 3 = 0 then 1 else 0 end as size, case when doc_id % 13 = 0 then null else 1000 + doc_id % 47 end as mtime, case when doc_id % 2 = 0 then sha256(text) else 'x' end as source_hash, substring(text, 1, 20 + doc_id % 2) as title, case when doc_id % 8 = 0 then null else 1000 + doc_id % 37 end as updated_at from documents where doc_id % 5 <> 4)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path")
    e = F.expr
    left = docs.where("doc_id % 4 <> 3").select("doc_id", path, F.col("n_chars").alias("size"), e("case when doc_id % 11 = 0 then 0 else 1000 + doc_id % 50 end as mtime"), F.sha2("text", 256).alias("source_hash"), e("substring(text, 1, 20) as title"), e("case when doc_id % 9 = 0 then null else 1000 + doc_id % 40 end as updated_at"))
    right = docs.where("doc_id % 5 <> 4").select("doc_id", path, e("n_chars + case when doc_id % 3 = 0 then 1 else 0 end as size"), e("case when doc_id % 13 = 0 then null else 1000 + doc_id % 47 end as mtime"), e("case when doc_id % 2 = 0 then sha2(text, 256) else 'x' end as source_hash"), e("substring(text, 1, cast(20 + doc_id % 2 as int)) as title"), e("case when doc_id % 8 = 0 then null else 1000 + doc_id % 37 end as updated_at"))
    return left, right


_NEWEST = "case when l.mtime = 0 or r.mtime is null or r.mtime = 0 then 'manual_review' when l.mtime > r.mtime then 'use_local' when l.mtime < r.mtime then 'use_remote' else 'manual_review' end"


@query("c5_compare_plans", f"with {_SIDES} select coalesce(l.path, r.path) as path, case when l.path is null then 'remote_only' when r.path is null then 'local_only' when l.size = r.size and l.mtime = r.mtime and l.mtime <> 0 then 'unchanged' else {_NEWEST} end as newest, case when l.path is null then 'remote_only' when r.path is null then 'local_only' when l.size = r.size and l.mtime = r.mtime then 'unchanged' else 'keep_both' end as both from l full join r on l.path = r.path")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    a = S.compare_plans(left, right, "newest_wins").withColumnRenamed("action", "newest")
    return a.join(S.compare_plans(left, right, "keep_both").withColumnRenamed("action", "both"), "path")


@query("c6_push_plan", f"with {_SIDES} select l.path, l.size from l left join r on l.path = r.path where r.path is null or not (l.size = r.size and coalesce(l.mtime = r.mtime, false))")
def push(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return S.push_plan(left, right, "local_wins").select("path", "size")


_NEW = "(coalesce(r.updated_at > l.updated_at, false) or (r.updated_at is not null and l.updated_at is null))"


@query("c4_conflicts", f"with {_SIDES} select l.doc_id, case when {_NEW} then 'use_remote' else 'use_local' end as newest_wins, 'use_local' as local_wins, 'use_remote' as remote_wins, case when l.source_hash = r.source_hash then 'use_local' else 'keep_both' end as keep_both, case when l.source_hash = r.source_hash then case when l.title <> r.title or coalesce(r.updated_at > l.updated_at, false) then 'manual_review' else 'use_local' end else 'manual_review' end as manual from l join r using (doc_id)")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    both = left.alias("l").join(right.alias("r"), F.col("l.doc_id") == F.col("r.doc_id"))
    return both.select("l.doc_id", *(S.resolution(p).alias(p) for p in S.POLICIES))


@query("c1_changes", f"with {LIB}, g as (select owner_id, id, max(indexed_at + 7) as indexed_at from lib where num % 6 = 0 and indexed_at + 7 between 1610000000000 and 1660000000000 group by 1, 2), f as (select indexed_at, owner_id, id, false as deleted from lib where num % 12 <> 0 and indexed_at between 1610000000000 and 1660000000000 union all select indexed_at, owner_id, id, true from g where (owner_id, id) not in (select (owner_id, id) from lib where num % 12 <> 0)) select * from f order by indexed_at, owner_id, id limit 101")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = library(spark, sf_dir)
    gone = docs.where("num % 6 = 0").withColumn("indexed_at", F.col("indexed_at") + 7)
    return B.keyset_page(S.changes(docs.where("num % 12 <> 0"), gone, 1610000000000, 1660000000000), None, 100)


@query("j7_catalogue_duplicates", "select a.p_partkey as source, min(b.p_partkey) as copy, count(*) as copies from part a join part b on a.p_size = b.p_size and a.p_name = b.p_name and a.p_partkey < b.p_partkey group by 1")
def catalogue_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.catalogue_duplicates(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_name")


@query("c7_delta_summary", "with b as (select doc_id, encode(text) as d, encode(case when doc_id % 3 = 0 then concat(substring(text, 1, 100), '#', substring(text, 102)) else text end) as e, octet_length(encode(text)) as n from documents), k as (select *, unnest(range(0, greatest(ceil(n / 256.0)::bigint, 1))) as i from b), c as (select doc_id, i, least(256, n - i * 256) as length, n, sha256(substring(hex(d), i * 512 + 1, 512)) <> sha256(substring(hex(e), i * 512 + 1, 512)) as diff from k where n > 0) select doc_id, count(*) as blocks, count(*) filter (diff) as changed, coalesce(sum(length) filter (diff), 0)::bigint as bytes, round(1 - coalesce(sum(length) filter (diff), 0) / max(n)::double, 6) as savings from c group by doc_id")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 100), F.lit("#"), F.substr("text", F.lit(102)))).otherwise(F.col("text")))
    local = S.blocks(docs, "doc_id", "text", 256)
    return S.delta_summary(local, S.changed_blocks(local, S.blocks(other, "doc_id", "text", 256), "doc_id"), "doc_id")


_RULES = ((1, "folder", "/de/", 100, 400, True), (2, "tag", "person:p3", 10, None, True), (3, "folder", "src1", None, 300, True), (4, "folder", "/", 1, 2, False), (5, "folder", "/lib", 600, None, True))
_NOW = 1650000000000


@query("d8_retention", f"with {LIB}, rules(rule, match_type, match_value, archive_days, delete_days, enabled) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in _RULES) + f"), h as (select owner_id, id, rule, case when ({_NOW} - indexed_at) // 86400000 >= delete_days then 'delete' when ({_NOW} - indexed_at) // 86400000 >= archive_days then 'archive' end as action from lib join rules on enabled and case match_type when 'folder' then contains(parent_dir, match_value) when 'tag' then list_contains(tags, match_value) else false end where indexed_at <= {_NOW}) select id, rule, action from (select *, row_number() over (partition by owner_id, id order by rule) as r from h where action is not null) where r = 1")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retention(library(spark, sf_dir).where(F.col("indexed_at") <= _NOW), list(_RULES), _NOW)


@query("p20_automation", f"with {LIB} select id, case when lower(ext) = 'pdf' and strlen(body) between 500 and 100000 then 1 when starts_with(parent_dir, '/lib/de') or list_contains(tags, 'org:o3') then 2 end as priority, case when lower(ext) = 'pdf' and strlen(body) between 500 and 100000 then 'large' else 'shelf' end as rule from lib where (lower(ext) = 'pdf' and strlen(body) between 500 and 100000) or starts_with(parent_dir, '/lib/de') or list_contains(tags, 'org:o3')")
def automation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        {"name": "shelf", "priority": 2, "mode": "any", "triggers": [("folder", "/lib/de"), ("tag", "org:o3")]},
        {"name": "large", "priority": 1, "triggers": [("extension", ["PDF"]), ("size", (500, 100000))]},
        {"name": "off", "priority": 0, "enabled": False, "triggers": [("folder", "/")]},
        {"name": "none", "priority": 0, "triggers": []},
    ]
    return S.automation(library(spark, sf_dir).withColumn("size", F.octet_length("body")), rules)


@query("d3_promote", f"with {LIB} select id, coalesce(p.title, lib.title) as title, greatest(1 + num % 3, coalesce(p.level, 0)) as level from lib left join (select item_id, substring(text, 1, 12) as title, 2 as level from benchmark) p on p.item_id = lib.num")
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("num"), F.substring("text", 1, 12).alias("title"), F.lit(2).cast("bigint").alias("level"))
    rows = library(spark, sf_dir).select("id", "num", "title", (1 + F.col("num") % 3).alias("level"))
    return K.promoted(rows, better, "num", ("title",)).select("id", "title", "level")


@query("d4_delete", f"with {LIB} select owner_id, id from lib where num not in (select doc_id from labels where toxic = 1)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("num"))
    return K.deleted(library(spark, sf_dir), gone, "num").select("owner_id", "id")


@query("d6_update", f"with {LIB} select id, case when num % 10 = 0 then 'reviewed' else doc_status end as doc_status, case when starts_with(parent_dir, '/lib/en/') then concat('/moved', substring(parent_dir, 5)) else parent_dir end as parent_dir from lib")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = F.when(F.col("num") % 10 == 0, "reviewed").otherwise(F.col("doc_status"))
    return library(spark, sf_dir).select("id", reviewed.alias("doc_status"), K.moved(F.col("parent_dir"), "/lib/en", "/moved/en").alias("parent_dir"))


@query("d7_purge", "with d as (select doc_id as id, doc_id * 7919 % 1009 as indexed_at, n_chars as size, n_chars // 2 as heavy from documents), t as (select sum(size) as s, sum(heavy) as h, sum(size) - sum(size) * 3 // 10 as over from d), o as (select *, coalesce(sum(heavy) over w, 0) as freed, coalesce(sum(size - heavy) over w, 0) as gone from d window w as (order by indexed_at, id rows between unbounded preceding and 1 preceding)) select id, case when gone < greatest(over - h, 0) then 'delete' when freed < over then 'strip' else 'keep' end as action from o, t")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 1009).alias("indexed_at"), F.col("n_chars").alias("size"), F.expr("n_chars div 2").alias("heavy"))
    most = docs.agg(F.expr("sum(size) * 3 div 10")).first()[0]
    return S.purge(docs, most)


@query("d9_failed", "select event_id, json_extract_string(props, '$.k') as reason from events where json_extract_string(props, '$.k')::int % 7 = 0 and value < 20")
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.get_json_object("props", "$.k")
    return K.failed_extractions(table(spark, sf_dir, "events"), reason, (reason.cast("int") % 7 == 0) & (F.col("value") < 20), "event_id")
