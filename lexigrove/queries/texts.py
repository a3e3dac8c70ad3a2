"""Text utilities, readers and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.corpus import LIB, library, table
from lexigrove.functions import text as X
from lexigrove.functions.analysis import FOLD_SQL, folded
from lexigrove.operators import records as K
from lexigrove.operators.browse import placed
from lexigrove.operators.passages import matched
from lexigrove.registry import query


@query("f1_truncate", "select doc_id, substring(text, 1, 57) as head, length(substring(text, 1, 57)) as n from documents")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 57).alias("head"), F.length(F.substring("text", 1, 57)).alias("n"))


_SHOWN = "replace(replace(replace(replace(replace(regexp_replace(substring(text, (b + 1)::bigint, 300), '(?i)(heon|thon)', chr(57344) || '\\1' || chr(57345), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query("f2_snippet", f"with d as (select doc_id, text, length(text) as n, regexp_matches(text, '(?i)heon|thon') as has, length(regexp_extract(text, '(?is)^(.*?)(?:heon|thon)', 1)) as p from documents), e as (select *, case when greatest(p - 100, 0) + 300 >= n then greatest(n - 300, 0) else greatest(p - 100, 0) end as a from d), f as (select *, case when has then least(a, p) else 0 end as b from e) select doc_id, case when regexp_matches(text, '\\S') then case when b > 0 then '…' else '' end || replace(replace({_SHOWN}, chr(57344), '<mark>'), chr(57345), '</mark>') || case when b + 300 < n then '…' else '' end end as snippet from f")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "heon thon").alias("snippet"))


@query("f3_summary", r"with p as (select doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+\z'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0)[1:3] as s from documents), g as (select *, case when strlen(coalesce(s[1], '')) >= 300 then s[1] when strlen(array_to_string(s[1:2], ' ')) >= 300 then array_to_string(s[1:2], ' ') else array_to_string(s, ' ') end as grown from p), w as (select doc_id, unnest(string_split(grown, ' ')) as w, generate_subscripts(string_split(grown, ' '), 1) as i from g), c as (select *, sum(strlen(w) + 1) over (partition by doc_id order by i) as upto from w), h as (select doc_id, string_agg(w, ' ' order by i) filter (upto <= 300) as whole from c group by doc_id) select doc_id, case when strlen(text) >= 50 and strlen(grown) >= 30 then case when strlen(grown) <= 300 then grown else coalesce(nullif(whole, ''), list_last(list_filter(list_transform(range(0, 301), lambda k: substring(grown, 1, k)), lambda x: strlen(x) <= 300))) || '…' end end as summary from g left join h using (doc_id)")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


_EXT = "case doc_id % 9 when 0 then 'eml' when 1 then 'py' when 2 then 'jpg' else 'pdf' end"
_OPENINGS = ("Dear Sir, invoice with payment, vat and subtotal. Sincerely, ", "Signature: Date: applicant ", "Abstract. Introduction. ", "Specification of requirements, scope and revision. ", "This agreement: each party shall be bound, hereby and whereas. ")
_TEXT = "case doc_id % 7 " + " ".join(f"when {i} then concat('{t}', text)" for i, t in enumerate(_OPENINGS)) + " else text end"


@query("f6_doctype", f"with d as (select doc_id, {_EXT} as ext, {_TEXT} as t, doc_id % 8 as pages from documents), e as (select doc_id, ext, lower(t) as low, strlen(t) as size, pages from d) select doc_id, {X.doctype_sql('len(list_filter([{words}], lambda w: contains(low, w)))')} as doctype from e")
def doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EXT).alias("ext"), F.expr(_TEXT).alias("t"), (F.col("doc_id") % 8).alias("pages"))
    return X.doctypes(docs, "ext", "t", "pages", "doc_id")


_EAN = "list_sum([ (substring(w, i, 1))::int * case when i % 2 = 1 then 1 else 3 end for i in range(1, 14) ])"
_UPC = "list_sum([ (substring(w, i, 1))::int * case when i % 2 = 1 then 3 else 1 end for i in range(1, 13) ])"


@query("f7_barcodes", f"with d as (select doc_id, case doc_id % 5 when 0 then lpad((9780000000000 + doc_id * 7919)::varchar, 13, '0') when 1 then lpad((4000000000000 + doc_id * 104729)::varchar, 13, '0') when 2 then lpad((doc_id * 15485863)::varchar, 12, '0') when 3 then lpad((doc_id % 10000)::varchar, 4, '0') || '-' || lpad((doc_id * 3 % 1000)::varchar, 3, '0') || 'X' else 'word' end as w from documents) select doc_id, case when regexp_full_match(w, '[0-9]{{13}}') then case when {_EAN} % 10 = 0 then case when starts_with(w, '978') or starts_with(w, '979') then 'barcode:isbn13:' || w else 'barcode:ean13:' || w end end when regexp_full_match(w, '[0-9]{{12}}') then case when {_UPC} % 10 = 0 then 'barcode:upca:' || w end when regexp_full_match(w, '[0-9]{{4}}-[0-9]{{3}}[0-9Xx]') then 'barcode:issn:' || w end as tag from d")
def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.expr("case doc_id % 5 when 0 then lpad(cast(9780000000000 + doc_id * 7919 as string), 13, '0') when 1 then lpad(cast(4000000000000 + doc_id * 104729 as string), 13, '0') when 2 then lpad(cast(doc_id * 15485863 as string), 12, '0') when 3 then concat(lpad(cast(doc_id % 10000 as string), 4, '0'), '-', lpad(cast(doc_id * 3 % 1000 as string), 3, '0'), 'X') else 'word' end")
    return table(spark, sf_dir, "documents").select("doc_id", F.get(X.barcode_tags(F.concat(F.lit("see ("), w, F.lit("), end."))), F.lit(0)).alias("tag"))


@query("f8_change_ratio")
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.concat(F.substring("text", 1, 40), F.lit(" new words "), F.substr("text", F.lit(61)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.change_ratio(F.col("text"), edited), 6).alias("ratio"))


@query("f9_fold", f"select doc_id, md5({FOLD_SQL.format('text')}) as digest from documents")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded(F.col("text"))).alias("digest"))


@query("f11_passage_matches", "select b.item_id, d.doc_id, position(trim(b.text) in d.text) - 1 as start from benchmark b join documents d on contains(d.text, trim(b.text))")
def passage_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact stage of the cascade."""
    return matched(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), fuzzy=False).select("item_id", "doc_id", "start")


@query("f11_passage_cascade")
def passage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three stages, on passages in capitals with other marks and every tenth letter e changed."""
    worn = F.regexp_replace(F.regexp_replace(F.upper("text"), r"[.,] ", " - "), r"((?:[^E]*E){9}[^E]*)E", "$1A")
    return matched(table(spark, sf_dir, "benchmark").select("item_id", worn.alias("text")), table(spark, sf_dir, "documents"))


@query("f13_entity_tags", "with t as (select user_id, event_type as prefix, lower(event_type || (event_id % 9)) as txt, value as score from events where value >= 5), d as (select user_id, prefix, txt, max(score) as score from t group by all), r as (select *, row_number() over (partition by user_id order by score desc, prefix, txt) as n from d) select user_id, list(prefix || ':' || txt order by n) as tags from r where n <= 6 group by user_id")
def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("prefix"), F.lower(F.concat("event_type", (F.col("event_id") % 9).cast("string"))).alias("txt"), F.col("value").alias("score"))
    return K.entity_tags(rows, "user_id", 5, 6)


@query("f14_field_evidence", "select doc_id, sha256('title:' || substring(text, 5, 12)) as id, trim(regexp_replace(substring(text, 5, 12), '\\s+', ' ', 'g')) as value, position(substring(text, 5, 12) in text) - 1 as start, length(replace(substring(text, 1, 4), chr(12), '')) as before from documents where length(text) > 20")
def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.field_evidence(table(spark, sf_dir, "documents").where(F.length("text") > 20), "title", F.substring("text", 5, 12), "text", 4, "doc_id")


@query("f15_keep_reviews", "select d.doc_id, coalesce(l.quality, -1) as review from documents d left join labels l using (doc_id)")
def keep_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("review"))


@query("f18_hamming", "select a.vec_id as vec_id, bit_count(xor(a.vec_id * 2654435761, (a.vec_id + 7) * 40503)) as distance from embeddings a")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("bit_count((vec_id * 2654435761) ^ ((vec_id + 7) * 40503))").alias("distance"))


@query("f20_exif_time", "with d as (select event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') || case when event_id % 4 = 0 then 'Z' else '' end as s, ts from events) select event_id, case when length(s) = 19 then epoch(date_trunc('second', ts))::bigint end as seconds from d")
def exif_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.when(F.col("event_id") % 4 == 0, "Z").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", X.exif_seconds(s).alias("seconds"))


@query("f21_language_code", "select doc_id, case lang when 'en' then 'en' when 'de' then 'de' when 'fr' then 'fr' else 'es' end as code from documents")
def language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case lang when 'en' then 'eng_Latn' when 'de' then 'German' when 'fr' then 'fr' else 'SPA-Latn' end")
    return table(spark, sf_dir, "documents").select("doc_id", X.language_code(label).alias("code"))


@query("f22_url_parts", "select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*/?.*?([^/?#]*)(?:[?#].*)?$', 1) as name from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme, host, name = K.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), name.alias("name"))


@query("s18_report_cells", f"""with {LIB}, c as (select num, case num % 4 when 0 then '=' || title when 1 then ' +' || title when 2 then title || '"' else title end as cell from lib) select num, '"' || case when regexp_matches(cell, '^ *[=+\\-@]') or regexp_matches(cell, '^[\\t\\r\\n]') then '''' else '' end || replace(cell, '"', '""') || '"' as cell from c""")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("case num % 4 when 0 then concat('=', title) when 1 then concat(' +', title) when 2 then concat(title, '\"') else title end")
    return library(spark, sf_dir).select("num", X.csv_cell(cell).alias("cell"))


@query("f24_html_escape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as digest from pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


@query("f26_cosine", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.operators.ranking import cosine as cos

    e = table(spark, sf_dir, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(cos(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("f27_json_integer", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("f28_occurrence_id", f"with {LIB}, p as (select num, owner_id as o, case when num % 3 = 0 then '' else parent_dir end as l, source_hash as h from lib) select num, sha256(strlen(o)::varchar || ':' || o || strlen(l)::varchar || ':' || l || case when l = '' then strlen(h)::varchar || ':' || h else '' end) as occurrence from p")
def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.when(F.col("num") % 3 == 0, "").otherwise(F.col("parent_dir"))
    return library(spark, sf_dir).select("num", X.occurrence_id(F.col("owner_id"), where, F.col("source_hash")).alias("occurrence"))


_NOW = 1700000000000


@query("f31_next_due", f"with j as (select event_id, case event_id % 3 when 0 then 'manual' when 1 then 'interval' else 'daily' end as kind, event_id % 1440 as number, case when event_id % 5 = 0 then null else {_NOW} - event_id * 3000 end as last from events) select event_id, case kind when 'interval' then coalesce(last + number * 60000, {_NOW}) when 'daily' then case when last >= {_NOW // 86400000 * 86400000} + number * 60000 then {_NOW // 86400000 * 86400000} + number * 60000 + 86400000 else {_NOW // 86400000 * 86400000} + number * 60000 end end as due from j")
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_id % 3 when 0 then 'manual' when 1 then 'interval' else 'daily' end")
    last = F.expr(f"case when event_id % 5 = 0 then null else {_NOW} - event_id * 3000 end")
    return table(spark, sf_dir, "events").select("event_id", X.next_due(kind, F.col("event_id") % 1440, last, _NOW).alias("due"))


@query("f32_backoff", "select event_id, case when event_id % 4 = 0 then 60 else least(greatest(event_id % 5000, 60) * 2, 3600) end as delay from events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.backoff(F.col("event_id") % 5000, F.col("event_id") % 4).alias("delay"))


@query("r27_citation_audit", r"with a as (select doc_id, 'see [S' || (doc_id % 4) || ', S9] and [s' || (doc_id % 3) || ']' as answer from documents), l as (select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(upper(answer), 'S\d+'), lambda x: x))) as ids from a) select doc_id, list_filter(ids, lambda x: x in ('S1', 'S2')) as cited, list_filter(ids, lambda x: x not in ('S1', 'S2')) as unknown from l")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    answer = F.concat(F.lit("see [S"), (d % 4).cast("string"), F.lit(", S9] and [s"), (d % 3).cast("string"), F.lit("]"))
    cited, unknown = K.citations(answer, ("S1", "S2"))
    return table(spark, sf_dir, "documents").select("doc_id", cited.alias("cited"), unknown.alias("unknown"))


@query("r24_display_sorts", f"with {LIB} select id, row_number() over (order by lower(title), num) as by_title, row_number() over (order by year desc nulls last, num) as by_year from lib")
def display_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both places by range: ranks within ranges of the sort key, after the counts of the ranges before, so no task sorts all."""
    docs = library(spark, sf_dir).select("id", "num", F.lower("title").alias("t"), F.col("year").alias("y"))
    title = placed(docs, F.substring("t", 1, 4), (F.col("t"), F.col("num")))
    year = placed(docs, F.coalesce(-F.col("y"), F.lit(0)), (F.col("y").desc_nulls_last(), F.col("num")))
    return title.select("id", F.col("place").alias("by_title")).join(year.select("id", F.col("place").alias("by_year")), "id")


@query("s12_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.sources.readers import html_text as read

    return read(table(spark, sf_dir, "pages"), "html", "page_id", "url")


@query("s7_files")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.sources.readers import files

    return files(spark, sf_dir, glob="*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


_TEX = "replace(replace(replace(regexp_replace(replace({0}, chr(92), chr(57344)), '([&%$#_{{}}])', '\\\\\\1', 'g'), '^', chr(92) || '^{{}}'), '~', chr(92) || '~{{}}'), chr(57344), chr(92) || 'textbackslash{{}}')"


@query("s19_bibtex", f"with {LIB}, k as (select *, regexp_replace(owner_id, '[^A-Za-z0-9]', '', 'g') || coalesce(year::varchar, '') as base from lib), n as (select *, row_number() over (partition by base order by id) as n from k), e as (select *, base || case when n > 1 then '_' || n else '' end as key from n) select id, key, '@misc{{' || key || ',' || chr(10) || '  title = {{' || {_TEX.format('title')} || '}},' || chr(10) || '  author = {{' || {_TEX.format('owner_id')} || '}},' || chr(10) || '  year = {{' || coalesce(year::varchar, '') || '}}' || chr(10) || '}}' as entry from e")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.sources.sinks import bibtex as cite

    docs = library(spark, sf_dir)
    return cite(docs.select("id", "title", F.col("owner_id").alias("author"), "year"))


@query("s21_deletion_lines", "with c as (select doc_id, row_number() over (partition by sha256(text) order by doc_id) as r from documents) select concat('/lib/f', doc_id, '''s.txt') as place, concat('rm -- ''/lib/f', doc_id, '''\\''''s.txt''') as line from c where r > 1")
def deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.sources.sinks import deletion_script

    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    copies = docs.join(first, "h").where("doc_id > first").select(F.concat(F.lit("/lib/f"), F.col("doc_id").cast("string"), F.lit("'s.txt")).alias("path"))
    return deletion_script(copies)


@query("x1_debounced_events", "with e as (select user_id, ts, case when ts < lag(ts) over w + interval 1 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as burst from e) select user_id, max(ts) as last, count(*) as n from s group by user_id, burst")
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming debounce, run over the table as a batch."""
    from lexigrove.streaming.feeds import debounced

    rows = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("path"))
    return debounced(rows, "1 hour").select(F.col("path").alias("user_id"), "last", "n")


@query("x3_admissions")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming caps, run over the table as a batch: one file of a kind an hour, three files and 40 tokens a user's day."""
    from lexigrove.streaming.admission import admitted

    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("folder"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.date_trunc("millisecond", "ts").alias("ts"), F.floor("value").alias("cost"))
    got = admitted(rows, 1, 3, 40)
    return got.select(F.col("path").cast("bigint").alias("event_id"), F.col("owner").cast("bigint").alias("user_id"), "ts", "admitted", "reason")
