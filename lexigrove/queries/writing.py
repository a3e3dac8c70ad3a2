"""Ingest, positions over parts, pages that keep times whole, annotations, approximate search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.corpus import LIB, library, table
from lexigrove.functions.analysis import FOLD_SQL, LONGEST
from lexigrove.operators import ingest as I
from lexigrove.operators import records as K
from lexigrove.operators.quantised import QuantisedIndex
from lexigrove.operators.tables import Conflict, KeyedTable, commit, snapshot
from lexigrove.registry import query
from lexigrove.session import shared_folder


def _fresh(spark: SparkSession) -> str:
    """A place for a table in the shared folder."""
    return f"{shared_folder(spark)}/lexigrove-tables/{uuid.uuid4().hex}"


@query("s4_snapshots", "select doc_id, lang, doc_id % 3 = 0 as in_second, doc_id % 3 = 0 or doc_id % 7 = 0 as in_third from documents")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of one table, each read as it was."""
    path, docs = _fresh(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    commit(docs, path, expected=0)
    commit(docs.where("doc_id % 3 = 0"), path, expected=1)
    commit(docs.where("doc_id % 7 = 0 and doc_id % 3 <> 0"), path, append=True)
    mark = lambda n, c: snapshot(spark, path, n).select("doc_id", F.lit(True).alias(c))
    out = snapshot(spark, path, 1).join(mark(2, "a"), "doc_id", "left").join(mark(None, "b"), "doc_id", "left")
    return out.select("doc_id", "lang", F.coalesce("a", F.lit(False)).alias("in_second"), F.coalesce("b", F.lit(False)).alias("in_third"))


@query("d5_conditional_delete", "select doc_id, lang, true as refused from documents where doc_id % 5 <> 0")
def conditional_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows go if the table is at the version that was read; a second delete from the same version is refused."""
    docs = table(spark, sf_dir, "documents")
    held = KeyedTable(spark, _fresh(spark), ("doc_id",), ("n_chars",))
    read = held.upsert(docs.select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars")))
    held.delete(docs.where("doc_id % 5 = 0"), expected=read)
    try:
        held.delete(docs.where("doc_id % 5 = 1"), expected=read)
        refused = False
    except Conflict:
        refused = True
    return held.rows().select("doc_id", "lang", F.lit(refused).alias("refused"))


@query("x7_merged", "select doc_id, case when doc_id % 100 = 1 then 'new' else lang end as lang, cast(case when doc_id % 100 = 1 then 2 else 1 end as int) as rev from documents where doc_id % 100 <> 3 union all select doc_id - 1000000000, 'more', 2 from documents where doc_id % 100 = 1")
def merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by key after three batches of a feed: later rows, new keys, rows that are too old, a deletion, and a batch that comes again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    held = KeyedTable(spark, _fresh(spark), ("doc_id",), ("rev",))
    rev = lambda rows, n: rows.withColumn("rev", F.lit(n))
    held.upsert(rev(docs, 1), applied=("feed", 0))
    some = docs.where("doc_id % 100 = 1")
    batch = rev(some.withColumn("lang", F.lit("new")).unionByName(some.select((F.col("doc_id") - 1000000000).alias("doc_id"), F.lit("more").alias("lang"))), 2)
    held.upsert(batch, applied=("feed", 1))
    held.upsert(batch, applied=("feed", 1))
    held.delete(docs.where("doc_id % 100 = 3"))
    held.upsert(rev(docs.where("doc_id % 100 in (1, 2, 3)").withColumn("lang", F.lit("old")), 0), applied=("feed", 2))
    return held.rows()


@query("d1_ingest_batch", "with r as (select conv_id, role, text, turn, row_number() over (partition by conv_id, role order by turn desc, text desc) as n from conversations) select conv_id, role, turn, text from r where n = 1 and trim(coalesce(text, '')) <> ''")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest(table(spark, sf_dir, "conversations"), ("conv_id", "role"), ("turn", "text"), "text").select("conv_id", "role", "turn", "text")


@query("d2_replaced", "select doc_id, case when doc_id % 10 = 0 then 'new' else lang end as lang, case when doc_id % 10 = 0 then null else n_chars end as n_chars from documents")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return I.replaced(docs, docs.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("lang")), ("doc_id",))


@query("t26_stitched_positions", f"with p as (select conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') as ws from conversations), b as (select *, coalesce(sum(len(ws) + 2048) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as base from p), w as (select conv_id, base, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from b) select conv_id, {FOLD_SQL.format('w')} as term, (base + i)::bigint as position from w where strlen(w) < {LONGEST}")
def stitched_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stitched_tokens(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumn("position", F.col("position").cast("bigint"))


@query("o5_push_page", f"with {LIB} select id, indexed_at from lib where indexed_at <= (select max(indexed_at) from (select indexed_at from lib order by indexed_at limit 50))")
def push_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.whole_times(library(spark, sf_dir).select("id", "indexed_at"), 50, "indexed_at")


@query("d11_annotations", "select user_id, event_id, value from events where event_type = 'view' and contains(props, '7') order by ts desc, event_id desc limit 60")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (F.col("event_type") == "view") & F.col("props").contains("7")
    return K.annotations(table(spark, sf_dir, "events"), wanted, 60, key="event_id").select("user_id", "event_id", "value")


@query("d13_unprocessed", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 4 = 0)")
def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return K.unprocessed(docs, docs.where("doc_id % 4 = 0"), "h").select("doc_id")


@query("f17_adler", "with h as (select doc_id, hex(encode(text)) as x, strlen(text) as n from documents), b as (select doc_id, n, i, ('0x' || byte)::bigint as d from (select doc_id, n, unnest(regexp_extract_all(x, '..')) as byte, generate_subscripts(regexp_extract_all(x, '..'), 1) - 1 as i from h)) select h.doc_id, (((h.n + coalesce(sum((b.n - i) * d), 0)) % 65521) * 65536 + (1 + coalesce(sum(d), 0)) % 65521)::bigint as checksum from h left join b using (doc_id) group by h.doc_id, h.n")
def adler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", I.adler32(F.col("text")).alias("checksum"))


@query("r13_scorer", "with w as (select doc_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '\\s+')) as ws from documents) select doc_id, round((list_contains(ws, 'the')::int + list_contains(ws, 'heon')::int + list_contains(ws, 'thon')::int) / 3.0::double, 6) as score from w")
def scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), "the heon thon", "text").select("doc_id", F.round("score", 6).alias("score"))


@query("r5_vector_index")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return I.VectorIndex(rows).search_all(rows.where("id % 20 = 0"), 10)


@query("r5_quantised_index")
def quantised_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As r5_vector_index, from codes of the vectors' parts, 16 bytes a vector; few vectors are read whole."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return QuantisedIndex(rows, width=4).search_all(rows.where("id % 20 = 0"), 10)


@query("r28_packed_evidence", "with p as (select conv_id as question_id, turn as rank, role as label, coalesce(text, '') as t from conversations), q as (select distinct conv_id as question_id, 'question ' || conv_id as question from conversations), r as (select p.*, cast(floor((700 - 175) * 0.8) as bigint) - cast(ceil(length(question) / 4) as bigint) - coalesce(sum(cast(ceil(length(t) / 4) as bigint)) over (partition by question_id order by rank rows between unbounded preceding and 1 preceding), 0) as room from p join q using (question_id)) select question_id, label, rank, md5(substring(t, 1, cast(4 * room as bigint))) as digest, cast(ceil(length(substring(t, 1, cast(4 * room as bigint))) / 4) as bigint) as tokens from r where room >= 64")
def packed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as passages for a question."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.col("role").alias("label"), "text")
    asked = turns.select("question_id", F.concat(F.lit("question "), F.col("question_id").cast("string")).alias("question")).distinct()
    return I.packed_evidence(turns, asked, 700).select("question_id", "label", "rank", F.md5("text").alias("digest"), "tokens")


@query("f16_template_paths", "select doc_id, 'lib/' || coalesce(nullif(trim(coalesce(lang, ''), ' .'), ''), '_') || '/' || coalesce(nullif(trim(replace(replace(coalesce(source, '') || '/' || doc_id % 3, '/', '_'), '?', '_'), ' .'), ''), '_') || '/' || '_' as path from documents")
def template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"lang": F.col("lang"), "place": F.concat(F.coalesce("source", F.lit("")), F.lit("/"), (F.col("doc_id") % 3).cast("string"))}
    return table(spark, sf_dir, "documents").select("doc_id", I.template_path("lib/{Field:lang}/{Field:place}/{Field:none}", fields).alias("path"))


@query("f5_token_chunks", "with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+') as ws from documents), i as (select doc_id, ws, unnest(range(0, greatest(len(ws) - 12, 1), 84)) as i from w where len(ws) > 0) select doc_id, i // 84 as chunk, len(ws[i + 1 : i + 96]) as tokens, md5(array_to_string(ws[i + 1 : i + 96], ' ')) as digest from i")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 96 tokens, 12 of them shared with the next; words stand for tokens."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).select("doc_id", F.posexplode(I.token_windows(F.col("ws"), 96)).alias("chunk", "own"))
    return rows.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("own").cast("bigint").alias("tokens"), F.md5(F.array_join("own", " ")).alias("digest"))
