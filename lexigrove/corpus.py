"""The document library over the test tables, with derived columns that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.analysis import FOLD_SQL, LONGEST
from lexigrove.operators.postings import TextIndex, opened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions that Spark and DuckDB read alike; of documents(doc_id, text, lang, source, n_chars).
LIBRARY = {
    "owner_id": "source",
    "id": "cast(doc_id as {string})",
    "num": "doc_id",
    "title": "substring(text, 1, 40)",
    "headings": "substring(text, 41, 30)",
    "body": "text",
    "language": "lang",
    "year": "cast(case when doc_id % 13 = 0 then null else 2000 + doc_id % 25 end as int)",
    "ext": "case doc_id % 5 when 0 then 'PDF' when 1 then 'md' when 2 then 'txt' when 3 then 'html' else '' end",
    "filename": "concat('f', cast(doc_id % 500 as {string}), '.', case doc_id % 2 when 0 then 'pdf' else 'md' end)",
    "parent_dir": "concat('/lib/', lang, '/', source, '/d', cast(doc_id % 7 as {string}))",
    "url": "case when doc_id % 5 = 0 then concat('https://example.org/', source, '/', cast(doc_id % 50 as {string})) when doc_id % 5 = 1 then '' end",
    "volume_id": "case doc_id % 4 when 0 then null when 1 then 'vol-a' when 2 then 'vol-b' else 'vol-c' end",
    "doc_status": "case doc_id % 3 when 0 then 'new' when 1 then 'reviewed' else null end",
    "audio_seconds": "cast(case when doc_id % 6 = 0 then doc_id % 400 end as double)",
    "camera": "case when doc_id % 9 = 0 then concat('Maker_', cast(doc_id % 4 as {string}), '%X') end",
    "indexed_at": "cast(1600000000000 + (doc_id % 997) * 86400000 as bigint)",
    "metadata_json": "concat('{{\"fs_size\":', cast(n_chars as {string}), ',\"l2_extracted\":', case when doc_id % 2 = 0 then 'true' else 'false' end, '}}')",
    "tag_src": "concat('src:', source)",
    "tag_person": "concat('person:p', cast(doc_id % 37 as {string}))",
    "tag_org": "concat('org:o', cast(doc_id % 11 as {string}))",
    "tag_set": "concat('collection:c', cast(doc_id % 3 as {string}))",
}
TAGS = ("tag_src", "tag_person", "tag_org", "tag_set")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: identity, metadata, tags, and the three text fields."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select(*(F.expr(e.format(string="string")).alias(n) for n, e in LIBRARY.items()), F.sha2("text", 256).alias("source_hash"))
    return named.withColumn("tags", F.array(*TAGS)).withColumn("chunk_index", F.lit(0)).drop(*TAGS)


#: Text columns of the library by search field.
FIELDS = {"title": "title", "headings": "headings", "body": "body"}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The library's inverted index, built by the first query that asks for it."""
    return opened(table(spark, sf_dir, "documents"), library(spark, sf_dir), ("owner_id", "id", "num"), FIELDS)


#: The same as a common table expression for DuckDB.
LIB = "lib as (select " + ", ".join(f"{e.format(string='varchar')} as {n}" for n, e in LIBRARY.items() if n not in TAGS) + ", sha256(text) as source_hash, [" + ", ".join(LIBRARY[t].format(string="varchar") for t in TAGS) + "] as tags, 0 as chunk_index from documents)"

#: The library's tokens for DuckDB.
_RAW = "unnest(regexp_extract_all({f}, '[\\p{{L}}\\p{{N}}]+')) as w, generate_subscripts(regexp_extract_all({f}, '[\\p{{L}}\\p{{N}}]+'), 1) - 1 as p"
TOK = "tok as (select fld, owner_id, id, num, p, " + FOLD_SQL.format("w") + " as t from (" + " union all ".join(f"select '{f}' as fld, owner_id, id, num, {_RAW.format(f=f)} from lib" for f in FIELDS) + f") where strlen(w) < {LONGEST})"

#: Passages: windows of 120 words, 30 of them shared with the next.
CHUNK_WORDS, CHUNK_SHARED = 120, 30
