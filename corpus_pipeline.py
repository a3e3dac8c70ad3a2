"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.base import drop, fresh, same, scratch, written
from lexigrove.llm.exact_dedup import exact_dedup
from lexigrove.llm.language_id import UNKNOWN, identify, train
from lexigrove.llm.near_dedup import near_components
from lexigrove.llm.packing import pack_documents
from lexigrove.llm.source_mix import mix

#: The least calibrated probability of a language; very short texts of a clear language still have more.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is unsure, go."""
    pred, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    found = identify(docs, train(docs), pred=pred, score=score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup(docs, keep=tuple(docs.columns)).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, and every document that is linked with none."""
    mark = fresh("mark", docs.columns)
    marked = docs.withColumn(mark, F.sha2("text", 256))  # with the id, null or repeated, it tells what was decided on a row
    gone = near_components(marked, mark=mark).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col(mark).alias("gone_mark"))
    out = marked.alias("d").join(gone.alias("g"), same(F.col("d.doc_id"), F.col("g.gone_id")) & (F.col(f"d.{mark}") == F.col("g.gone_mark")), "left_anti")
    return out.select(*(F.col(f"d.{c}") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(docs, keep=tuple(docs.columns)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]
#: Trained and sketched stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote goes when the next one has read it; the last one's tables stay for the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as stays:
            done = stays(written(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
