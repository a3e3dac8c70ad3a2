"""Ingest as one operator: a batch of documents becomes rows with their tags and embedded chunks, in one version of a table.

A document's row holds all that is derived from it, so a new text replaces its tags and chunks with it or not at all, a
reader never sees a document beside the chunks of an older text, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrove.operators import ranking
from lexigrove.operators.ingest import ingest
from lexigrove.operators.tables import KeyedTable

#: What a row holds of its chunks, and the rows that are cut and embedded at once.
NAMES = ("chunk_index", "start_byte", "end_byte", "chunk", "vector")
CHUNKS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in zip(NAMES, (T.IntegerType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.ArrayType(T.FloatType())), strict=True)]))
ROWS = 64


class Library:
    """keys name a document, order tells which of its rows is last, text is what is chunked.

    ``embed`` gives a vector (a list of floats) for each text of a series; without it chunks have none.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...], text: str = "text", size: int = 120, shared: int = 30, embed: Callable[[pd.Series], pd.Series] | None = None, **options):
        self.table = KeyedTable(spark, path, keys, order, **options)
        self.keys, self.order, self.text, self.size, self.shared, self.embed = keys, order, text, size, shared, embed

    def _with_chunks(self, rows: DataFrame) -> DataFrame:
        """rows with their chunks, made where a row is, so that no text moves for them."""
        kinds = T.StructType([*rows.schema.fields, T.StructField("chunks", CHUNKS)])
        at, size, step, embed, schema = rows.columns.index(self.text), self.size, max(self.size - self.shared, 1), self.embed, to_arrow_schema(kinds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    part = batch.slice(begin, ROWS)
                    own = []
                    for text in part.column(at):
                        raw = (text.as_py() or "").encode()
                        own.append([(k, a, b, raw[a:b].decode()) for k, (a, b) in enumerate(ranking.word_windows(raw, size, step))])
                    texts = [c[3] for cut in own for c in cut]
                    vectors = iter(embed(pd.Series(texts, dtype=object)) if embed and texts else [None] * len(texts))
                    held = [[dict(zip(NAMES, (*c, next(vectors)), strict=True)) for c in cut] or None for cut in own]
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, schema, strict=False)), pa.array(held, schema.field("chunks").type)], schema=schema)

        return rows.mapInArrow(run, kinds)

    def ingest(self, batch: DataFrame, applied: tuple[str, int] | None = None) -> int:
        """The version that holds the batch: of each key its last row, if that has text and the table has none as late.

        A column ``tags`` (strings) is kept without nulls, blanks and repeats, in order.
        """
        rows = ingest(batch, self.keys, self.order, self.text)
        tags = F.array_sort(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) != ""))) if "tags" in batch.columns else F.array().cast("array<string>")
        return self.table.upsert(self._with_chunks(rows.withColumn("tags", tags)), applied=applied, unique=True)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        return self.table.delete(keys, expected)

    def documents(self, version: int | None = None) -> DataFrame:
        return self.table.rows(version)

    def tags(self, version: int | None = None) -> DataFrame:
        """(keys, tag)"""
        return self.documents(version).select(*self.keys, F.explode("tags").alias("tag"))

    def chunks(self, version: int | None = None) -> DataFrame:
        """(keys, chunk_index, start_byte, end_byte, chunk, vector)"""
        return self.documents(version).select(*self.keys, F.inline("chunks"))
