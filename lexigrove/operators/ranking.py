"""Vector, sparse and late-interaction retrieval, rank fusion, passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.session import checkpointed

#: Weight of rank r in a fused list is 1 / (RRF + r).
RRF = 60


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def vector_score(a: Column, b: Column) -> Column:
    """1 for the same direction, 0 for the opposite one."""
    return 1 - F.least(F.greatest(1 - cosine(a, b), F.lit(0.0)), F.lit(2.0)) / 2


def top(df: DataFrame, n: int, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows, or of each group; rank counts from 1."""
    w = Window.partitionBy(*by).orderBy(*order) if by else None
    if w is None:
        first = df.orderBy(*order).limit(n)  # taken from each partition first
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def vector_search(rows: DataFrame, query: list[float], n: int, key: str = "doc", chunk: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best chunk of each of the n best documents: (key, chunk, score, rank)."""
    scored = rows.select(key, chunk, F.round(vector_score(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6).alias("score"))
    best = scored.groupBy(key).agg(F.max_by(F.struct(chunk, "score"), F.struct("score", -F.col(chunk))).alias("b")).select(key, "b.*")
    return top(best, n, F.desc("score"), F.asc(key))


def nearest(queries: DataFrame, rows: DataFrame, n: int, block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): for each of queries (id, vector) the n nearest of rows (id, vector) by cosine score.

    Vectors are packed to blocks of ``block`` rows, every block of queries meets every block of rows as two matrices, and
    each such meeting hands on n rows a query at most. Rows with the query's own id are left out. Work is queries times
    rows, the price of an exact answer: for large batches of queries over many rows there is ``VectorIndex``.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), block):
                    part = b.iloc[i : i + block]
                    yield pd.DataFrame({f"{name}_ids": [part["id"].to_numpy(np.int64).tobytes()], f"{name}_m": [np.stack([np.asarray(v, np.float64) for v in part["vector"]]).tobytes()]})

        return df.mapInPandas(run, f"{name}_ids binary, {name}_m binary")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        for b in batches:
            for r in b.itertuples():
                q, k = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.k_ids, np.int64)
                s = unit(np.frombuffer(r.q_m).reshape(len(q), -1)) @ unit(np.frombuffer(r.k_m).reshape(len(k), -1)).T
                s = np.round(1 - np.clip(1 - s, 0, 2) / 2, 6)
                s[q[:, None] == k[None, :]] = -1
                order = np.lexsort((np.broadcast_to(k, s.shape), -s), axis=1)[:, :n]
                got = pd.DataFrame({"query_id": np.repeat(q, order.shape[1]), "id": k[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield got[got["score"] >= 0]

    met = packed(queries, "q").crossJoin(packed(rows, "k")).mapInPandas(meet, "query_id bigint, id bigint, score double")
    return top(met, n, F.desc("score"), F.asc("id"), by=("query_id",))


def sparse_dot(rows: DataFrame, query: dict[int, float], key: str, chunk: str) -> DataFrame:
    """(key, chunk, score) of the best chunk of each document with a positive product. rows: (key, chunk, index, value)."""
    weights = F.create_map(*(x for k, v in sorted(query.items()) for x in (F.lit(k), F.lit(float(v)))))
    hit = rows.where(F.col("index").isin(list(query)))
    scored = hit.groupBy(key, chunk).agg(F.round(F.sum(F.col("value") * weights[F.col("index")]), 6).alias("score")).where("score > 0")
    return scored.groupBy(key).agg(F.max_by(F.struct(chunk, "score"), F.struct("score", -F.col(chunk))).alias("b")).select(key, "b.*")


def maxsim(query: list[list[float]], vectors: Column) -> Column:
    """The sum over query vectors of the best product with one of vectors; 0 if there are none."""
    given = [F.array(*(F.lit(float(x)) for x in q)) for q in query]
    parts = [F.array_max(F.transform(vectors, lambda v: dot(v, q))) for q in given]  # noqa: B023  used at once
    return F.when(F.size(vectors) > 0, sum(parts, F.lit(0.0))).otherwise(F.lit(0.0))


def fuse(lanes: dict[str, DataFrame], key: str, n: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion. Each lane has (key, rank); of a key's ranks in a lane the best counts. Ties go by key."""
    every = None
    for name, lane in lanes.items():
        one = lane.groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.lit(name).alias("lane"), "rank")
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy(key).agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 6).alias("score"))
    return top(fused, n, F.desc("score"), F.asc(key)) if n else fused


#: Most rows that a reranker sees at once.
PAGE = 1000


def rerank(rows: DataFrame, score: str, place: str) -> DataFrame:
    """Scored rows first, by score; those without (or NaN) keep their order behind them. rows: a page of results."""
    if rows.limit(PAGE + 1).count() > PAGE:
        raise ValueError(f"reranking takes {PAGE} rows at most")
    none = F.col(score).isNull() | F.isnan(score)
    w = Window.orderBy(none, F.when(~none, F.col(score)).desc_nulls_last(), place)
    return rows.withColumn("new_rank", F.row_number().over(w))


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\f\r")] = True


def word_windows(raw: bytes, size: int, step: int) -> Iterator[tuple[int, int]]:
    """Where windows of ``size`` words begin and end in a text, a window at every ``step`` words."""
    word = ~_BLANK[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    for i in range(0, len(first), step):
        yield int(first[i]), int(last[min(i + size, len(last)) - 1])


def chunks(docs: DataFrame, text: str, size: int, shared: int, *keep: str) -> DataFrame:
    """Windows of ``size`` words, each ``shared`` words into the one before: (keep, chunk_index, start_byte, end_byte, chunk).

    The last windows may hold words of the ones before only, as a window begins at every step within the text. Words are
    found in the bytes of a whole batch, so a document costs time in proportion to its length.
    """
    step = max(size - shared, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, begins, ends, out, held = [], [], [], [], [], 0

            def done() -> pa.RecordBatch:
                own = [batch.column(c).take(pa.array(rows, pa.int32())) for c in range(len(keep))]  # noqa: B023  called in the same turn
                return pa.RecordBatch.from_arrays([*own, pa.array(index, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(out, pa.string())], [*keep, "chunk_index", "start_byte", "end_byte", "chunk"])  # noqa: B023

            for r in range(batch.num_rows):
                raw = (batch.column(len(keep))[r].as_py() or "").encode()
                for k, (a, b) in enumerate(word_windows(raw, size, step)):
                    rows.append(r)
                    index.append(k)
                    begins.append(a)
                    ends.append(b)
                    out.append(raw[a:b].decode())
                    held += b - a
                    if held > 8 << 20:
                        yield done()
                        rows, index, begins, ends, out, held = [], [], [], [], [], 0
            yield done()

    base = docs.select(*keep, F.col(text).alias("_t"))
    kinds = T.StructType([*base.schema.fields[:-1], T.StructField("chunk_index", T.IntegerType()), T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return base.mapInArrow(run, kinds)


def best_passage(passages: DataFrame, terms: list[str], text: Column, *key: str) -> DataFrame:
    """The passage of each document with most of the terms; of equals the first."""
    hits = sum((text.contains(t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    scored = passages.withColumn("hits", hits)
    rest = [c for c in scored.columns if c not in key]
    return scored.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("hits", -F.col("chunk_index"))).alias("b")).select(*key, "b.*")


def stitched(rows: DataFrame, key: str, place: str, text: str, join: str = "\n") -> DataFrame:
    """(key, body, parts): a document's rows in order, as one text."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, text))).alias("_r")).select(key, F.array_join(F.transform("_r", lambda r: F.coalesce(r[text], F.lit(""))), join).alias("body"), F.size("_r").cast("bigint").alias("parts"))


def windows_of_pages(docs: DataFrame, key: str, text: str, size: int = 1600, step: int = 1400) -> DataFrame:
    """Character windows inside the form-feed pages of each document, as (key, page, start_char, passage), blank ones left out."""
    pages = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f", -1)).alias("page", "_p"), F.split(F.coalesce(text, F.lit("")), "\f", -1).alias("_ps"))
    before = F.aggregate(F.slice("_ps", F.lit(1), F.col("page")), F.lit(0), lambda s, x: s + F.length(x) + 1)
    last = F.greatest(F.ceil((F.length("_p") - size) / step), F.lit(0)).cast("int")
    out = pages.select(key, (F.col("page") + 1).alias("page"), before.alias("_b"), "_p", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    out = out.select(key, "page", (F.col("_b") + F.col("_i") * step).alias("start_char"), F.substring("_p", F.col("_i") * step + 1, F.lit(size)).alias("passage"))
    return out.where(F.length(F.trim("passage")) > 0)


# Fixed values, needed for equal results: English and German words that carry no question.
STOP = tuple("a an the is are was were what which how why where when who do does did of to in on for and or this that me my please der die das ein eine einer eines ist sind war waren was wie welche welcher welches von zu im am und oder bitte".split())


def passage_bm25(passages: DataFrame, words: list[str], text: str, n: int, *key: str) -> DataFrame:
    """The n passages that answer words best: (key, score, rank), score over 0. Statistics cover all passages.

    Words are counted by regular expressions in the text itself, and the counts are written, so texts are read once.
    """
    words = [w for w in dict.fromkeys(w.lower() for w in words) if w not in STOP]
    letter = r"[\p{L}\p{N}\p{M}]"
    low = F.lower(text)
    # A word's own letters come first in its pattern: they rule out most places before what stands around is looked at.
    counts = [F.regexp_count("_l", F.lit(rf"{re.escape(w)}(?<!{letter}{re.escape(w)})(?!{letter})")).alias(f"_c{i}") for i, w in enumerate(words)]
    others = rf"(?<!{letter})(?!(?:{'|'.join(STOP)})(?!{letter})){letter}++"
    base = passages.select(*key, low.alias("_l")).select(*key, F.regexp_count("_l", F.lit(others)).alias("_n"), *counts)
    base = checkpointed(base)
    row = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("mean"), *(F.count(F.when(F.col(f"_c{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        c = F.col(f"_c{i}").cast("double")
        idf = float(np.log(1 + (row["n"] - row[f"df{i}"] + 0.5) / (row[f"df{i}"] + 0.5)))
        score = score + F.lit(idf) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * F.col("_n") / F.lit(row["mean"] or 1.0)))
    return top(base.select(*key, F.round(score, 6).alias("score")).where("score > 0"), n, F.desc("score"), *(F.asc(k) for k in key))
