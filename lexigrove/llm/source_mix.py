"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by the MD5 of their id. A copy of a document gets a virtual finish time: its source's tokens up
to and with it, over the source's weight; the second and third pass over a source follow the first. Copies are ordered
by that time over all sources, and the queue is cut where the budget of tokens is full. A source that has been
taken ``passes`` times has no more copies, and the others share what it leaves by their weights.

The running totals come in two steps, so no source is in one task: sums by (source, bucket of the shuffle key), then a
window inside each bucket. The cut comes from histograms over ranges of the finish time (4096 rows each), refined until
the range that holds it has few rows, so the whole queue is never sorted in one task. In each pass the copies of a
source before the cut are the first by shuffle key, so three marks a source carry the decision back to the documents,
whose texts never move.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own, after all others;
rows with one id are documents of their own, ordered by size; no rows or no words give targets of 0. Other columns pass
through where ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.base import same, scratch, text_or_empty, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
RANGES, FEW = 4096, 100_000


def size_in_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], passes: int) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target: all tokens dealt by weight, at most passes times a source's own, the excess dealt again."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", (F.col("source_size") * passes).cast("bigint"))
    up = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    return levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(every)).select(
        "source", "source_size", "weight", "level", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")).alias("target")
    )


def _first_refused(rows: DataFrame, finish: list[Column], budget: int, top: float) -> tuple | None:
    """(finish, key, id, size, pass) of the first copy in the queue that the budget has no room for; None if all fit."""
    copies = rows.where("size > 0").select("size", "key", "id", F.posexplode(F.array(*finish)).alias("pass", "finish"))
    low, high, left = 0.0, top, budget
    while True:
        place = F.floor(F.least(F.greatest((F.col("finish") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * RANGES)
        held = copies.groupBy(place.alias("g")).agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("g").collect()  # RANGES + 1 rows at most
        for at in held:
            if at.tokens > left:
                break
            left -= at.tokens
        else:
            return None
        copies = copies.where(place == at.g)
        width = (high - low) / RANGES
        low, high = low + at.g * width, low + (at.g + 1) * width
        if at.n <= FEW or at.g == RANGES or width < 1e-9 * max(1.0, high):
            break
    order = Window.orderBy("finish", "key", "id", "size", "pass").rowsBetween(Window.unboundedPreceding, 0)
    over = copies.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") > left)
    return tuple(over.orderBy("finish", "key", "id", "size", "pass").select("finish", "key", "id", "size", "pass").first())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None, weights: tuple[float, ...] = WEIGHTS, passes: int = 3) -> DataFrame:
    """id, size, source_size, target, taken (tokens) and copies, a row for each row of docs; with keep, its columns as the struct ``row``."""
    with scratch() as stays:
        return _mixed(docs, id_col, text_col, source_col, keep, weights, passes, stays)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] | None, weights: tuple[float, ...], passes: int, stays: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = docs.select(
        F.struct(*(keep or (id_col,))).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size_in_words(text_or_empty(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    )
    sized = stays(written(rows.select("id", "source", "size", "key")))
    by_bucket = sized.withColumn("bucket", F.substring("key", 1, 3))
    sums = written(by_bucket.groupBy("source", "bucket").agg(F.sum("size").alias("tokens")))
    wanted = written(targets(sums.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, passes))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("start", F.coalesce(before, F.lit(0))).alias("b").join(wanted.alias("w"), same(F.col("b.source"), F.col("w.source")))
    starts = starts.select("b.source", "b.bucket", "start", "source_size", "weight")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    timed = by_bucket.withColumn("inside", inside).alias("r").join(starts.alias("s"), same(F.col("r.source"), F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    timed = written(timed.select("id", "r.source", "size", "key", "source_size", "weight", (F.col("start") + F.col("inside")).alias("cum")))
    finish = [(F.col("source_size") * k + F.col("cum")) / F.col("weight") for k in range(passes)]
    total = wanted.agg(F.sum("source_size").alias("budget"), F.max("level").alias("level")).first()
    if total.budget:
        refused = _first_refused(timed, finish, total.budget, 2 * total.level)
    # In each pass, a source's copies that come before the cut are the first by (key, id, size).
    mine = F.struct("key", "id", "size")
    if not total.budget:
        last = [F.lit(None).cast(timed.select(mine.alias("m")).schema["m"].dataType)] * passes
    elif refused is None:
        last = [F.max(mine)] * passes
    else:
        names = ("finish", "key", "id", "size", "pass")
        kinds = ("double", "string", dict(timed.dtypes)["id"], "bigint", "int")
        cut = F.struct(*(F.lit(v).cast(kind).alias(n) for v, kind, n in zip(refused, kinds, names, strict=True)))
        last = [F.max(F.when(F.struct(x.alias("finish"), "key", "id", "size", F.lit(k).alias("pass")) < cut, mine)) for k, x in enumerate(finish)]
    marks = timed.where("size > 0").groupBy("source").agg(*(x.alias(f"last{k}") for k, x in enumerate(last))) if total.budget else timed.limit(0).select("source", *(x.alias(f"last{k}") for k, x in enumerate(last)))
    marks = stays(written(marks.alias("m").join(wanted.alias("w"), same(F.col("m.source"), F.col("w.source")), "right").select("w.source", "source_size", "target", *(f"last{k}" for k in range(passes)))))
    out = (rows if keep else sized.withColumn("row", F.lit(None))).alias("r").join(marks.alias("m"), same(F.col("r.source"), F.col("m.source")))
    copies = sum((F.coalesce((F.struct("key", "id", "size") <= F.col(f"last{k}")).cast("bigint"), F.lit(0)) for k in range(passes)), F.lit(0).cast("bigint"))
    out = out.select("row", "r.id", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint").alias("copies"))
    return out.select(*(["row"] if keep else []), F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
