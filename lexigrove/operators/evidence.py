"""Why a document matches: the bytes of its text in which a query's wanted words stand, and spans merged into highlights.

Words are laid out as rows with their bytes by a running sum over each text's words and what lies between them. Only what
the query asks for counts: nothing under NOT, wildcards and fuzzy words by the words that they stand for, a phrase only
where its words follow each other, a field only in that field.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import LONGEST, WORD, folded, py_tokens
from lexigrove.plans import compiler
from lexigrove.plans import language as q

#: Spans that a text shows.
MOST_SPANS = 256


def word_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, term, start, end): each indexed word of a text with the bytes that it takes; long words leave their position empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    pairs = F.arrays_zip(F.split(body, WORD, -1).alias("gap"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("word"))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(pairs).alias("position", "x")).select("key", "position", "x.gap", "x.word")
    before = Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("gap") + F.coalesce(F.octet_length("word"), F.lit(0))).over(before)
    placed = rows.withColumn("end", end).where(F.col("word").isNotNull() & (F.octet_length("word") < LONGEST))
    return placed.select(F.col("key").alias(key), "position", folded(F.col("word")).alias("term"), (F.col("end") - F.octet_length("word")).alias("start"), "end")


def merged_spans(rows: DataFrame, by: tuple[str, ...], start: str = "start", end: str = "end", gap: int = 0, score: str | None = None) -> DataFrame:
    """(by, start, end, n[, score]): spans that overlap, or are at most ``gap`` apart, as one, with how many it is made of and the best score."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    own = own.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = [F.max(score).alias(score)] if score else []
    return own.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *best).drop("_run")


def wanted(expr: object, words: dict, scope: str | None = None) -> list[tuple[str | None, tuple[tuple[str, ...], ...]]]:
    """(field or None, a sequence of the words that may stand at each place) for the parts of a query that speak for a document."""
    if isinstance(expr, q.Not):
        return []
    if isinstance(expr, q.Scope):
        return wanted(expr.inner, words, expr.field)
    if isinstance(expr, q.Near):
        return wanted(expr.left, words, scope) + wanted(expr.right, words, scope)
    if isinstance(expr, (q.And, q.Or)):
        return [x for part in expr.parts for x in wanted(part, words, scope)]
    if isinstance(expr, q.Phrase):
        held = py_tokens(expr.text)
        at = dict(held)
        return [(scope, tuple((at[i],) if i in at else () for i in range(held[0][0], held[-1][0] + 1)))]
    if expr.text == "*":
        return []
    kind = q.pattern(expr.text)
    if isinstance(kind, q.Exact):
        return [(scope, ((t,),)) for _, t in kind.tokens]
    return [(scope, (tuple(words.get(kind, ())),))]


def evidence(docs: DataFrame, query: str, fields: dict[str, str], key: str, field: str = "body", most: int = MOST_SPANS, gap: int = 0) -> DataFrame:
    """(key, start, end, n): the bytes of a field's text in which what the query wants stands, touching spans merged; the first ``most`` of each text.

    docs: the rows to explain, such as the hits of a page. A position that a long word leaves empty fits any place of a phrase that has one.
    """
    expr = q.parse(query, tuple(fields))
    held = compiler.Compiler(docs, fields)
    held.prepare(expr)
    parts = sorted({p for scope, p in wanted(expr, held.words) if scope in (None, field)})
    rows = word_spans(docs, key, fields[field])
    place = Window.partitionBy(key).orderBy("position")
    found: list[Column] = []
    for part in parts:
        fits = []
        last = F.col("end")
        ahead = 0
        for offset, terms in enumerate(part):
            if not terms:
                continue
            if offset == 0:
                fits.append(F.col("term").isin(list(terms)))
            else:
                ahead += 1
                fits.append((F.lead("position", ahead).over(place) == F.col("position") + offset) & F.lead("term", ahead).over(place).isin(list(terms)))
                last = F.lead("end", ahead).over(place)
        found.append(F.when(functools.reduce(lambda a, b: a & b, fits), F.struct(F.col("start").alias("s"), last.alias("e"))))
    if not found:
        return rows.where("false").select(key, "start", "end", F.lit(0).cast("bigint").alias("n"))
    hits = rows.select(key, F.array_compact(F.array(*found)).alias("_x")).select(key, F.explode("_x").alias("x")).select(key, F.col("x.s").alias("start"), F.col("x.e").alias("end")).distinct()
    spans = merged_spans(hits, (key,), gap=gap)
    first = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return spans.withColumn("_i", first).where(F.col("_i") <= most).drop("_i")
