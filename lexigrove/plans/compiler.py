"""From a parsed query to columns over a row for each document.

What a query needs of a document, the places of the query's own terms, is in one row, so matching and scoring are
row-local. Over an index, that row is made of the postings of these terms alone, and what a score needs of the corpus
(documents, mean lengths, document frequencies) is looked up in the vocabulary. Over plain documents, the row is made by
tokenising, and the statistics are one aggregate; that is for streams and small sets. Wildcards and fuzzy words are looked
up in the vocabulary first and become words. How many they may stand for in one query, and how many words may be looked
at for them, is bounded; what is beyond is an error, or, if all matches are asked for (``whole``), a wildcard that goes
beyond is held against the terms of the postings. Over a stream there is no vocabulary, and wildcards are held against
each row's words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import py_tokens, tokens
from lexigrove.operators.postings import TextIndex
from lexigrove.plans import language as q

K1, B = 1.2, 0.75


@dataclass
class Stats:
    documents: int
    mean_length: dict[str, float]
    frequency: dict[tuple[str, str], int]


def holds_without_words(expr: object, scope: str | None = None) -> bool:
    """Whether a document with none of the query's words matches."""
    if isinstance(expr, q.And):
        return all(holds_without_words(p, scope) for p in expr.parts)
    if isinstance(expr, q.Or):
        return any(holds_without_words(p, scope) for p in expr.parts)
    if isinstance(expr, q.Not):
        return not holds_without_words(expr.inner, scope)
    if isinstance(expr, q.Scope):
        return holds_without_words(expr.inner, expr.field)
    return isinstance(expr, q.Word) and expr.text == "*" and scope is None


@dataclass
class Compiler:
    """fields: names of text columns of docs by search field. expanded, visited: the bounds of a query's expansion; whole: wildcards may go beyond."""

    docs: DataFrame | TextIndex
    fields: dict[str, str]
    words: dict[q.Fuzzy | q.Wildcard, list[str]] = field(default_factory=dict)
    stats: Stats | None = None
    expanded: int = q.MAX_EXPANDED
    visited: int = q.MAX_VISITED
    whole: bool = False

    def __post_init__(self):
        self.index = self.docs if isinstance(self.docs, TextIndex) else None
        self.base = None
        if not self.index:
            found = self.docs.select("*", *(tokens(F.col(c)).alias(f"_tok_{f}") for f, c in self.fields.items()))
            self.base = found.withColumns({f"_len_{f}": F.size(f"_tok_{f}") for f in self.fields})

    # What the query needs of the corpus.

    def _leaves(self, expr: object) -> list[object]:
        if isinstance(expr, (q.Word, q.Phrase)):
            return [expr]
        if isinstance(expr, (q.Scope, q.Not)):
            return self._leaves(expr.inner)
        if isinstance(expr, q.Near):
            return self._leaves(expr.left) + self._leaves(expr.right)
        return [x for part in expr.parts for x in self._leaves(part)]

    def prepare(self, *exprs: object, every: bool = False) -> None:
        """Looks up what exprs need. With every, all documents are rows, also those that cannot match."""
        leaves = [x for expr in exprs for x in self._leaves(expr)]
        kinds = [q.pattern(x.text) for x in leaves if isinstance(x, q.Word) and x.text != "*"]
        terms = {t for k in kinds if isinstance(k, q.Exact) for _, t in k.tokens} | {t for x in leaves if isinstance(x, q.Phrase) for _, t in py_tokens(x.text)}
        for k in kinds:
            if isinstance(k, (q.Fuzzy, q.Wildcard)) and k not in self.words and not (self.base is not None and self.base.isStreaming and isinstance(k, q.Wildcard)):
                found = self._stands_for(k)
                if found is not None:
                    self.words[k] = found
        if self.index:
            self._from_index(terms, kinds, every or any(holds_without_words(e) for e in exprs))
            return
        aggs = [F.count(F.lit(1)).alias("n")]
        ordered = sorted(terms)
        for f in self.fields:
            aggs.append(F.coalesce(F.avg(f"_len_{f}"), F.lit(0.0)).alias(f"len_{f}"))
            for i, t in enumerate(ordered):
                aggs.append(F.count(F.when(F.expr(f"size({self._places(f, t)}) > 0"), 1)).alias(f"df_{f}_{i}"))
        row = self.base.agg(*aggs).first()
        self.stats = Stats(row["n"], {f: row[f"len_{f}"] for f in self.fields}, {(f, t): row[f"df_{f}_{i}"] for f in self.fields for i, t in enumerate(ordered)})

    def _from_index(self, terms: set[str], kinds: list, every: bool) -> None:
        """The statistics of terms, and a row for each document that has what the query names; with every, for all documents."""
        index = self.index
        known = index.words().where(F.col("term").isin(sorted(terms))).collect() if terms else []  # fields times terms of the query
        totals = index.totals()
        frequency = {(f, t): 0 for f in self.fields for t in terms} | {(r.field, r.term): r.documents for r in known}
        self.stats = Stats(max((d for d, _ in totals.values()), default=0), {f: totals[f][1] / max(totals[f][0], 1) for f in self.fields}, frequency)
        open_ = [k for k in dict.fromkeys(kinds) if isinstance(k, q.Wildcard) and k not in self.words]
        found = index.with_terms(terms | {w for k in kinds if not isinstance(k, q.Exact) and k in self.words for w in self.words[k]}, tuple(k.pattern for k in open_))
        at = F.transform("places", lambda p: F.struct(F.col("term").alias("t"), p.alias("p")))
        of = lambda f, x: F.when(F.col("field") == f, x)
        rows = found.groupBy(*index.keys).agg(
            *(F.flatten(F.collect_list(of(f, at))).alias(f"_tok_{f}") for f in self.fields), *(F.max(of(f, F.col("length"))).alias(f"_len_{f}") for f in self.fields)
        )
        if every:
            on = [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in index.keys]
            all_, own = index.rows().alias("k"), rows.alias("r")
            none = F.array().cast("array<struct<t:string,p:int>>")
            rows = all_.join(own, on, "left").select(*(f"k.{c}" for c in index.keys), *(F.coalesce(f"_tok_{f}", none).alias(f"_tok_{f}") for f in self.fields), *(f"_len_{f}" for f in self.fields))
        self.base = rows

    def _stands_for(self, k: q.Fuzzy | q.Wildcard) -> list[str] | None:
        """The words that a wildcard or a fuzzy word stands for, counted against the query's bounds; None if it is to go beyond."""
        if self.index:
            found, seen = self.index.near(k.term, k.distance, self.visited) if isinstance(k, q.Fuzzy) else self.index.like(k.pattern, self.visited)
        else:
            each = F.explode(F.array_distinct(F.transform(F.concat(*(F.col(f"_tok_{f}") for f in self.fields)), lambda x: x["t"])))
            words = self.base.select(each.alias("t")).distinct()
            if isinstance(k, q.Fuzzy):  # a swap of neighbours is two changes there
                words = words.where((F.abs(F.length("t") - len(k.term)) <= k.distance) & (F.levenshtein("t", F.lit(k.term)) <= 2 * k.distance))
            else:
                words = words.where(F.col("t").rlike(k.regex))
            found = [r.t for r in words.limit(self.visited + 1).collect()]
            seen = len(found)
        if self.whole and isinstance(k, q.Wildcard) and (seen > self.visited or len(found) > self.expanded):
            return None
        self.visited -= seen
        if self.visited < 0:
            raise q.QueryError(f"a query looks at no more than {q.MAX_VISITED} words of the vocabulary; narrow the pattern")
        if isinstance(k, q.Fuzzy):
            found = [t for t in found if q.osa(k.term, t, k.distance) <= k.distance]
        self.expanded -= len(found)
        if self.expanded < 0:
            raise q.QueryError(f"wildcards and fuzzy words of a query stand for no more than {q.MAX_EXPANDED} words; narrow the pattern")
        return sorted(found)

    # Clauses, as SQL of Spark: a query becomes one expression, which is parsed once.

    def _targets(self, scope: str | None) -> list[tuple[str, float]]:
        return [(scope, 1.0)] if scope else [(f, w) for f, w in q.BOOSTS.items() if f in self.fields]

    def _places(self, f: str, term: str) -> str:
        return f"transform(filter(_tok_{f}, x -> x.t = {_text(term)}), x -> x.p)"

    def _bm25(self, f: str, terms: list[str], count: str) -> str:
        s = self.stats
        idf = sum((math.log1p((s.documents - s.frequency[f, t] + 0.5) / (s.frequency[f, t] + 0.5)) for t in terms), 0.0)
        length = f"coalesce(_len_{f}, 0) / {_number(s.mean_length[f] or 1.0)}"
        return f"({_number(idf)} * ({count}) * {_number(K1 + 1)} / (({count}) + {_number(K1)} * ({_number(1 - B)} + {_number(B)} * {length})))"

    def _starts(self, f: str, sequence: tuple[tuple[int, str], ...]) -> str:
        """Where the words of a sequence stand at their distances."""
        first = sequence[0][0]
        out = self._places(f, sequence[0][1])
        for place, term in sequence[1:]:
            out = f"array_intersect({out}, transform({self._places(f, term)}, p -> p - {place - first}))"
        return out

    def _sequence(self, f: str, sequence: tuple[tuple[int, str], ...]) -> tuple[str, str]:
        n = f"size({self._starts(f, sequence)})"
        return f"({n} > 0)", self._bm25(f, [t for _, t in sequence], f"cast({n} as double)")

    @staticmethod
    def _any_of(parts: list[tuple[str, str]]) -> tuple[str, str]:
        if not parts:
            return "false", "0D"
        return "(" + " or ".join(m for m, _ in parts) + ")", "(" + " + ".join(f"if({m}, {s}, 0D)" for m, s in parts) + ")"

    @staticmethod
    def _all_of(parts: list[tuple[str, str]]) -> tuple[str, str]:
        return "(" + " and ".join(m for m, _ in parts) + ")", "(" + " + ".join(s for _, s in parts) + ")"

    def _in_words(self, f: str, kind: q.Wildcard | q.Fuzzy) -> str:
        if kind not in self.words:
            return f"filter(_tok_{f}, x -> x.t rlike {_text(kind.regex)})"
        held = f"x.t in ({', '.join(map(_text, self.words[kind]))})" if self.words[kind] else "false"
        return f"filter(_tok_{f}, x -> {held})"

    def compile(self, expr: object, scope: str | None = None) -> tuple[str, str]:
        """(matches, score); the score counts where it matches."""
        if isinstance(expr, q.And):
            return self._all_of([self.compile(p, scope) for p in expr.parts])
        if isinstance(expr, q.Or):
            return self._any_of([self.compile(p, scope) for p in expr.parts])
        if isinstance(expr, q.Not):
            return f"(not {self.compile(expr.inner, scope)[0]})", "1D"
        if isinstance(expr, q.Scope):
            return self.compile(expr.inner, expr.field)
        if isinstance(expr, q.Word):
            if expr.text == "*" and scope is None:
                return "true", "1D"
            kind, parts = q.pattern(expr.text), []
            for f, w in self._targets(scope):
                if isinstance(kind, q.Exact):
                    m, s = self._all_of([self._sequence(f, ((0, t),)) for _, t in kind.tokens])
                    parts.append((m, f"{s} * {_number(w)}"))
                else:
                    parts.append((f"(size({self._in_words(f, kind)}) > 0)", _number(w)))
            return self._any_of(parts)
        if isinstance(expr, q.Phrase):
            found = [(w, *self._sequence(f, tuple(py_tokens(expr.text)))) for f, w in self._targets(scope)]
            return self._any_of([(m, f"{s} * {_number(w)}") for w, m, s in found])
        parts = []
        for f, w in self._targets(scope):
            left, right = self._spans(expr.left, f), self._spans(expr.right, f)
            if left is None or right is None:
                continue
            near = self._before(left[0], right[0], expr.distance)
            if not expr.ordered:
                near = f"({near} or {self._before(right[0], left[0], expr.distance)})"
            parts.append((near, f"({left[1]} + {right[1]}) * {_number(w)}"))
        return self._any_of(parts)

    def _spans(self, expr: object, f: str) -> tuple[str, str] | None:
        """Spans (s, e) of a proximity operand in one field, and the score of its words."""
        if isinstance(expr, q.Scope):
            return self._spans(expr.inner, f) if expr.field == f else None
        if isinstance(expr, q.Or):
            parts = [x for x in (self._spans(p, f) for p in expr.parts) if x is not None]
            return (f"concat({', '.join(s for s, _ in parts)})", "(" + " + ".join(x for _, x in parts) + ")") if parts else None
        if isinstance(expr, q.Word) and not isinstance(kind := q.pattern(expr.text), q.Exact):
            found = self._in_words(f, kind)
            return f"transform({found}, x -> struct(x.p as s, x.p as e))", f"if(size({found}) > 0, 1D, 0D)"
        sequence = tuple(py_tokens(expr.text))
        wide = sequence[-1][0] - sequence[0][0]
        m, s = self._sequence(f, sequence)
        return f"transform({self._starts(f, sequence)}, p -> struct(p as s, p + {wide} as e))", f"if({m}, {s}, 0D)"

    @staticmethod
    def _before(left: str, right: str, distance: int) -> str:
        """Whether some right span begins behind a left one with at most distance words between, in one walk over both."""
        ends, starts = f"transform({left}, x -> struct(x.e as p, 1 as k))", f"transform({right}, y -> struct(y.s as p, 0 as k))"  # a start before an end at the same place
        near = f"x.k = 0 and a.end >= 0 and x.p - a.end - 1 <= {distance}"
        step = f"struct(if(x.k = 1, x.p, a.end) as end, a.hit or ({near}) as hit)"
        return f"aggregate(array_sort(concat({ends}, {starts})), struct(-1 as end, false as hit), (a, x) -> {step}).hit"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"{value!r}D"


def search(docs: DataFrame | TextIndex, query: str, fields: dict[str, str], keep: tuple[str, ...], whole: bool = False) -> DataFrame:
    """The matching rows of docs: keep and score. Of an index, keep names key columns. With whole, wildcards have no bounds."""
    expr = q.parse(query, tuple(fields))
    compiler = Compiler(docs, fields, whole=whole)
    compiler.prepare(expr)
    match, score = compiler.compile(expr)
    return compiler.base.where(match).select(*keep, F.expr(score).alias("score"))


def explain_clauses(docs: DataFrame | TextIndex, query: str, fields: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """For each document, whether each clause of the query holds: (keep, clause, text, holds)."""
    expr = q.parse(query, tuple(fields))
    compiler = Compiler(docs, fields)
    compiler.prepare(expr, every=True)
    rows: list[str] = []

    def walk(e: object, scope: str | None, positive: bool) -> None:
        said = f"{len(rows)} as clause, {_text(type(e).__name__.lower())} as kind, {_text(getattr(e, 'text', '') or '')} as text, {str(positive).lower()} as positive"
        rows.append(f"struct({said}, {compiler.compile(e, scope)[0]} as holds)")
        if isinstance(e, q.Scope):
            walk(e.inner, e.field, positive)
        elif isinstance(e, q.Not):
            walk(e.inner, scope, not positive)
        elif isinstance(e, (q.And, q.Or)):
            for part in e.parts:
                walk(part, scope, positive)

    walk(expr, None, True)
    return compiler.base.select(*keep, F.expr(f"inline(array({', '.join(rows)}))"))
