"""Ingest, snapshots, evidence for answers, approximate vector search, and other write-side pieces."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import tokens
from lexigrove.operators.tables import commit, snapshot, version  # noqa: F401 - snapshots are written and read with these
from lexigrove.session import checkpointed


def ingest(batch: DataFrame, key: tuple[str, ...], order: tuple[str, ...], text: str) -> DataFrame:
    """What a batch writes: the last row of each key, if it has text."""
    rest = [c for c in batch.columns if c not in key]
    last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    return last.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)


def replaced(table: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """table with all rows of the batch's documents replaced by the batch's; columns that one side lacks are null."""
    return table.join(batch.select(*key).distinct(), list(key), "left_anti").unionByName(batch, allowMissingColumns=True)


def generation(inputs: list[str], plan: dict) -> str:
    """A token that changes with the input files or the plan's parameters."""
    import hashlib

    return hashlib.sha256(json.dumps([sorted(inputs), plan], sort_keys=True).encode()).hexdigest()


# Positions over stitched parts.


def stitched_tokens(parts: DataFrame, key: str, place: str, text: str, gap: int = 2048, begin: str | None = None, end: str | None = None) -> DataFrame:
    """(key, term, position) over a document's parts in order.

    A part begins ``gap`` places behind the last one, so no phrase or proximity crosses. Where the columns ``begin`` and
    ``end`` tell a part's first character in the document and the one behind its last, parts that touch or overlap are
    one text instead, in which what they share counts once; parts that differ there are an error. A null is unknown.
    """
    w = Window.partitionBy(key).orderBy(place)
    body = F.coalesce(F.col(text), F.lit(""))
    own = parts.select(key, place, body.alias("_s"), F.lit(True).alias("_new"))
    if begin and end:
        shared = F.lag(F.col(end)).over(w) - F.col(begin)
        own = parts.select(key, place, body.alias("_s"), shared.alias("_o"), F.lag(body).over(w).alias("_p"))
        touch = F.coalesce(F.col("_o") >= 0, F.lit(False))
        differ = touch & (F.col("_o") > 0) & ((F.col("_o") > F.length("_p")) | ~F.col("_p").endswith(F.expr("substr(_s, 1, _o)")))
        rest = F.when(differ, F.raise_error(F.lit("parts differ where they overlap"))).when(touch, F.expr("substr(_s, int(_o) + 1)")).otherwise(F.col("_s"))
        own = own.select(key, place, rest.alias("_s"), (~touch).alias("_new"))
    counted = own.select(key, place, "_new", tokens(F.col("_s")).alias("_t"), F.size(F.regexp_extract_all("_s", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_n"))
    words = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    breaks = F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1  # the first part is new
    return counted.select(key, (words + breaks * gap).alias("_b"), "_t").select(key, "_b", F.explode("_t").alias("x")).select(key, F.col("x.t").alias("term"), (F.col("_b") + F.col("x.p")).alias("position"))


def whole_times(rows: DataFrame, limit: int, time: str) -> DataFrame:
    """About limit rows in time order; a time that the limit would split comes whole."""
    edge = rows.select(time).orderBy(time).limit(limit).agg(F.max(time).alias("_edge"))
    return rows.join(edge, rows[time] <= edge["_edge"]).drop("_edge")  # one row on the right


# Evidence.


def pack_evidence(passages: list[tuple[str, str]], question: str, window: int, count: Callable[[str], int] = lambda t: math.ceil(len(t) / 4)) -> tuple[list[tuple[str, str]], int]:
    """Ranked (label, text) passages that fit a model's window beside the question and the answer, and the tokens kept for the answer.

    A quarter of the window (128 at least) is for the answer and a fifth of the rest a margin; the last passage is cut
    at a character, and none under 64 tokens is begun.
    """
    answer = max(128, window // 4)
    left = int((window - answer) * 0.8) - count(question)
    out = []
    for label, text in passages:
        if left < 64:
            break
        cost = count(text)
        if cost > left:
            low, high = 0, len(text)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if count(text[:mid]) <= left else (low, mid - 1)
            text, cost = text[:low], left
        out.append((label, text))
        left -= cost
    return out, answer


def packed_evidence(passages: DataFrame, questions: DataFrame, window: int) -> DataFrame:
    """(question_id, label, rank, text, tokens): ``pack_evidence`` for many questions at once, four characters a token.

    passages: (question_id, rank, label, text), questions: (question_id, question). A passage is whole while there is
    room, the first that is too long is cut, and none is begun with room for less than 64 tokens.
    """
    tokens = lambda c: F.ceil(F.length(c) / 4).cast("bigint")
    room = F.floor(F.lit(window - max(128, window // 4)) * F.lit(0.8)).cast("bigint") - tokens(F.coalesce("question", F.lit("")))
    rows = passages.withColumn("text", F.coalesce("text", F.lit(""))).join(questions.select("question_id", room.alias("_room")), "question_id")
    before = F.sum(tokens(F.col("text"))).over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_left", F.col("_room") - F.coalesce(before, F.lit(0))).where("_left >= 64")
    kept = rows.withColumn("text", F.expr("substring(text, 1, int(4 * _left))"))
    return kept.select("question_id", "label", "rank", "text", tokens(F.col("text")).alias("tokens"))


def highlighted(terms: list[tuple[int, int, float]], least: float = 0.65) -> list[tuple[int, int, float]]:
    """Spans of similar enough tokens, touching ones merged."""
    from lexigrove.functions.text import merge_spans

    return merge_spans([t for t in terms if t[2] >= least])


#: Scorers by name, for reranking; a scorer takes queries and texts and returns numbers.
SCORERS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {"overlap": lambda q, t: pd.Series([len(set(a.lower().split()) & set(b.lower().split())) / max(len(set(a.lower().split())), 1) for a, b in zip(q, t, strict=True)])}


def scored(rows: DataFrame, query: str, text: str, scorer: str = "overlap") -> DataFrame:
    """rows with a score from a registered scorer, computed a batch at a time."""
    run = SCORERS[scorer]
    return rows.withColumn("score", F.pandas_udf(lambda q, t: run(q.fillna(""), t.fillna("")), "double")(F.lit(query), F.col(text)))


# Approximate vector search.


#: Rows that are looked up exactly to measure how many lists a query has to probe.
CHECKED = 256


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


#: Rows of a packed block of vectors.
BLOCK = 1024
#: Scores of queries and centres that a task holds at once, and readings of a list by a query that it sends at once.
CELLS, READINGS = 1 << 18, 1 << 12


def best_of(s: np.ndarray, q: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score): of each row of cosines the n best columns by rounded score, then id, none of the row's own id.

    Only cosines that may round to the n-th score or above are ordered.
    """
    s[q[:, None] == k[None, :]] = -3
    least = np.partition(s, len(k) - n, axis=1)[:, len(k) - n] - 4e-6 if len(k) > n else np.full(len(q), -2.0)
    row, column = np.nonzero(s >= np.maximum(least, -2)[:, None])
    score = np.round(1 - np.clip(1 - s[row, column], 0, 2) / 2, 6)
    order = np.lexsort((k[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[first], column[first], score[first]


class VectorIndex:
    """A coarse partition of all rows by k-means (fitted on at most ``sample`` rows); a query probes the nearest lists.

    How many is measured on the rows themselves: as few as hold the share ``recall`` of the exact neighbours of CHECKED
    rows, over all rows. So the number grows with the table as its vectors need it. What is asked for is above the 0.9
    that queries get on average, since it is measured on a sample. Probing all ``lists`` is exact.
    """

    def __init__(self, rows: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 7, recall: float = 0.95):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = rows.count()
        self.lists = lists or min(max(int(math.sqrt(n)), 2), 65536)
        zero = ~F.exists("vector", lambda x: x != 0)  # has no direction; any list will do
        data = rows.withColumn("_f", array_to_vector(F.transform("vector", lambda x, i: F.when(zero & (i == 0), 1.0).otherwise(x.cast("double")))))
        few = data if n <= sample else data.orderBy(F.xxhash64("id")).limit(sample)
        model = KMeans(k=self.lists, seed=seed, featuresCol="_f", predictionCol="list", distanceMeasure="cosine").fit(few)
        self.centres = [c.tolist() for c in model.clusterCenters()]
        self.rows = checkpointed(model.transform(data).drop("_f"))
        self.recall = recall
        self._probes: dict[int, int] = {}

    def probes(self, n: int) -> int:
        """The fewest lists that hold the share ``recall`` of the n nearest rows of rows drawn by hash."""
        from lexigrove.operators.ranking import nearest

        if n not in self._probes:
            drawn = checkpointed(self.rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit("probes"))).limit(CHECKED))
            near = nearest(drawn, self.rows.select("id", "vector"), n)
            held = self.rows.select("id", "list").join(F.broadcast(near), "id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
            vectors = {r.id: r.vector for r in drawn.collect()}
            ranks: list[int] = []
            for r in held.collect():  # CHECKED rows of n numbers
                order = np.argsort(-(_units(np.array([vectors[r.query_id]], float)) @ _units(np.array(self.centres)).T)[0], kind="stable")
                ranks += np.argsort(order)[r.lists].tolist()
            self._probes[n] = sorted(ranks)[math.ceil(self.recall * len(ranks)) - 1] + 1 if ranks else len(self.centres)
        return self._probes[n]

    def search(self, query: list[float], n: int, probes: int | None = None) -> DataFrame:
        from lexigrove.operators.ranking import top, vector_score

        norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        near = sorted(range(len(self.centres)), key=lambda i: -sum(a * b for a, b in zip(query, self.centres[i], strict=True)) / norm(self.centres[i]))[: probes or self.probes(n)]
        rows = self.rows.where(F.col("list").isin(near)).select("id", F.round(vector_score(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))), 6).alias("score"))
        return top(rows, n, F.desc("score"), F.asc("id"))

    @cached_property
    def blocks(self) -> DataFrame:
        """(list, k_ids, k_m, wide): the rows of a list in packed blocks, and the largest angle of a block's rows to the centre."""
        centres = _units(np.array(self.centres))

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for number, part in _runs(batches, "list", BLOCK):
                m = _units(np.stack([np.asarray(v, np.float64) for v in part["vector"]]))
                wide = float(np.arccos(np.clip(m @ centres[number], -1, 1)).max())
                yield pd.DataFrame({"list": [number], "k_ids": [part["id"].to_numpy(np.int64).tobytes()], "k_m": [m.tobytes()], "wide": [wide]})

        near = self.rows.select("id", "vector", "list").repartition("list").sortWithinPartitions("list")
        return checkpointed(near.mapInPandas(packed, "list int, k_ids binary, k_m binary, wide double"))

    def _met(self, asked: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score) of the n best rows of each meeting of a list's block and the queries that read the list. asked: (query_id, vector, list)."""

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for number, part in _runs(batches, "list", BLOCK // 4):
                m = _units(np.stack([np.asarray(v, np.float64) for v in part["vector"]]))
                yield pd.DataFrame({"list": [number], "q_ids": [part["query_id"].to_numpy(np.int64).tobytes()], "q_m": [m.tobytes()]})

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    q, k = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.k_ids, np.int64)
                    s = np.frombuffer(r.q_m).reshape(len(q), -1) @ np.frombuffer(r.k_m).reshape(len(k), -1).T
                    which, place, score = best_of(s, q, k, n)
                    yield pd.DataFrame({"query_id": q[which], "id": k[place], "score": score})

        readers = asked.repartition("list").sortWithinPartitions("list").mapInPandas(packed, "list int, q_ids binary, q_m binary")
        return self.blocks.drop("wide").join(readers, "list").mapInPandas(meet, "query_id bigint, id bigint, score double")

    def _ordered(self, queries: DataFrame, first: int, last: int, radius: np.ndarray | None = None) -> DataFrame:
        """(query_id, vector, list, bound): the lists from place ``first`` to ``last`` in the order of each query; bound is the best score that the lists behind may have."""
        centres = _units(np.array(self.centres))
        block = max(min(BLOCK, CELLS // len(centres)), 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), block):
                    part = b.iloc[i : i + block]
                    s = _units(np.stack([np.asarray(v, np.float64) for v in part["vector"]])) @ centres.T
                    if radius is None:
                        order, bound = np.argsort(-s, axis=1, kind="stable"), np.zeros(len(part))
                    else:  # by what a list may hold at best: no row is nearer than the centre's angle less the list's radius
                        best = np.nan_to_num(np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - radius, 0)), nan=-1.0)
                        order = np.argsort(-best, axis=1, kind="stable")
                        behind = np.take_along_axis(best, order, 1)[:, last] if last < len(centres) else np.full(len(part), -1.0)
                        bound = 1 - np.clip(1 - behind, 0, 2) / 2 + 1e-6
                    lists = order[:, first:last]
                    wide = max(lists.shape[1], 1)
                    for j in range(0, len(part), max(READINGS // wide, 1)):  # each row has a query's whole vector
                        some, own = part.iloc[j : j + max(READINGS // wide, 1)], slice(j, j + max(READINGS // wide, 1))
                        yield pd.DataFrame({"query_id": np.repeat(some["id"].to_numpy(np.int64), lists.shape[1]), "vector": some["vector"].repeat(lists.shape[1]).to_numpy(), "list": lists[own].ravel().astype(np.int32), "bound": np.repeat(bound[own], lists.shape[1])})

        return queries.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(run, "query_id bigint, vector array<double>, list int, bound double")

    def search_all(self, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) as nearest() has it, from the lists that each of queries (id, vector) probes.

        Queries meet the blocks of the lists that they read, on the list, and no others.
        """
        from lexigrove.operators.ranking import top

        asked = self._ordered(queries, 0, min(probes or self.probes(n), len(self.centres))).drop("bound")
        return top(self._met(asked, n), n, F.desc("score"), F.asc("id"), by=("query_id",))

    def widened(self, queries: DataFrame, n: int, first: int = 1) -> DataFrame:
        """(query_id, id, score, rank, lists) equal to nearest(): exact, with the number of lists that each query read.

        A query reads lists in the order of the best score that they may hold, four times as many each round, until its
        n-th score is better than all others may have.
        """
        from lexigrove.operators.ranking import top

        radius = np.full(len(self.centres), np.nan)  # a list without rows is never near
        for r in self.blocks.groupBy("list").agg(F.max("wide").alias("wide")).collect():  # a row a list
            radius[r["list"]] = r.wide
        left, best, done, low, high = queries.select("id", "vector"), None, None, 0, max(first, 1)
        while True:
            high = min(high, len(self.centres))
            asked = checkpointed(self._ordered(left, low, high, radius))
            met = self._met(asked.drop("bound"), n)
            best = checkpointed(top(met if best is None else met.unionByName(best.select("query_id", "id", "score")), n, F.desc("score"), F.asc("id"), by=("query_id",)))
            bounds = asked.groupBy("query_id").agg(F.max("bound").alias("bound"))
            worst = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("worst"))
            state = bounds.join(worst, "query_id", "left").withColumn("over", (F.coalesce("held", F.lit(0)) >= n) & (F.col("worst") > F.col("bound")) | F.lit(high == len(self.centres)))
            state = checkpointed(state.select("query_id", "over"))
            ready = best.join(state.where("over"), "query_id", "left_semi").withColumn("lists", F.lit(high))
            done = ready if done is None else done.unionByName(ready)
            if high == len(self.centres) or state.where("not over").isEmpty():
                return done
            left = checkpointed(left.join(state.where("not over").select(F.col("query_id").alias("id")), "id", "left_semi"))
            best = best.join(state.where("not over"), "query_id", "left_semi")
            low, high = high, high * 4


def _runs(batches: Iterator[pd.DataFrame], by: str, most: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows that follow each other with one value of a column, at most ``most`` at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        cuts = [0, *(np.flatnonzero(np.diff(b[by].to_numpy())) + 1).tolist(), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            part = b.iloc[i:j]
            if held and (held[0][by].iloc[0] != part[by].iloc[0] or sum(map(len, held)) + len(part) > most):
                yield int(held[0][by].iloc[0]), pd.concat(held)
                held = []
            for k in range(0, len(part), most):
                piece = part.iloc[k : k + most]
                if len(piece) == most:
                    yield int(piece[by].iloc[0]), piece
                else:
                    held.append(piece)
    if held:
        yield int(held[0][by].iloc[0]), pd.concat(held)


# Small pieces.


def adler32(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: zlib.adler32((t or "").encode())), "bigint")(text)


def path_from_template(template: str, fields: dict[str, str]) -> str:
    """``{Field:name}`` parts filled in, made safe for file names."""
    safe = lambda v: re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", v).strip(" .") or "_"
    return re.sub(r"\{Field:([^}]+)\}", lambda m: safe(fields.get(m[1], "")), template)


def template_path(template: str, fields: dict[str, Column]) -> Column:
    """``path_from_template`` as a column."""
    parts: list[Column] = []
    for k, part in enumerate(re.split(r"\{Field:([^}]+)\}", template)):
        if k % 2:
            safe = F.trim(F.regexp_replace(F.coalesce(fields.get(part, F.lit("")).cast("string"), F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(" ."))
            parts.append(F.when(safe == "", "_").otherwise(safe))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def token_windows(parts: Column, budget: int) -> Column:
    """``token_chunks`` over a column of tokens: arrays of at most budget of them, min(budget / 8, 64) shared with the next."""
    step = max(budget - min(budget // 8, 64), 1)
    last = F.greatest(F.size(parts) - (budget - step), F.lit(1)) - 1
    begins = F.when(F.size(parts) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.slice(parts, i + 1, budget))


def token_chunks(text: str, budget: int, encode: Callable[[str], list[str]]) -> list[str]:
    """Chunks of at most budget tokens, min(budget / 8, 64) of them shared with the next."""
    parts = encode(text)
    step = max(budget - min(budget // 8, 64), 1)
    return ["".join(parts[i : i + budget]) for i in range(0, max(len(parts) - (budget - step), 1), step)] if parts else []


def member_id(root: str, chain: list[tuple[str, int]]) -> str:
    """The id of an archive's member: of the archive, and each name with its occurrence on the way."""
    import hashlib

    return hashlib.sha256("\x1f".join([root, *(f"{name}\x1e{n}" for name, n in chain)]).encode()).hexdigest()


def cursor_problem(cursor: dict, now: dict) -> str | None:
    """Why a page cursor cannot be used; None if it can."""
    if cursor.get("scope") != now.get("scope"):
        return "the cursor is of another scope"
    if cursor.get("snapshot", 0) > now.get("snapshot", 0):
        return "the cursor is ahead of the table"
    if (cursor.get("after") is None) != (cursor.get("page", 0) == 0):
        return "only the first page begins without a place"
    return None


def zipped_text(name: str, data: bytes) -> str:
    """The text of EPUB chapters or PPTX slides, in order."""
    import io
    import zipfile
    from xml.etree import ElementTree

    from lexigrove.sources.readers import html_parts

    z = zipfile.ZipFile(io.BytesIO(data))
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0]
    if name.lower().endswith(".pptx"):
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        return "\n".join(" ".join(t.text or "" for t in ElementTree.fromstring(z.read(n)).iter() if t.tag.endswith("}t")) for n in slides)
    pages = sorted((n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))), key=lambda n: (number(n), n))
    return "\n".join(html_parts(z.read(n).decode(errors="replace"))[0] for n in pages)
