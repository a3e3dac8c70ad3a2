"""Vectors as codes of their parts: many rows are scored from tables of a few numbers, few are read whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.ingest import BLOCK, CELLS, CHECKED, VectorIndex, _runs, _units
from lexigrove.operators.ranking import nearest, top
from lexigrove.session import checkpointed

#: Codes of a part; one byte names one of them.
CODES = 256
#: Steps between the worst and the best score, by which candidates are counted before any is sent.
STEPS = 4096
#: Queries of a group, and tasks for each core into which groups are dealt where there are fewer groups.
GROUP, TASKS = 512, 4
#: Candidates that a task holds beyond twice those of its group before it drops the worse ones.
SPARE = 1 << 18
#: Rounds in which a part's codes move to the middle of what they stand for.
ROUNDS = 15


def _codebook(parts: np.ndarray, seed: int) -> np.ndarray:
    """At most CODES points that stand for the rows of ``parts``."""
    found = np.unique(parts, axis=0)
    if len(found) <= CODES:
        return found
    codes = found[np.random.default_rng(seed).choice(len(found), CODES, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_codes(parts, codes)
        held = np.bincount(own, minlength=CODES)
        sums = np.stack([np.bincount(own, parts[:, d], CODES) for d in range(parts.shape[1])], axis=1)
        codes = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], codes)
    return codes


def _nearest_codes(parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The place of the nearest code of each row, blockwise."""
    own = np.empty(len(parts), np.int64)
    square = (codes * codes).sum(axis=1)
    for i in range(0, len(parts), 8 * BLOCK):
        own[i : i + 8 * BLOCK] = np.argmin(square - 2 * parts[i : i + 8 * BLOCK] @ codes.T, axis=1)
    return own


def _decoded(books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The vectors that codes (part × row) stand for. Products with them are sums over the parts, as a table for each query would give."""
    return np.concatenate([c[codes[p]] for p, c in enumerate(books)], axis=1)


def _in_steps(s: np.ndarray) -> np.ndarray:
    """Scores from -1 to 1, in place, as numbers whose whole part is the step."""
    s += 1
    s *= STEPS / 2
    return np.clip(s, 0, np.nextafter(STEPS, 0), out=s)


class _Best:
    """The ``most`` best rows of each query by step, then id, of the blocks that were added."""

    def __init__(self, q: np.ndarray, most: int):
        self.q, self.most = q, most
        self.least = np.zeros(len(q))  # the step of the last that a query holds, if it holds as many as it may
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
        self.n = 0

    def add(self, own: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        i, j = np.nonzero(s >= self.least[own][:, None])
        self.held.append((own[i], s[i, j].astype(np.int32), ids[j]))
        self.n += len(i)
        if self.n > 2 * self.most * len(self.q) + SPARE:
            self.cut()

    def cut(self) -> None:
        row, step, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -step, row))
        row, step, ids = row[order], step[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last, first = place == self.most - 1, place < self.most
        self.least[row[last]] = step[last]
        self.held, self.n = [(row[first], step[first], ids[first])], int(first.sum())

    def done(self) -> pd.DataFrame:
        self.cut()
        row, step, ids = self.held[0]
        return pd.DataFrame({"query_id": self.q[row], "step": step, "id": ids})


class _Places:
    """The place of each of a query's nearest among the rows of the blocks that were added, by step, then id. steps, near: (query × rank); steps are NaN where there is none."""

    def __init__(self, q: np.ndarray, steps: np.ndarray, near: np.ndarray):
        self.q, self.steps, self.near, self.n = q, steps, near, np.zeros(steps.shape, np.int64)

    def add(self, own: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        step = np.floor(s)
        for rank in range(self.steps.shape[1]):
            least = self.steps[own, rank][:, None]
            self.n[own, rank] += ((step > least) | (step == least) & (ids <= self.near[own, rank][:, None])).sum(axis=1)

    def done(self) -> pd.DataFrame:
        row, rank = np.nonzero(~np.isnan(self.steps))
        return pd.DataFrame({"query_id": self.q[row], "rank": rank.astype(np.int32), "n": self.n[row, rank]})


class QuantisedIndex(VectorIndex):
    """A ``VectorIndex`` whose lists hold codes: a byte for each part of ``width`` numbers of what a row differs from its list's centre.

    The score of a row is the query's product with the centre and with the code of each part. Queries go in groups, which
    meet the codes of the lists that they read as products of matrices. Candidates are the best by these scores, at least as many as hold the share ``recall`` of the exact
    neighbours of CHECKED rows, which is measured on the table; only they are read whole and scored exactly.
    Their number follows the size of the parts: on vectors without clusters, parts of 8 numbers need ten times the
    candidates that parts of 4 do (1357 and 145 for 51 282 rows of 64 numbers).
    Codebooks are fitted on at most ``sample`` rows, each part in its own task; all rows are coded. Vectors have one length.
    """

    def __init__(self, rows: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 7, recall: float = 0.97, width: int = 8):
        super().__init__(rows, lists, sample, seed, recall)
        self.width, self.seed, self.sample = width, seed, sample
        self._candidates: dict[int, int] = {}

    @cached_property
    def codebooks(self) -> list[np.ndarray]:
        """The points of each part. They take up CODES times the length of a vector, whatever the number of rows."""
        centres, width, seed = _units(np.array(self.centres)), self.width, self.seed

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    rest = _units(np.stack([np.asarray(v, np.float64) for v in b["vector"]])) - centres[b["list"].to_numpy()]
                    for part, i in enumerate(range(0, rest.shape[1], width)):
                        yield pd.DataFrame({"part": part, "own": list(rest[:, i : i + width])})

        def fitted(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            codes = _codebook(np.stack(b["own"].to_list()), seed)
            return pd.DataFrame({"part": [key[0]], "codes": [codes.tobytes()], "n": [len(codes)]})

        drawn = self.rows.select("id", "vector", "list").orderBy(F.xxhash64("id", F.lit("codes"))).limit(self.sample)
        parts = drawn.repartition("list").mapInPandas(cut, "part int, own array<double>").groupBy("part").applyInPandas(fitted, "part int, codes binary, n int")
        return [np.frombuffer(r.codes).reshape(r.n, -1) for r in sorted(parts.collect(), key=lambda r: r.part)]  # a row a part

    @cached_property
    def coded(self) -> DataFrame:
        """(list, k_ids, k_codes): the rows of a list in packed blocks."""
        centres, books, width = _units(np.array(self.centres)), self.codebooks, self.width

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for number, part in _runs(batches, "list", 4 * BLOCK):
                rest = _units(np.stack([np.asarray(v, np.float64) for v in part["vector"]])) - centres[number]
                codes = np.stack([_nearest_codes(rest[:, p * width : (p + 1) * width], c) for p, c in enumerate(books)]).astype(np.uint8)
                yield pd.DataFrame({"list": [number], "k_ids": [part["id"].to_numpy(np.int64).tobytes()], "k_codes": [codes.tobytes()]})

        near = self.rows.select("id", "vector", "list").repartition("list").sortWithinPartitions("list")
        return checkpointed(near.mapInPandas(packed, "list int, k_ids binary, k_codes binary"))

    def _groups(self, queries: DataFrame, probes: int) -> DataFrame:
        """(first, q_ids, q_m, reads, lists): at most GROUP queries, near each other where vectors have clusters; the lists that any of them reads, and for each list a bit for each query that reads it."""
        centres = _units(np.array(self.centres))
        block, k = max(CELLS // len(centres), 1), min(probes, len(centres))
        units = lambda part: _units(np.stack([np.asarray(v, np.float64) for v in part["vector"]]))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), block):
                    part = b.iloc[i : i + block]
                    yield part.assign(near=np.argmax(units(part) @ centres.T, axis=1).astype(np.int32))

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, part in _runs(batches, "all", GROUP):
                m, reads = units(part), np.zeros((len(centres), len(part)), bool)
                for i in range(0, len(part), block):
                    order = np.argsort(-(m[i : i + block] @ centres.T), axis=1, kind="stable")[:, :k]
                    reads[order, i + np.arange(len(order))[:, None]] = True
                lists = np.flatnonzero(reads.any(axis=1)).astype(np.int32)
                yield pd.DataFrame({"q_ids": [part["query_id"].to_numpy(np.int64).tobytes()], "q_m": [m.tobytes()], "reads": [np.packbits(reads, axis=1).tobytes()], "lists": [lists]})

        asked = queries.select(F.col("id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        near = checkpointed(asked.mapInPandas(placed, "query_id bigint, vector array<double>, near int"))
        dealt = near.repartitionByRange(max(-(-near.count() // (8 * GROUP)), 1), "near").sortWithinPartitions("near").withColumn("all", F.lit(0))
        groups = dealt.mapInPandas(packed, "q_ids binary, q_m binary, reads binary, lists array<int>")
        return checkpointed(groups.select(F.monotonically_increasing_id().alias("first"), "*"))

    def _met(self, groups: DataFrame, begun: Callable[[np.ndarray], _Best | _Places], schema: str) -> tuple[DataFrame, int]:
        """What is found where groups meet the codes of the lists that they read, and in how many parts a group's lists were read.

        A group's queries come first and its lists follow one block at a time, so a task holds one group and one block, and
        what moves for a reading of a list is the list's codes once a group, not the vectors of the queries.
        """
        spark, centres, books = groups.sparkSession, _units(np.array(self.centres)), self.codebooks
        n = groups.count()
        parts = max(-(-TASKS * spark.sparkContext.defaultParallelism // max(n, 1)), 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                for r in b.itertuples():
                    ids = np.frombuffer(r.ids, np.int64)
                    if r.list < 0:
                        if held is not None:
                            yield held.done()
                        q, m = ids, np.frombuffer(r.m).reshape(len(ids), -1)
                        reads = np.frombuffer(r.reads, np.uint8).reshape(len(centres), -1)
                        held = begun(q)
                        continue
                    own = np.flatnonzero(np.unpackbits(reads[r.list], count=len(q)))
                    s = m[own] @ (_decoded(books, np.frombuffer(r.m, np.uint8).reshape(len(books), -1)) + centres[r.list]).T
                    s = _in_steps(s)
                    s[q[own][:, None] == ids[None, :]] = np.nan  # a row and itself
                    held.add(own, ids, s)
            if held is not None:
                yield held.done()

        no = F.lit(None).cast("binary").alias("reads")
        asked = groups.select("first", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("list"), F.col("q_ids").alias("ids"), F.col("q_m").alias("m"), "reads")
        read = groups.select("first", F.explode("lists").alias("list")).join(self.coded, "list")
        read = read.select("first", F.pmod(F.xxhash64("k_ids"), F.lit(parts)).cast("int").alias("part"), "list", F.col("k_ids").alias("ids"), F.col("k_codes").alias("m"), no)
        stream = asked.unionByName(read).repartition(max(n, 1) * parts, "first", "part").sortWithinPartitions("first", "part", "list")
        return stream.mapInPandas(run, schema), parts

    def candidates(self, n: int) -> int:
        """How many rows, the best by their codes, hold the share ``recall`` of the n nearest of rows drawn by hash."""
        if n in self._candidates:
            return self._candidates[n]
        drawn = checkpointed(self.rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit("candidates"))).limit(CHECKED))
        near = nearest(drawn, self.rows.select("id", "vector"), n).select("query_id", "id", "rank")
        found = self.rows.join(F.broadcast(near), "id").join(F.broadcast(drawn.select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))), "query_id").toPandas()  # CHECKED rows of n vectors
        steps: dict[int, np.ndarray] = {}
        ids: dict[int, np.ndarray] = {}
        if len(found):
            centres, books, width = _units(np.array(self.centres)), self.codebooks, self.width
            own = centres[found["list"].to_numpy()]
            q, k = (_units(np.stack([np.asarray(v, np.float64) for v in found[c]])) for c in ("asked", "vector"))
            codes = np.stack([_nearest_codes((k - own)[:, p * width : (p + 1) * width], c) for p, c in enumerate(books)])
            step = np.floor(_in_steps((q * (_decoded(books, codes) + own)).sum(axis=1)))
            for query, key, rank, at in zip(found["query_id"].tolist(), found["id"].tolist(), found["rank"].tolist(), step.tolist(), strict=True):
                steps.setdefault(query, np.full(n, np.nan))[rank - 1] = at
                ids.setdefault(query, np.zeros(n, np.int64))[rank - 1] = key
        no = np.full(n, np.nan), np.zeros(n, np.int64)
        places_of = lambda q: _Places(q, np.stack([steps.get(x, no[0]) for x in q.tolist()]), np.stack([ids.get(x, no[1]) for x in q.tolist()]))
        counts, _ = self._met(self._groups(drawn, len(self.centres)), places_of, "query_id bigint, rank int, n bigint")
        places = [r.n for r in counts.groupBy("query_id", "rank").agg(F.sum("n").alias("n")).collect()]  # as many
        self._candidates[n] = max(sorted(places)[math.ceil(self.recall * len(places)) - 1], n) if places else n
        return self._candidates[n]

    def shortlist(self, queries: DataFrame, most: int, probes: int) -> DataFrame:
        """(query_id, id): of the rows of the probed lists the ``most`` best by the steps of their scores by codes, of equal ones those with the smallest ids."""
        found, parts = self._met(self._groups(queries, probes), lambda q: _Best(q, most), "query_id bigint, step int, id bigint")
        if parts > 1:
            found = top(found, most, F.desc("step"), F.asc("id"), by=("query_id",))
        return found.select("query_id", "id")

    def search_all(self, queries: DataFrame, n: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) as nearest() has it, of the candidates by code; their scores are exact."""

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q, k = (_units(b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)) for c in ("asked", "vector"))
                    score = np.round(1 - np.clip(1 - (q * k).sum(axis=1), 0, 2) / 2, 6)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(score)], ["query_id", "id", "score"])

        short = self.shortlist(queries, candidates or self.candidates(n), probes or self.probes(n))
        asked = queries.select(F.col("id").cast("bigint").alias("query_id"), F.col("vector").alias("asked"))
        whole = short.join(self.rows.select(F.col("id").cast("bigint").alias("id"), "vector"), "id").join(asked, "query_id")
        return top(whole.mapInArrow(exact, "query_id bigint, id bigint, score double"), n, F.desc("score"), F.asc("id"), by=("query_id",))
