"""Hard negatives by distributed radix selection.

Scores are integer inner products of rows and anchors. For a window of scores (an anchor and one of its positives, or an
anchor and its own label), the k-th best row is found digit by digit: a pass counts the rows of the window by the leading
digit of their distance from the window's upper end, the bucket that holds the k-th is the window of the next pass, and
rows that tie in their score are told apart by digits of their id in the same way. Then one pass gathers the rows at or
above the k-th, and nothing else. No score is kept or shuffled; a pass computes it again as a matrix product.

A task counts a window's buckets from the best on, and stops where its own count reaches k: the k-th row of all is never
below the k-th of a part. So it sends k counts a window at most, and gathers k rows a window at most, whatever the number
of rows, ties or copies. A bucket of at most ``few`` rows more than are needed is gathered without another pass.

Anchors are a set of queries against all rows and are worked through in batches of ``batch``; the driver holds one batch
(its vectors, positives and windows) at a time. Rows are dealt evenly and never by label, so a common label or vector
makes no task longer.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; other columns are
not read. Ids are integers; null ids come after all others in ties and are no anchors. Rows with one id are rows of their
own, but none is a positive of an anchor with its id; equal rows give equal results, each once for each. Vectors of
different lengths are as if zeros filled up the shorter. Without rows, anchors or positives the result is empty. Products
of 2**62 or more raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import scratch, shuffle_partitions, written

#: Rows and windows that meet at a time in a task.
TILE = 512


@dataclass
class Anchors:
    """One batch of anchors, and what a task must know of the rows."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: What null ids count as: one more than the largest.
    no_id: int
    exact_int: bool


@dataclass
class Windows:
    """Score windows and how far the selection in them has come; arrays of one length."""

    anchor: np.ndarray
    own_label: bool
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    bucket_low: np.ndarray
    bucket_high: np.ndarray
    by_id: np.ndarray
    id_low: np.ndarray
    id_high: np.ndarray
    about: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, anchor: np.ndarray, own_label: bool, low: np.ndarray, high: np.ndarray, k: int, ids: tuple[int, int], **about: np.ndarray) -> Windows:
        n = len(anchor)
        full = lambda v: np.full(n, v, np.int64)
        return cls(anchor, own_label, low, high, full(k), low.copy(), high.copy(), np.zeros(n, bool), full(ids[0]), full(ids[1]), about)

    def take(self, at: np.ndarray) -> Windows:
        new = {c: getattr(self, c)[at] for c in ("anchor", "low", "high", "need", "bucket_low", "bucket_high", "by_id", "id_low", "id_high")}
        return replace(self, **new, about={c: v[at] for c, v in self.about.items()})

    def shift(self, digit_bits: int) -> np.ndarray:
        """How many bits come after a window's next digit."""
        wide = np.where(self.by_id, self.id_high - self.id_low, self.bucket_high - self.bucket_low)
        bits = np.array([int(w).bit_length() for w in wide], np.int64)
        return np.maximum(bits - digit_bits, 0)


def _rows(batch: pa.RecordBatch, anchors: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a batch of rows."""
    ids = batch.column(0).fill_null(anchors.no_id).to_numpy()
    values = batch.column(2)
    return ids, batch.column(1).to_numpy(), matrix(values, anchors.vectors.shape[1], anchors.vectors.dtype)


def matrix(values: pa.Array, wide: int, kind: np.dtype) -> np.ndarray:
    flat, at = values.flatten().to_numpy(), np.asarray(values.offsets)
    at = at - at[0]
    if len(flat) == len(values) * wide and (np.diff(at) == wide).all():
        return flat.reshape(-1, wide).astype(kind)
    out = np.zeros((len(values), wide), kind)
    row = np.repeat(np.arange(len(values)), np.diff(at))
    out[row, np.arange(len(flat)) - at[row]] = flat
    return out


def _meet(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, low: np.ndarray, high: np.ndarray, id_low: np.ndarray, id_high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) of the rows inside each window's bounds, tile by tile. The bounds may be narrowed meanwhile."""
    if not len(windows.anchor):
        return
    some_ids = bool((id_low > np.iinfo(np.int64).min).any() or (id_high < np.iinfo(np.int64).max).any())
    for batch in batches:
        ids, labels, vectors = _rows(batch, anchors)
        for i in range(0, len(ids), TILE):
            own, label = ids[i : i + TILE], labels[i : i + TILE]
            score = anchors.vectors @ vectors[i : i + TILE].T
            alike = anchors.labels[:, None] == label
            wanted = alike & (anchors.ids[:, None] != own) if windows.own_label else ~alike
            found = []
            for k in range(0, len(windows.anchor), TILE):
                part = slice(k, k + TILE)
                at = windows.anchor[part]
                s = score[at]
                inside = wanted[at] & (s >= low[part, None]) & (s <= high[part, None])
                if some_ids:
                    inside &= (own >= id_low[part, None]) & (own <= id_high[part, None])
                w, r = np.nonzero(inside)
                found.append((w + k, s[w, r].astype(np.int64), own[r]))
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def histogram(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, digit_bits: int) -> Iterator[pa.RecordBatch]:
    """(window, digit, n): the best buckets of each window down to the one where this task's rows reach the need."""
    shift = windows.shift(digit_bits)
    low, high = windows.bucket_low.copy(), windows.bucket_high
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    id_low, id_high = np.where(windows.by_id, windows.id_low, least), np.where(windows.by_id, windows.id_high, most)
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for w, s, own in _meet(batches, anchors, windows, low, high, id_low, id_high):
        if not len(w):
            continue
        far = np.where(windows.by_id[w], own - windows.id_low[w], windows.bucket_high[w] - s)
        new, n = np.unique((w << digit_bits) | (far >> shift[w]), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        # What lies beyond the bucket where the own count reaches the need cannot be needed.
        of = keys >> digit_bits
        upto = np.cumsum(counts)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        before = upto - counts - np.repeat((upto - counts)[start], np.diff(np.r_[start, len(of)]))
        keep = before < windows.need[of]
        over = keep & (before + counts >= windows.need[of])
        digit = keys[over] & ((1 << digit_bits) - 1)
        done = of[over]
        ids = windows.by_id[done]
        low[done[~ids]] = np.maximum(low[done[~ids]], windows.bucket_high[done[~ids]] - ((digit[~ids] + 1) << shift[done[~ids]]) + 1)
        id_high[done[ids]] = np.minimum(id_high[done[ids]], windows.id_low[done[ids]] + ((digit[ids] + 1) << shift[done[ids]]) - 1)
        keys, counts = keys[keep], counts[keep]
    yield pa.RecordBatch.from_arrays([pa.array((keys >> digit_bits).astype(np.int32)), pa.array(keys & ((1 << digit_bits) - 1)), pa.array(counts), pa.array(windows.need[keys >> digit_bits])], ["window", "digit", "n", "need"])


def gathered(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, k: int) -> Iterator[pa.RecordBatch]:
    """(window, id, score, and what is known about the window) of the rows at or above the k-th: k rows a window at most."""
    least, most = np.full(len(windows.anchor), np.iinfo(np.int64).min), np.full(len(windows.anchor), np.iinfo(np.int64).max)
    w, s, own = (np.empty(0, np.int64) for _ in range(3))
    for w2, s2, own2 in _meet(batches, anchors, windows, windows.bucket_low, windows.high, least, most):
        keep = (s2 > windows.bucket_high[w2]) | ~windows.by_id[w2] | (own2 <= windows.id_high[w2])
        w, s, own = np.concatenate([w, w2[keep]]), np.concatenate([s, s2[keep]]), np.concatenate([own, own2[keep]])
        if len(w) > 4 * k * max(len(windows.anchor), 1):
            w, s, own = _best(w, s, own, k)
    w, s, own = _best(w, s, own, k)
    cols = [pa.array(w.astype(np.int32)), pa.array(own, mask=own == anchors.no_id), pa.array(s), pa.array(anchors.ids[windows.anchor[w]]), *(pa.array(v[w]) for v in windows.about.values())]
    yield pa.RecordBatch.from_arrays(cols, ["window", "id", "score", "anchor_id", *windows.about])


def _best(w: np.ndarray, s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((own, -s, w))
    w, s, own = w[order], s[order], own[order]
    if not len(w):
        return w, s, own
    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
    return w[place < k], s[place < k], own[place < k]


def select(rows: DataFrame, anchors: Anchors, windows: Windows, k: int, ids: tuple[int, int], digit_bits: int, few: int) -> DataFrame:
    """(window, rank, id, score, anchor_id, ...): the best k rows of each window."""
    if digit_bits < 1:
        raise ValueError("a digit has one bit at least")
    left = np.arange(len(windows.anchor))
    while len(left):
        now = windows.take(left)
        shift = now.shift(digit_bits)
        counts = rows.mapInArrow(kernels.lean(lambda x: histogram(x, anchors, now, digit_bits)), "window int, digit bigint, n bigint, need bigint")  # noqa: B023 - run in this round
        held = counts.groupBy("window", "digit", "need").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        held = held.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        hit = held.select("window", "digit", "n", "before").toArrow()  # one row a window of the batch at most
        w, digit, n, passed = (hit.column(c).to_numpy() for c in ("window", "digit", "n", "before"))
        at, gap = left[w], shift[w]
        ids_now = windows.by_id[at]
        windows.need[at] -= passed
        top = windows.bucket_high[at] - (digit << gap)
        by_score = at[~ids_now]
        windows.bucket_high[by_score] = top[~ids_now]
        windows.bucket_low[by_score] = np.maximum(windows.bucket_low[by_score], (top - (1 << gap) + 1)[~ids_now])
        bottom = windows.id_low[at] + (digit << gap)
        by_id = at[ids_now]
        windows.id_low[by_id] = bottom[ids_now]
        windows.id_high[by_id] = np.minimum(windows.id_high[by_id], (bottom + (1 << gap) - 1)[ids_now])
        # A window that has no k rows is taken whole. Others go on while their bucket has too many rows and can be split.
        open_ = at[n > windows.need[at] + few]
        tied = open_[~windows.by_id[open_] & (windows.bucket_low[open_] == windows.bucket_high[open_])]
        windows.by_id[tied], windows.id_low[tied], windows.id_high[tied] = True, ids[0], ids[1]
        left = np.sort(open_[~windows.by_id[open_] | (windows.id_low[open_] < windows.id_high[open_])])
    about = "".join(f", {c} bigint" for c in windows.about)
    found = rows.mapInArrow(kernels.lean(lambda x: gathered(x, anchors, windows, k)), f"window int, id bigint, score bigint, anchor_id bigint{about}")
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, components as floor(scale * x)."""
    x = F.col("vector")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    found = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    found = found.where(F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return found.select("id", "label", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, digit_bits: int = 12, few: int = 64, batch: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. Negatives score from ``least`` to ``most`` hundredths of their positive's score.
    """
    with scratch() as stays:
        return _mined(rows, is_anchor, id_col, vector_col, label_col, positives, negatives, least, most, scale, digit_bits, few, batch, stays)


def _mined(
    rows: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str,
    positives: int, negatives: int, least: int, most: int, scale: int, digit_bits: int, few: int, batch: int, stays: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    table = written(integer_vectors(rows, id_col, vector_col, label_col, scale).repartition(shuffle_partitions(rows.sparkSession)))
    size = F.transform("v", lambda c: F.abs(c))
    known = table.agg(F.max(F.size("v")).alias("wide"), F.max(F.array_max(size)).alias("top"), F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.when(is_anchor, 1)).alias("n")).first()
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not known.n:
        return rows.sparkSession.createDataFrame([], kinds)
    wide, bound = known.wide, max(known.wide, 1) * int(known.top or 0) ** 2
    if bound >= 1 << 62 or known.last == np.iinfo(np.int64).max:
        raise ValueError("inner products must stay under 2**62, ids under 2**63 - 1")
    kind = np.dtype(np.float64 if bound < 1 << 53 else np.int64)
    ids = (known.first, known.last + 1)
    batches = -(-known.n // batch)
    dealt = written(table.where(is_anchor).repartition(batches).withColumn("batch", F.spark_partition_id())) if batches > 1 else table.where(is_anchor).withColumn("batch", F.lit(0))
    done = []
    for b in range(batches):
        own = dealt.where(F.col("batch") == b).select("id", "label", "v").toArrow().combine_chunks()  # a batch of anchors
        vectors = [matrix(c, wide, kind) for c in own.column("v").chunks]
        if not vectors:
            continue
        anchors = Anchors(own.column("id").to_numpy(), own.column("label").to_numpy(), np.concatenate(vectors), ids[1], kind == np.int64)
        every = np.arange(len(anchors.ids))
        same_label = Windows.of(every, True, np.full(len(every), -bound), np.full(len(every), bound), positives, ids)
        near = select(table, anchors, same_label, positives, ids, digit_bits, few).select("window", "id", "score").toArrow()  # positives of a batch
        score = near.column("score").to_numpy()
        low, high = -(-least * score // 100), most * score // 100
        some = low <= high
        about = {"positive_id": near.column("id").fill_null(ids[1]).to_numpy()[some], "positive_score": score[some]}
        other = Windows.of(near.column("window").to_numpy()[some].astype(np.int64), False, low[some], high[some], negatives, ids, **about)
        found = select(table, anchors, other, negatives, ids, digit_bits, few)
        positive = F.when(F.col("positive_id") <= known.last, F.col("positive_id"))
        done.append(stays(written(found.select("anchor_id", positive.alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))))
    return rows.sparkSession.read.schema(kinds).parquet(*(t._lexigrove_path for t in done))
