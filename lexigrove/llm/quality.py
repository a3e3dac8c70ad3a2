"""Quality classification by co-training.

Two views of a page: its words and runs of marks (text), and what is known of it as a page (metadata: source, language,
length, and rates of capitals, digits, marks, distinct words and repeated lines). For each of two targets, good
quality and toxic, a classifier of each view is trained on labelled rows. Over some rounds both score all documents, and
each gives pseudo-labels of documents without labels that it is sure of to the other. Both are then calibrated on rows kept apart, and their log odds, less
the prior that both contain, are added up to score every document.

What a classifier is fitted on is bounded: about ``per_label`` rows of each pair of labels, and in each round
``per_round`` rows of each pseudo-label, drawn from all that are sure (hashed ids decide). Document frequencies, the
search for sure rows and scores cover all documents.

Defined results: null texts are empty; a document without usable labels gives scores of the prior; labels that are
null do not count; of several labels of one id, every different one counts; null ids are scored like others. An empty
table gives no rows; without labels every score is the prior's. Very long texts are read whole; equal pages get equal
scores. Only the id, text, n_chars, source and lang of documents are read, and the id, quality and toxic of labels.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm import kernels, linear
from lexigrove.llm.base import drawn, text_or_empty
from lexigrove.llm.fingerprints import TERM

DIMS = 1 << 16
#: Metadata: rates and logarithms, in bins, then hashed source and language.
RATES, BINS, HASHED = 9, 12, 64
META = RATES * BINS + 2 * HASHED + 1
#: Where a row has the features of each view, and how many there are.
VIEWS = {"text": ("f", DIMS), "meta": ("m", META)}
TARGETS = ("quality", "toxic")
_MARKS = bytes(b for b in range(33, 128) if b not in TERM)
_KIND = np.array([1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in b"\n" else 4 if b in _MARKS else 5 if b in b" \t" else 0 for b in range(256)], np.uint8)


class Views:
    """Both views of the texts of a slice."""

    def __init__(self):
        self.words = kernels.WordHasher(word=TERM)
        self.marks = kernels.WordHasher(word=_MARKS)
        self.lines = kernels.WordHasher(blank=b"\n")

    def text(self, raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature) of distinct features, words in each row, distinct words in each row."""
        h, d = self.words.words(raw, at)
        m, e = self.marks.words(raw, at)
        both = np.concatenate([d * DIMS + (h >> np.uint64(48)).astype(np.int64), e * DIMS + (kernels.mixed(m) >> np.uint64(48)).astype(np.int64)])
        both = np.unique(both)
        return both // DIMS, both % DIMS, np.bincount(d, minlength=n), np.bincount(both // DIMS, minlength=n)

    def meta(self, raw: np.ndarray, at: np.ndarray, words: np.ndarray, distinct: np.ndarray, chars: list, sources: list, langs: list) -> np.ndarray:
        """META features that are 1, RATES + 3 for each row."""
        n = len(at) - 1
        size = np.maximum(np.diff(at), 1)
        row = np.repeat(np.arange(n), np.diff(at))
        kinds = np.bincount(row * 6 + _KIND[raw], minlength=n * 6).reshape(n, 6)
        h, d = self.lines.words(raw, at)
        lines = np.bincount(d, minlength=n)
        new = np.bincount(np.unique(d.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)).astype(np.int64) >> 40, minlength=n)
        known = np.array([size[i] if c is None else max(int(c), 0) for i, c in enumerate(chars)], float)
        rates = np.stack(
            [
                np.log1p(known) / 12,
                kinds[:, 1] / size,
                kinds[:, 2] / size,
                kinds[:, 4] / size * 2,
                kinds[:, 5] / size * 2,
                distinct / np.maximum(words, 1),
                words * 4 / size,
                1 - new / np.maximum(lines, 1),
                np.log1p(size / np.maximum(lines, 1)) / 10,
            ],
            axis=1,
        )
        bins = np.minimum((np.clip(rates, 0, 1) * BINS).astype(np.int64), BINS - 1) + np.arange(RATES) * BINS
        base = RATES * BINS
        named = np.array([[base + zlib.crc32(str(s).encode()) % HASHED, base + HASHED + zlib.crc32(str(x).encode()) % HASHED, META - 1] for s, x in zip(sources, langs, strict=True)], np.int64).reshape(n, 3)
        return np.concatenate([bins, named], axis=1)

    def both(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Over (…, text, n_chars, source, lang) as the last columns: (first, end, rows, text features, metadata features)."""
        texts, chars, sources, langs = batch.columns[-4:]
        for i, j in kernels.slices(texts):
            raw, at = kernels.bytes_of(texts.slice(i, j - i))
            row, f, words, distinct = self.text(raw, at, j - i)
            yield i, j, row, f, self.meta(raw, at, words, distinct, *(c.slice(i, j - i).to_pylist() for c in (chars, sources, langs)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views, total = Views(), np.zeros(DIMS, np.int64)
    for batch in batches:
        texts = batch.column(0)
        for i, j in kernels.slices(texts):
            total += np.bincount(views.text(*kernels.bytes_of(texts.slice(i, j - i)), j - i)[1], minlength=DIMS)
    f = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(total[f])], ["f", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views = Views()
    for batch in batches:
        for i, j, row, f, meta in views.both(batch):
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array([f[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32())), pa.array(list(meta.astype(np.int32)), pa.list_(pa.int32()))],
                ["id", "quality", "toxic", "f", "m"],
            )


@dataclass
class Target:
    """Weights of both views, their calibrations, and the log odds of the prior."""

    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * text + b + c * meta + d - self.prior, -30, 30)))


def hash_of(number: int) -> int:
    return (number * kernels.R) & (2**64 - 1)


class CoTraining:
    """One target: the rows that each view is fitted on, and the two views."""

    def __init__(self, rows: list[dict], label: str, weight: np.ndarray):
        known = [r for r in rows if r[label] is not None]
        self.weight, self.label = weight, label
        y = np.array([int(r[label] > 0) for r in known])
        draw = kernels.mixed(np.array([hash_of(r["id"]) for r in known], np.uint64)) % np.uint64(5) == 0
        apart, fit = np.flatnonzero(draw), np.flatnonzero(~draw)
        if len(set(y[apart].tolist())) < 2:  # too few labels to keep some of both apart
            apart = fit = np.arange(len(known))
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.apart, self.apart_y = [known[i] for i in apart], y[apart]
        self.own = {view: {(known[i]["id"], k): (known[i], int(y[i])) for k, i in enumerate(fit)} for view in VIEWS}  # labels that differ all count

    def _rows(self, view: str, rows: list[dict]) -> linear.Rows:
        return linear.Rows.of([np.array(r[VIEWS[view][0]], np.int64) for r in rows], self.weight if view == "text" else None)

    def fit(self) -> Target:
        w, calibration = {}, []
        for view, (_, dims) in VIEWS.items():
            rows = [self.own[view][i] for i in sorted(self.own[view])]
            y = np.array([c for _, c in rows], float)
            w[view] = linear.binary(self._rows(view, [r for r, _ in rows]), y, dims, l1=0.1 * len(rows) ** 0.5)
            calibration.append(linear.platt(self._rows(view, self.apart).marks(w[view]), self.apart_y))
        return Target(w["text"], w["meta"], tuple(calibration), self.prior)

    def learn(self, view: str, row: dict, label: int) -> None:
        """A row that the other view is sure of."""
        self.own[view].setdefault((row["id"], -1), (row, label))


class Sure:
    """Which rows each view is sure of; a group is (target, view, label)."""

    def __init__(self, targets: dict[str, Target], weight: np.ndarray, confident: float):
        self.targets, self.confident = targets, confident
        self.by_text = {t: weight * targets[t].text for t in targets}

    def groups(self, n: int, row: np.ndarray, f: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(rows, groups) of bool."""
        out = np.zeros((n, 4 * len(self.targets)), bool)
        for k, (name, t) in enumerate(self.targets.items()):
            for v, marks in enumerate((np.bincount(row, weights=self.by_text[name][f], minlength=n), t.meta[meta].sum(axis=1))):
                a, b = t.calibration[v]
                p = 1 / (1 + np.exp(-np.clip(a * marks + b, -30, 30)))
                out[:, 4 * k + 2 * v], out[:, 4 * k + 2 * v + 1] = 1 - p >= self.confident, p >= self.confident
        return out

    def least(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """(group, draw): the smallest draws of each group, over all rows of the task."""
        views, held = Views(), [np.empty(0, np.int64) for _ in range(4 * len(self.targets))]
        for batch in batches:
            draw = batch.column(1).to_numpy()
            for i, j, row, f, meta in views.both(batch):
                for g, sure in enumerate(self.groups(j - i, row, f, meta).T):
                    held[g] = np.sort(np.concatenate([held[g], draw[i:j][sure]]))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]).astype(np.int32)), pa.array(np.concatenate(held))], ["grp", "draw"])

    def chosen(self, batches: Iterator[pa.RecordBatch], upto: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(id, group, features) of the rows with a group's draws up to a bound."""
        views = Views()
        for batch in batches:
            draw = batch.column(1).to_numpy()
            for i, j, row, f, meta in views.both(batch):
                r, g = np.nonzero(self.groups(j - i, row, f, meta) & (draw[i:j, None] <= upto))
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                cols = [batch.column(0).slice(i, j - i).take(pa.array(r)), pa.array(g.astype(np.int32)), pa.array([f[cuts[k] : cuts[k + 1]].astype(np.int32) for k in r], pa.list_(pa.int32())), pa.array(list(meta[r].astype(np.int32)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "grp", "f", "m"])


def pseudo_labelled(docs: DataFrame, labels: DataFrame, sure: Sure, most: int, unlabelled: float, step: int) -> list[dict]:
    """Rows without labels that a view is sure of: all rows are scored, and of each group's about ``most`` come back, drawn by the hash of their ids."""
    draw = F.xxhash64("id", F.lit(f"co-training {step}")).alias("draw")
    rows = docs.where("id is not null").select("id", draw, "text", "n_chars", "source", "lang")
    k = math.ceil(most / max(unlabelled, 0.05))  # some of them have labels
    least = rows.mapInArrow(kernels.lean(lambda x: sure.least(x, k)), "grp int, draw bigint")
    place = F.row_number().over(Window.partitionBy("grp").orderBy("draw"))
    top = least.withColumn("place", place).where(F.col("place") <= k).groupBy("grp").agg(F.max("draw").alias("draw")).collect()  # a row a group
    if not top:
        return []
    upto = np.full(4 * len(sure.targets), np.iinfo(np.int64).min)
    for r in top:
        upto[r.grp] = r.draw
    found = rows.where(F.col("draw") <= int(upto.max())).mapInArrow(kernels.lean(lambda x: sure.chosen(x, upto)), "id bigint, grp int, f array<int>, m array<int>").toArrow().to_pylist()
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({r["id"] for r in found})], "id bigint")  # k a group at most
    labelled = {r.id for r in labels.select("id").join(F.broadcast(ids), "id").distinct().collect()}
    return sorted((r for r in found if r["id"] not in labelled), key=lambda r: (r["id"], r["grp"], len(r["f"])))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, per_round: int = 250, rounds: int = 3, confident: float = 0.97) -> tuple[np.ndarray, dict[str, Target]]:
    """The features' weights (inverse document frequency) and a Target for quality and toxic. docs: id, text, n_chars, source, lang.

    The views are fitted on at most about ``per_label`` rows of each pair of labels, and ``per_round`` pseudo-labelled ones
    of each class in each round. Every round scores all documents for them.
    """
    df = np.zeros(DIMS)
    for r in docs.select("text").mapInArrow(kernels.lean(_frequencies), "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():  # DIMS rows at most
        df[r.f] = r.n
    every = docs.count()
    weight = np.log((1 + every) / (1 + df)) + 1
    weight = weight / weight.max() if len(weight) else weight
    held = {(r.quality, r.toxic): r.n for r in labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # pairs of 0, 1 and null
    wanted = F.lit(False)
    for (q, t), n in held.items():
        wanted = wanted | (F.col("quality").eqNullSafe(F.lit(q)) & F.col("toxic").eqNullSafe(F.lit(t)) & drawn(per_label / n, "id", F.lit("quality sample")))
    sample = labels.where(wanted & F.col("id").isNotNull()).select("id", F.col("quality").cast("int"), F.col("toxic").cast("int")).distinct()
    rows = docs.join(F.broadcast(sample), "id").select("id", "quality", "toxic", "text", "n_chars", "source", "lang")  # bounded by per_label
    found = rows.mapInArrow(kernels.lean(_examples), "id bigint, quality int, toxic int, f array<int>, m array<int>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], str(r["quality"]), str(r["toxic"]), len(r["f"])))
    training = {name: CoTraining(found, name, weight) for name in TARGETS}
    unlabelled = 1 - sum(held.values()) / max(every, 1)
    for step in range(rounds + 1):
        targets = {name: t.fit() for name, t in training.items()}
        if step == rounds or not found:
            break
        for r in pseudo_labelled(docs, labels, Sure(targets, weight, confident), per_round, unlabelled, step):
            name, view, label = TARGETS[r["grp"] // 4], r["grp"] // 2 % 2, r["grp"] % 2
            training[name].learn(("meta", "text")[view], r, label)
    for at, name in enumerate(TARGETS):
        # The sample evens out the labels; scores are calibrated to how often they are given.
        up = sum(n for pair, n in held.items() if pair[at])
        down = sum(n for pair, n in held.items() if pair[at] is not None and not pair[at])
        targets[name].prior -= float(np.log((up + 1) / (down + 1))) - targets[name].prior
    return weight, targets


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, score: of good quality, toxic_score, kept: good and not toxic), a row for each row of docs."""
    have = set(docs.columns)
    pages = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        text_or_empty("text").alias("text"),
        *((F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in (("n_chars", "bigint"), ("source", "string"), ("lang", "string"))),
    )
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:  # few files or row groups would leave most cores idle
        pages = pages.repartition(cores)
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), "quality", "toxic")
    weight, targets = train(pages, marks, **options)
    quality, toxic = targets["quality"], targets["toxic"]
    by_text = {t: weight * targets[t].text for t in targets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for batch in batches:
            for i, j, row, f, meta in views.both(batch):
                p = [t.score(np.bincount(row, weights=w[f], minlength=j - i), t.meta[meta].sum(axis=1)) for t, w in ((quality, by_text["quality"]), (toxic, by_text["toxic"]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p[0]), pa.array(p[1]), pa.array((p[0] >= 0.5) & (p[1] < 0.5))], ["id", "score", "toxic_score", "kept"])

    return pages.mapInArrow(kernels.lean(run), "id bigint, score double, toxic_score double, kept boolean").withColumnRenamed("id", id_col)
