"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed one- to three-grams of lower-cased characters of whole texts (what is no letter counts as a space).
Document frequencies come from all documents of the training folds. The classifier is trained by
follow-the-regularised-leader with elastic-net penalties on a sample of ``per_language`` rows of each language, as a mean
over draws (hashed ids decide, so reruns agree), and calibrated by a temperature on a fifth of it. Language, source and id
are never inputs of a prediction. The driver holds a few numbers for each distinct language, of which there may be
``most_languages``.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything when no labelled row
is there. Rows with a null language are never trained on. A null id hashes as an empty string. Very long texts are read
whole; equal texts get equal predictions, and repeated rows are trained on once. Other columns pass through, but for
those named like the result's, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm import kernels, linear
from lexigrove.llm.base import text_or_empty

DIMS = 1 << 14
UNKNOWN = "und"
#: Texts whose counts (DIMS numbers each) a task holds at once.
ROWS = 32
_ASCII = np.array([c + 32 if 65 <= c < 91 else c if 97 <= c < 123 else 32 for c in range(128)], np.uint32)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of every text, by size of n-gram."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    plain = c < 128
    c = np.where(plain, _ASCII[np.minimum(c, 127)], c).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    rows, found = [], []
    h = c
    for n in (1, 2, 3):
        if n > 1:
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        same = doc[: len(h)] == doc[n - 1 :]
        f = (kernels.mixed(h * np.uint64(3) + np.uint64(n)) >> np.uint64(50)).astype(np.int64)
        rows.append(doc[: len(h)][same])
        found.append(f[same])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, int), np.empty(0, int))


def counts(texts: list[str]) -> np.ndarray:
    row, f = features(texts)
    return np.bincount(row * DIMS + f, minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for i, j in kernels.slices(texts, 1 << 19):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    for batch in batches:
        for _, _, texts in _text_slices(batch.column(0)):
            total += (counts(texts) > 0).sum(axis=0)
    f = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(total[f])], ["f", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in _text_slices(batch.column(2)):
            c = counts(texts)
            found = [np.flatnonzero(r) for r in c]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([r[f].astype(np.int32) for r, f in zip(c, found, strict=True)], pa.list_(pa.int32())),
                ],
                ["id", "lang", "f", "n"],
            )


@dataclass
class Model:
    """weights: (DIMS, languages), with the inverse document frequencies apart."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = counts([t or "" for t in texts]) * self.idf
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        p = linear._softmax((x.astype(np.float32) @ self.weights.astype(np.float32)).astype(float) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, most_languages: int = 2000, most_rows: int = 60_000) -> Model:
    """Trained on the folds that are not held out, on a sample of ``per_language`` rows a language and ``most_rows`` in all (as means over draws).

    The weights are a table of features times languages, so more than ``most_languages`` of them are an error.
    """
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    df = np.zeros(DIMS)
    for r in texts.select(text_or_empty("text").alias("text")).mapInArrow(kernels.lean(document_frequencies), "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():  # DIMS rows at most
        df[r.f] = r.n
    labelled = texts.where("lang is not null and text is not null")
    held = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(held) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    every = texts.count()
    idf = np.log((1 + every) / (1 + df)) + 1
    if not held:
        return Model([], idf, np.zeros((DIMS, 0)), 1.0)
    languages = sorted(held)
    each = max(1, min(per_language, most_rows // len(held)))
    shares = docs.sparkSession.createDataFrame([(lang, min(each / n, 1.0)) for lang, n in held.items()], "lang string, share double")  # a row a language
    draw = F.xxhash64(F.col("id").cast("string"), F.lit("language sample")).bitwiseAND(F.lit(2**63 - 1))
    chosen = labelled.join(F.broadcast(shares), "lang").where((F.col("share") >= 1) | (draw < (F.col("share") * F.lit(float(2**63))).cast("bigint")))
    chosen = chosen.drop("share").dropDuplicates(["id", "lang", "text"])  # rows that are repeated are drawn together
    rows = chosen.select(F.xxhash64(F.col("id").cast("string")).alias("id"), "lang", "text").mapInArrow(kernels.lean(_sampled), "id bigint, lang string, f array<int>, n array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["lang"], len(r["f"])))
    at = {lang: k for k, lang in enumerate(languages)}
    examples = []
    for r in rows:
        f = np.array(r["f"], np.int64)
        v = np.array(r["n"], float) * idf[f]
        examples.append((f, v / max(float(np.sqrt((v * v).sum())), 1e-12), at[r["lang"]]))
    fit, check = [x for i, x in enumerate(examples) if i % 5], examples[::5]
    weights = linear.ftrl(fit or examples, len(languages), DIMS, epochs=4, alpha=2.0, l1=0.02, l2=0.02)
    scores = linear.logits(check, weights)
    return Model(languages, idf, weights, linear.temperature(scores, np.array([y for _, _, y in check], int)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with pred and score at the end; columns of those names give way."""
    docs = docs.drop(pred, score)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for i, j in kernels.slices(batch.column(at), 1 << 19):
                for a in range(i, j, ROWS):
                    got = model.predict(batch.column(at).slice(a, min(ROWS, j - a)).to_pylist())
                    names += got[0]
                    scores.append(got[1])
            p = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, pred, score])

    kinds = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(kernels.lean(run), kinds)
