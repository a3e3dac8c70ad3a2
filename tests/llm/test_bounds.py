"""Bounds and edges: ranges by bytes, samples, ties, repeated rows, very long texts, empty tables, clashing names."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import linear
from tests.llm.fixtures import CLASH, SCHEMA, documents, frame


def test_ranges_follow_bytes(spark, monkeypatch):
    """Many small ranges, rows without an id and rows of one id give what one range gives."""
    from lexigrove.llm import fingerprints

    rows = documents() + [(None, f"no id {i}", None, None, 0, *CLASH) for i in range(9)] + [(50, "x", None, None, 1, *CLASH)] * 3
    docs = frame(spark, rows).repartition(3)
    whole = collections.Counter(map(tuple, fingerprints.neighbours(docs).collect()))
    order = sorted(((r[0] if r[0] is not None else -math.inf, (r[1] or "").encode()) for r in rows), key=lambda r: (-r[0], r[1]))
    want = collections.Counter()
    for n, (i, raw) in enumerate(order):
        text, after = raw.decode(), order[(n + 1) % len(order)][1].decode()
        half = len(text) // 2
        want[None if i == -math.inf else i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    short = collections.Counter()
    for r, n in whole.items():
        short[r[:3]] += n
    assert short == want
    monkeypatch.setattr(fingerprints, "RANGE", 500)
    ids = docs.select(F.coalesce("doc_id", F.lit(fingerprints.NO_ID)).alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    edges = fingerprints.range_edges(ids, 1)
    assert len(edges) > 40
    held = collections.Counter()
    for r in ids.collect():
        held[int(np.searchsorted(edges, r.id, "left"))] += r.size
    largest = max(len((r[1] or "").encode()) for r in rows)
    assert max(held.values()) < largest + 3000
    assert collections.Counter(map(tuple, fingerprints.neighbours(docs).collect())) == whole


def test_binary_steps_against_their_definition():
    """A batch of one row is a step of the textbook, coordinate by coordinate."""
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 12, 5)) for _ in range(30)]
    y = r.integers(0, 2, 30).astype(float)
    weight = r.random(12)
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.3
    z, n = [0.0] * 12, [0.0] * 12

    def w(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for k in order.permutation(30):
            p = 1 / (1 + math.exp(-sum(w(i) * weight[i] for i in rows[k])))
            step = {i: (p - y[k]) * weight[i] for i in rows[k]}
            old = {i: w(i) for i in rows[k]}
            for i, g in step.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * old[i]
                n[i] += g * g
    got = linear.binary(linear.Rows.of(rows, weight), y, 12, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, batch=1)
    assert np.allclose(got, [w(i) for i in range(12)])
    assert np.allclose(linear.Rows.of(rows, weight).marks(got), [sum(got[i] * weight[i] for i in x) for x in rows])


def quality_rows(n=160):
    rows = [(i, ("good plain words of a text " if i % 2 else "WIN $$$ NOW !!! ") * (3 + i % 4), "en" if i % 3 else None, "s", 50, *CLASH) for i in range(n)]
    return rows, [(i, i % 2, 0) for i in range(0, n // 2)]


def test_sure_rows_come_from_all_documents(spark):
    """Against scoring every document by itself: all that are sure and unlabelled, in their groups, or a draw of them."""
    from lexigrove.llm import quality

    rows, marks = quality_rows()
    docs = frame(spark, [*rows, (None, "no id", None, None, 5, *CLASH)]).repartition(3).select(F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("bigint"), "source", "lang")
    labels = spark.createDataFrame(marks, "id bigint, quality int, toxic int")
    weight, targets = quality.train(docs, labels)
    sure = quality.Sure(targets, weight, 0.9)
    views = quality.Views()
    import pyarrow as pa

    want = set()
    for r in rows:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([r[4]]), pa.array([r[3]]), pa.array([r[2]], pa.string())], ["id", "text", "n_chars", "source", "lang"])
        for _, _, row, f, meta in views.both(batch):
            want |= {(r[0], int(g)) for g in np.flatnonzero(sure.groups(1, row, f, meta)[0])}
    labelled = {i for i, _, _ in marks}
    got = quality.pseudo_labelled(docs, labels, sure, 10_000, 0.5, 0)
    assert {(r["id"], r["grp"]) for r in got} == {x for x in want if x[0] not in labelled} and len({g for _, g in want}) >= 3
    few = quality.pseudo_labelled(docs, labels, sure, 5, 0.5, 0)
    assert {(r["id"], r["grp"]) for r in few} <= {x for x in want if x[0] not in labelled}
    assert max(collections.Counter(r["grp"] for r in few).values()) <= 10
    assert few == quality.pseudo_labelled(docs.repartition(5), labels, sure, 5, 0.5, 0)


def test_quality_of_odd_rows(spark):
    """Repeated and contradicting labels, equal pages, very long texts, ids without documents."""
    from lexigrove.llm import quality

    rows, marks = quality_rows()
    rows += [(1000, "good plain words of a text " * 20_000, "en", "s", 50, *CLASH), *[(1001, "twice", None, None, 5, *CLASH)] * 2]
    labels = spark.createDataFrame([*marks, *marks[:9], (1, 0, None), (None, 1, 0), (7777, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.score, r.toxic_score, r.kept))
    assert len(got) == len(rows) and len(by_id[1001]) == 2 and len(set(by_id[1001])) == 1
    assert sum((by_id[i][0][0] >= 0.5) == bool(i % 2) for i in range(160)) >= 155 and by_id[1000][0][0] >= 0.5
    assert by_id[1] == by_id[13]  # equal pages


def test_language_sample_is_bounded_as_a_whole(spark):
    from lexigrove.llm import language_id

    texts = {"xx": "ção inho lha ", "yy": "the though ing ", "zz": "sch ung öß "}
    rows = [(i, texts[lang] * (2 + i % 5), lang, None, 5, *CLASH) for i, lang in enumerate(list(texts) * 80)]
    rows += [rows[0]] * 30 + [(5000, texts["yy"] * 40_000, None, None, 1, *CLASH), (5001, texts["zz"] + "\x00" + texts["zz"], None, None, 1, *CLASH)]
    docs = frame(spark, rows).repartition(3)
    model = language_id.train(docs, most_rows=30)
    assert model.languages == sorted(texts)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got[5000] == "yy" and got[5001] == "zz" and sum(got[i] == rows[i][2] for i in range(240)) >= 235
    with pytest.raises(ValueError):
        language_id.train(docs, most_languages=2)


def test_ties_of_finish_times(spark):
    """Equal sizes and weights tie again and again; reruns and other partitions agree, and no source goes over."""
    from lexigrove.llm.source_mix import mix

    rows = [(i % 40, "one two", None, "ab"[i % 2], 7, *CLASH) for i in range(80)]
    runs = [sorted(map(tuple, mix(frame(spark, rows).repartition(n), weights=(1, 1)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and sum(r[4] for r in runs[0]) <= 160 and len(runs[0]) == 80


def test_chats_of_odd_tables(spark):
    """No row, names that clash, one very long turn, repeated turns."""
    from lexigrove.llm.chat_format import format_chats

    kinds = "conv_id bigint, turn bigint, role string, text string, turns string, formatted string"
    assert format_chats(spark.createDataFrame([], kinds)).count() == 0
    long = "<|im_end|> word " * 50_000
    rows = [(1, 0, "user", long, "x", "y"), (1, 1, "assistant", "ok", "x", "y"), (2, 0, "user", "same", "x", "y"), (2, 0, "user", "same", "x", "y")]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, kinds)).collect()}
    assert [t["text"] for t in got[1].turns] == [long, "ok"] and len(got[2].turns) == 2 and SCHEMA
