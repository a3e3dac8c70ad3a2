"""Byte spans of what a query wants: accents, long words, phrases, fields, and what is under NOT."""

import pytest

from lexigrove.operators import evidence as V

FIELDS = {"title": "title", "body": "body"}


@pytest.fixture(scope="module")
def docs(spark):
    long = "x" * 45
    rows = [
        (1, "fox", "Größe der Füchse; über fox über fox."),
        (2, None, f"über {long} fox, fóx-fox"),
        (3, "fox", None),
        (4, "", "was fox"),
        (5, "a", "fox " * 400),
    ]
    return spark.createDataFrame(rows, "id int, title string, body string")


def shown(docs, query, field="body", **more):
    """The texts of the spans."""
    raw = {r.id: (r[FIELDS[field]] or "").encode() for r in docs.collect()}
    out = {}
    for r in V.evidence(docs, query, FIELDS, "id", field, **more).orderBy("id", "start").collect():
        out.setdefault(r.id, []).append(raw[r.id][r.start : r.end].decode())
    return out


def test_evidence(docs):
    assert shown(docs, "fox")[1] == ["fox", "fox"] and shown(docs, "fox")[2] == ["fox", "fóx", "fox"]
    assert shown(docs, '"über fox"') == {1: ["über fox", "über fox"]}
    assert shown(docs, f'"uber {"x" * 45} fox"') == {2: [f"über {'x' * 45} fox"]}  # a long word keeps its place
    assert shown(docs, "groß* NOT fox") == {1: ["Größe"]}
    assert shown(docs, "title:fox OR was") == {4: ["was"]} and shown(docs, "title:fox OR was", "title") == {1: ["fox"], 3: ["fox"]}
    assert shown(docs, "NOT fox") == shown(docs, "*") == {}
    assert len(shown(docs, "fox")[5]) == 256 and shown(docs, "fox", gap=1)[5] == [("fox " * 400).strip()]
    assert shown(docs, "fox w/1 uber", gap=1)[1] == ["über fox über fox"]
    assert shown(docs, "fxo~")[4] == ["fox"]


def test_spans_merge(spark):
    rows = spark.createDataFrame([("a", 0, 3, 0.1), ("a", 2, 9, 0.7), ("a", 4, 5, 0.2), ("a", 10, 12, 0.3), ("b", 0, 1, 0.5), (None, 1, 2, 0.4)], "k string, start int, end int, score double")
    got = sorted((r.k or "", r.start, r.end, r.n, r.score) for r in V.merged_spans(rows, ("k",), score="score").collect())
    assert got == [("", 1, 2, 1, 0.4), ("a", 0, 9, 3, 0.7), ("a", 10, 12, 1, 0.3), ("b", 0, 1, 1, 0.5)]
    assert [(r.start, r.end) for r in V.merged_spans(rows.where("k = 'a'"), ("k",), gap=1).collect()] == [(0, 12)]
