"""Ingest with tags, chunks and vectors in one version."""

import pytest

from lexigrove.operators.library import Library
from lexigrove.operators.tables import Conflict

KIND = "owner string, id int, rev int, text string, tags array<string>, more string"


def test_a_document_is_replaced_whole(spark, tmp_path):
    embed = lambda texts: texts.map(lambda t: [float(len(t)), 1.0])
    held = Library(spark, f"file://{tmp_path}/lib", ("owner", "id"), ("rev",), size=3, shared=1, embed=embed, buckets=4)
    first = spark.createDataFrame([("o", 1, 1, "one two three four", ["b", "a", "b", " ", None], "x"), ("o", 2, 1, "é", None, None), ("o", 3, 1, "  ", ["t"], None), (None, 4, 1, "no owner", ["n"], None), ("o", 1, 0, "older", ["old"], None)], KIND)
    at = held.ingest(first, applied=("a", 0))
    assert at == held.ingest(first, applied=("a", 0)) == held.ingest(first) == 1
    chunks = sorted((r.id, r.chunk_index, r.chunk, list(r.vector)) for r in held.chunks().collect())
    assert chunks == [(1, 0, "one two three", [13.0, 1.0]), (1, 1, "three four", [10.0, 1.0]), (2, 0, "é", [1.0, 1.0]), (4, 0, "no owner", [8.0, 1.0])]
    assert sorted((r.id, r.tag) for r in held.tags().collect()) == [(1, "a"), (1, "b"), (4, "n")]
    held.ingest(spark.createDataFrame([("o", 1, 2, "new", ["z"], "y"), ("o", 2, 0, "too old", [], None)], KIND))
    assert sorted((r.id, r.chunk) for r in held.chunks().collect()) == [(1, "new"), (2, "é"), (4, "no owner")]
    assert [r.tag for r in held.tags().where("id = 1").collect()] == ["z"] and held.documents().where("id = 1").first().more == "y"
    assert held.chunks(1).count() == 4  # the version before is as it was
    with pytest.raises(Conflict):
        held.delete(first.where("id = 1"), expected=1)
    held.delete(first.where("id = 4"))
    assert sorted(r.id for r in held.documents().collect()) == [1, 2]


def test_without_a_model(spark, tmp_path):
    held = Library(spark, f"file://{tmp_path}/lib", ("id",), ("rev",), buckets=2)
    held.ingest(spark.createDataFrame([(1, 1, "some words")], "id int, rev int, text string"))
    assert [(r.chunk, r.vector) for r in held.chunks().collect()] == [("some words", None)] and held.tags().count() == 0


def test_texts_move_once_to_find_the_last_rows(spark, tmp_path):
    held = Library(spark, f"file://{tmp_path}/lib", ("id",), ("rev",), buckets=2, embed=lambda texts: texts.map(lambda t: [1.0]))
    rows = spark.createDataFrame([(1, 1, "some words"), (2, 1, "\n"), (None, 1, "no id")], "id int, rev int, text string")
    plan = held._with_chunks(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    held.ingest(rows)
    assert {r.id: r.chunks and [c.chunk for c in r.chunks] for r in held.documents().collect()} == {1: ["some words"], 2: None, None: ["no id"]}
