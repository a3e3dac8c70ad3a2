"""The pipeline against its parts worked out plainly."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.fixtures import CLASH, documents, frame, words
from tests.llm.test_operators import _components


def _stages(spark, docs, tmp_path):
    """The rows that each stage keeps, every stage reading what the one before wrote."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert docs.columns == before
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
    return out


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    extra = "1 as group_size", "2 as keep_id", "'x' as text_sha256", "3 as taken", "4 as copies", "5 as copy", "6 as row", "7 as mark", "'y' as lang_pred"
    docs = frame(spark).repartition(2).selectExpr("*", *extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = _stages(spark, docs, tmp_path)
    kept = {name: [r.doc_id for r in found] for name, found in rows.items()}
    lettered = [(r[0], r[1]) for r in documents() if r[1] and any(map(str.isalpha, r[1]))]
    assert not Counter(kept["language"]) - Counter(i for i, _ in lettered)
    text = dict(lettered)
    first = {}
    for i in sorted(set(kept["language"])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert sorted(kept["exact"]) == sorted(first.values())
    assert sorted(kept["near"]) == sorted(i for i, x in _components([(i, text[i]) for i in kept["exact"]]).items() if x[2])
    assert set(kept["mix"]) <= set(kept["near"]) and max(Counter(kept["mix"]).values()) <= 3
    assert Counter(r.doc_id for r in rows["pack"] if r.piece == 0) == Counter(kept["mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows["pack"])


def test_stages_of_odd_tables(spark, tmp_path):
    """No rows; rows without an id, a text or anything else."""
    none = frame(spark, [])
    assert all(not rows for rows in _stages(spark, none, tmp_path / "none").values())
    odd = frame(spark, [(None, words(40, 3), None, None, None, *CLASH)] * 2 + [(None, None, None, None, None, *CLASH), (5, words(40, 3), "en", None, 1, *CLASH), (6, words(50, 4), "en", "a", 1, *CLASH), (None, words(50, 5), None, "a", 1, *CLASH)])
    rows = _stages(spark, odd, tmp_path / "odd")
    assert sorted(map(str, (r.doc_id for r in rows["near"]))) == ["5", "6", "None"]


def test_near_stage_takes_away_rows_without_an_id(spark):
    """Of rows without an id only those go that the operator does not keep; texts differ by case only."""
    one, two = words(60, 41), words(60, 42)
    rows = [(1, one), (None, one.upper()), (None, two), (2, one.title()), (None, None)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
