"""The quantised index against exact neighbours, and its codes against their definition."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexigrove.operators.ingest import _units
from lexigrove.operators.quantised import STEPS, QuantisedIndex, _codebook, _nearest_codes
from lexigrove.operators.ranking import nearest


def test_recall_of_few_whole_vectors(spark):
    """Vectors of no kind: nine of ten neighbours from a quarter of the vectors, and their scores are exact."""
    r = random.Random(8)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(32)]) for i in range(1500)], "id bigint, vector array<double>").checkpoint()
    some = rows.where("id % 20 = 0")
    index = QuantisedIndex(rows)
    exact = {(x.query_id, x.id): x.score for x in nearest(some, rows, 10).collect()}
    found = {(x.query_id, x.id): x.score for x in index.search_all(some, 10).collect()}
    assert len(found) == 750 and len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[x] == exact[x] for x in exact.keys() & found.keys())
    read = {x.query_id: x["count"] for x in index.shortlist(some, index.candidates(10), index.probes(10)).groupBy("query_id").count().collect()}
    assert len(read) == 75 and max(read.values()) <= 1500 / 4
    assert {(x.query_id, x.id): x.score for x in index.search_all(some, 10, probes=index.lists, candidates=1500).collect()} == exact


def test_shortlist_by_definition(spark):
    """The best by their codes, however blocks and lists divide the rows; ties, repeated vectors and a vector without direction."""
    r = random.Random(9)
    data = [(i, [r.gauss(0, 1) for _ in range(20)]) for i in range(400)] + [(500 + i, [1.0] * 20) for i in range(40)] + [(900, [0.0] * 20)]
    rows = spark.createDataFrame(data, "id bigint, vector array<double>").repartition(3).checkpoint()
    index = QuantisedIndex(rows, lists=5)
    assert [len(c) <= 256 and c.shape[1] for c in index.codebooks] == [8, 8, 4]
    centres = _units(np.array(index.centres))
    scores: dict[int, dict[int, float]] = {}
    kept = {x.id: (x.list, np.array(x.vector)) for x in index.rows.collect()}
    some = rows.where("id % 20 = 0")
    for q in some.collect():
        unit = _units(np.array([q.vector]))[0]
        for k, (own, v) in kept.items():
            rest = _units(v[None])[0] - centres[own]
            coded = np.concatenate([c[np.argmin(((c - rest[8 * p : 8 * p + 8]) ** 2).sum(axis=1))] for p, c in enumerate(index.codebooks)])
            scores.setdefault(q.id, {})[k] = float(unit @ (centres[own] + coded))
    got: dict[int, set[int]] = {}
    for x in index.shortlist(some, 30, index.lists).collect():
        assert x.id not in got.setdefault(x.query_id, set())
        got[x.query_id].add(x.id)
    for q, own in got.items():
        best = sorted((s, k) for k, s in scores[q].items() if k != q)[::-1]
        assert q not in own and len(own) >= 30
        least = min(scores[q][k] for k in own)
        assert least >= best[29][0] - 2.1 / STEPS and all(k in own for s, k in best if s > best[29][0] + 2.1 / STEPS)


def test_codebooks():
    points = np.array([[0.0, 1.0], [0.0, 1.0], [5.0, 5.0]])
    assert _codebook(points, 1).tolist() == [[0.0, 1.0], [5.0, 5.0]]
    drawn = np.random.default_rng(3).normal(size=(3000, 4))
    codes = _codebook(drawn, 1)
    assert codes.shape == (256, 4) and (_codebook(drawn, 1) == codes).all()
    own = _nearest_codes(drawn, codes)
    assert (own == np.argmin(((drawn[:, None] - codes[None]) ** 2).sum(axis=2), axis=1)).all()
    assert ((drawn - codes[own]) ** 2).mean() < 0.35


def test_query(spark):
    from lexigrove import catalog

    exact = {(x.query_id, x.id) for x in catalog.queries()["r3_vector_batch"](spark, "/root/testdata/sf0.01").collect()}
    found = catalog.queries()["r5_quantised_index"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["query_id", "id", "score", "rank"]
    rows = found.select("query_id", "id", F.col("rank")).collect()
    assert len({(x.query_id, x.id) for x in rows} & exact) >= 0.9 * len(exact)


def test_lists_are_sent_in_small_parts(spark, monkeypatch):
    """The order of lists does not depend on how many scores and readings a task holds at once."""
    import random

    from lexigrove.operators import ingest

    r = random.Random(3)
    index = ingest.VectorIndex.__new__(ingest.VectorIndex)
    index.centres = [[r.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)], "id bigint, vector array<double>")
    run = lambda: sorted((x.query_id, x.list, tuple(x.vector)) for x in index._ordered(rows, 0, 5).collect())
    whole = run()
    monkeypatch.setattr(ingest, "CELLS", 20)
    monkeypatch.setattr(ingest, "READINGS", 7)
    assert run() == whole and len(whole) == 250


def test_copies_are_no_more_candidates_than_asked_for(spark):
    """Of many rows that tie, a query's shortlist holds as many as asked for, those with the smallest ids, and the answer is that of all."""
    r = random.Random(4)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(200)] + [(1000 + i, [1.0] * 8 + [0.5] * 8) for i in range(3000)], "id bigint, vector array<double>").repartition(3).checkpoint()
    index = QuantisedIndex(rows, lists=4)
    some = rows.where("id = 20 or id % 1000 = 0 and id > 0")
    got: dict[int, list[int]] = {}
    for x in index.shortlist(some, 30, index.lists).collect():
        got.setdefault(x.query_id, []).append(x.id)
    assert sorted(got) == [20, 1000, 2000, 3000] and all(len(x) == 30 for x in got.values())
    assert index.candidates(10) < 300  # copies are no reason for more
    assert sorted(got[2000]) == list(range(1000, 1030)) and sorted(got[1000]) == list(range(1001, 1031))
    exact = {(x.query_id, x.id, x.score) for x in nearest(some.where("id >= 1000"), rows, 10).collect()}
    assert {(x.query_id, x.id, x.score) for x in index.search_all(some.where("id >= 1000"), 10, index.lists, 30).collect()} == exact


def test_groups_and_parts_change_nothing(spark, monkeypatch):
    """A query has the same candidates whatever group it is in and in however many parts its lists are read; a group's vectors move once for each part."""
    from lexigrove.operators import quantised as Q

    r = random.Random(6)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(900)], "id bigint, vector array<double>").checkpoint()
    index = QuantisedIndex(rows, lists=6)
    some = rows.where("id % 20 = 0")
    run = lambda: sorted((x.query_id, x.id) for x in index.shortlist(some, 25, 3).collect())
    whole, most = run(), index.candidates(5)
    assert len(whole) == 45 * 25
    monkeypatch.setattr(Q, "GROUP", 7)
    monkeypatch.setattr(Q, "CELLS", 20)
    monkeypatch.setattr(Q, "TASKS", 0)
    index._candidates.clear()
    groups = index._groups(some, 3).collect()
    assert len(groups) >= 7 and sum(len(g.q_ids) // 8 for g in groups) == 45 and max(len(g.q_ids) // 8 for g in groups) == 7
    assert run() == whole and index.candidates(5) == most


def test_best_of_blocks(monkeypatch):
    """Dropping candidates on the way loses none of the best."""
    from lexigrove.operators import quantised as Q

    monkeypatch.setattr(Q, "SPARE", 0)
    rng = np.random.default_rng(2)
    held, every = Q._Best(np.arange(50, 54), 5), {x: [] for x in range(4)}
    for block in range(40):
        own, ids = np.flatnonzero(rng.random(4) < 0.7), rng.permutation(1000)[:17] * 40 + block
        s = rng.integers(0, 60, (len(own), 17)) + rng.random((len(own), 17))
        for i, x in enumerate(own):
            every[x] += [(-int(s[i, j]), int(ids[j])) for j in range(17)]
        held.add(own, ids, s)
    got = sorted(zip(*(held.done()[c].tolist() for c in ("query_id", "step", "id")), strict=True))
    assert got == sorted((50 + x, -s, k) for x in every for s, k in sorted(every[x])[:5])
