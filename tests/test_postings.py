"""The index by segments: as a fresh build after every change, its vocabulary, and its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import postings
from lexigrove.plans import compiler
from lexigrove.plans import language as q

FIELDS = {"title": "title", "body": "body"}
KIND = "owner string, id bigint, title string, body string"


def docs(ids, seed=0):
    words = [f"{a}{b}{c}" for a in ("al", "be", "ga", "del") for b in ("pha", "ta", "mma", "xi") for c in ("", "s", "é")]
    out = []
    for i in ids:
        r = random.Random(f"{seed} {i}")
        text = lambda n: " ".join(r.choice(words) for _ in range(n))  # noqa: B023, E731
        out.append(("o", i, text(3) if i % 5 else None, text(r.randrange(60))))
    return out


def state(index):
    """All that a query may see of an index."""
    rows = sorted((str(r.id), r.field, r.term, r.n, r.length, tuple(r.places)) for r in index.postings().collect())
    words = sorted((r.field, r.term, r.documents, r.tokens) for r in index.words().collect())
    return rows, words, sorted(str(r.id) for r in index.rows().collect()), index.totals()


def test_segments_are_as_a_fresh_build(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    build = lambda rows, name: postings.build(frame(rows), ("owner", "id"), FIELDS, f"{tmp_path}/{name}")
    first, more, changed = docs(range(60)), docs(range(60, 75)), docs(range(50, 65), seed=1)
    index = build(first, "a").add(frame(more), FIELDS, replace=False)
    assert state(index) == state(build(first + more, "b")) and len(index._live("segment")) == 2
    index = index.add(frame(changed), FIELDS)
    left = [r for r in first + more if not 50 <= r[1] < 65] + changed
    assert state(index) == state(build(left, "c"))
    index = index.delete(frame([r for r in left if r[1] % 7 == 0] + docs([999])))
    left = [r for r in left if r[1] % 7]
    want = state(build(left, "d"))
    assert state(index) == want
    assert index.delete(frame(docs([999]))).state.version == index.state.version  # nothing to delete
    whole = index.merge(every=True)
    assert state(whole) == want and list(a["kind"] for a in whole.state.live.values()) == ["segment"]
    for text in ("alpha", "title:beta OR gamma*", "NOT alpha", "bta~", '"alpha beta"'):
        rows = [{(r.id, round(r.score, 9)) for r in compiler.search(x, text, FIELDS, ("id",)).collect()} for x in (index, whole, frame(left))]
        assert rows[0] == rows[1] == rows[2], text
    assert state(build([], "e")) == ([], [], [], {"title": (0, 0), "body": (0, 0)})
    again = whole.add(frame(docs([0], seed=3)), FIELDS)
    assert state(again) == state(build([r for r in left if r[1] != 0] + docs([0], seed=3), "f"))


def test_segments_of_one_size_are_merged(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    index = postings.build(frame(docs(range(300))), ("owner", "id"), FIELDS, f"{tmp_path}/a")
    for i in range(5):
        index = index.add(frame(docs(range(300 + i, 301 + i))).withColumn("body", F.lit("oddity words of one size")), FIELDS)
    sizes = sorted(a["documents"] for a in index._live("segment").values())
    assert sum(sizes) == 305 and len(sizes) == 3 and sizes[-1] == 300 and 4 in sizes
    assert index.words().where("term = 'oddity' and field = 'body'").first().documents == 5


def test_files_come_change_and_go(spark, tmp_path):
    source = f"{tmp_path}/source"
    put = lambda ids, word: spark.createDataFrame([("o", i, None, f"{word} text") for i in ids], KIND).coalesce(1).write.mode("append").parquet(source)

    def now():
        rows = spark.read.schema(KIND).parquet(source)
        return postings.opened(rows, rows.withColumn("title", F.upper("title")), ("owner", "id"), FIELDS, str(tmp_path))

    put([1, 2], "one")
    index = now()
    assert now().state.version == index.state.version == 1  # nothing new
    put([3], "two")
    index = now()
    files = {p.name: p for p in (tmp_path / "source").glob("*.parquet")}
    assert {a["documents"] for a in index._live("segment").values()} == {1, 2}  # only the new file was read
    first = next(p for p in files.values() if spark.read.parquet(str(p)).count() == 2)
    first.unlink()
    index = now()
    assert [r.id for r in index.rows().collect()] == [3] and index.totals()["body"] == (1, 2)
    assert [r.term for r in index.words().orderBy("term").collect()] == ["text", "two"]
    assert index.path == now().path


def test_patterns_are_looked_up_in_the_vocabulary(spark, tmp_path):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdé") for _ in range(r.randrange(1, 8))) for _ in range(600)})
    rows = [("o", i, None, w) for i, w in enumerate(words)]
    index = postings.build(spark.createDataFrame(rows, KIND), ("owner", "id"), FIELDS, f"{tmp_path}/a").add(spark.createDataFrame([("o", 10_000, "zebra", "quagga")], KIND), FIELDS)
    terms = {r.term for r in index.words().collect()}
    import re

    for pattern in ("ab*", "*ab", "a?c*", "*bcd*", "?b*", "*", "abc", "*c*d*", "q*", "*gga", "zebr?"):
        regex = re.compile("".join({"*": ".*", "?": "."}.get(c, c) for c in pattern))
        found, seen = index.like(pattern, 100_000)
        assert found == sorted(t for t in terms if regex.fullmatch(t)) and len(found) <= seen <= len(terms), pattern
    for term in ("abcd", "a", "bcda", "ddd", "zbera", "quaga"):
        for distance in (0, 1, 2):
            found, _ = index.near(term, distance, 100_000)
            assert {t for t in found if q.osa(term, t, distance) <= distance} == {t for t in terms if q.osa(term, t, distance) <= distance}, (term, distance)
    read = index.with_terms(["zebra"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket=" in read or "PushedFilters" in read


def test_expansion_is_bounded(spark, tmp_path):
    rows = [("o", i, None, " ".join(f"w{50 * i + k}x" for k in range(50))) for i in range(40)]
    plain = spark.createDataFrame(rows, KIND)
    index = postings.build(plain, ("owner", "id"), FIELDS, f"{tmp_path}/a")
    for source in (index, plain):
        with pytest.raises(q.QueryError, match="128"):
            compiler.search(source, "w*", FIELDS, ("id",))
        with pytest.raises(q.QueryError, match="128"):  # the bound is a query's
            compiler.search(source, "w10?x OR w11?x w12* OR w2*", FIELDS, ("id",))
        assert compiler.search(source, "w10*", FIELDS, ("id",)).count() == 4  # w10x, w100x to w109x, w1000x to w1099x
        tight = compiler.Compiler(source, FIELDS, visited=5)
        with pytest.raises(q.QueryError, match="vocabulary"):
            tight.prepare(q.parse("w10*"))
        assert compiler.Compiler(source, FIELDS, expanded=5000).prepare(q.parse("w*")) is None


def test_a_whole_search_goes_beyond_the_bounds(spark, tmp_path):
    rows = [("o", i, "x9 title", " ".join(f"w{50 * i + k}x" for k in range(50))) for i in range(40)]
    plain = spark.createDataFrame(rows, KIND)
    index = postings.build(plain, ("owner", "id"), FIELDS, f"{tmp_path}/a")
    for source in (index, plain):
        ids = lambda text: sorted(r.id for r in compiler.search(source, text, FIELDS, ("id",), whole=True).collect())  # noqa: B023, E731
        assert ids("w*") == list(range(40))
        assert ids("w1*") == sorted({n // 50 for n in range(2000) if str(n).startswith("1")})
        assert ids("w1* NOT w19*") == sorted({n // 50 for n in range(2000) if str(n).startswith("1")} - {n // 50 for n in range(2000) if str(n).startswith("19")})
        assert ids("w*9x AND w3x") == [0]
        assert ids("title:w*") == []


def test_many_queries_over_chunks(spark, tmp_path, monkeypatch):
    """Documents in small chunks and queries in small blocks, with copies that tie, give what all of them at once give."""
    rows = [("o", i, None, f"aa b{i % 4} c{i % 3}" if i % 5 else "aa b1 c1") for i in range(60)] + [("o", 90, None, "zz"), ("o", 91, None, None)]
    index = postings.build(spark.createDataFrame(rows, KIND), ("owner", "id"), FIELDS, f"{tmp_path}/a")
    queries = spark.createDataFrame([(i, t) for i, own in enumerate((("aa",), ("b1", "c1"), ("b2", "aa", "b2"), ("zz", "c0"), ("none",))) for t in own], "query_id int, term string")
    run = lambda: sorted(map(tuple, postings.search_many(index, queries, 7, {"title": 3.0, "body": 1.0}, key="id").collect()))
    whole = run()
    monkeypatch.setattr(postings, "CHUNK", 3)
    monkeypatch.setattr(postings, "ASKED", 2)
    assert run() == whole and [(r[2], r[4]) for r in whole if r[0] == 0] == [(i, i + 1) for i in range(7)]
    assert next(r[2] for r in whole if r[0] == 3 and r[4] == 1) == 90 and {r[0] for r in whole} == {0, 1, 2, 3}


def test_postings_of_many_queries_move_packed():
    """A chunk's postings come in few rows of few bytes each, and a task hands on the best of its chunks alone."""
    import numpy as np
    import pyarrow as pa

    chunks, ranges, n, r = 6, 1, 4, np.random.default_rng(3)
    place = r.integers(-(2**63), 2**63, 300)
    docs = pa.RecordBatch.from_pydict({"place": place, "id": [f"d{i:03}" for i in range(300)]})
    has = r.random((20, 300)) < 0.3
    has[:, :40] = True  # copies, which tie
    row, of = np.nonzero(has)
    counts = np.where(of < 40, 1, r.integers(1, 5, len(of)))
    given = pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.zeros(len(row), np.int8)), pa.array([f"t{i}" for i in row]), pa.array(place[of]), pa.array(counts.astype(np.int32)), pa.array(np.full(len(row), 9, np.int32))], ["row", "field", "term", "place", "n", "length"])
    wants = [[{"term": f"t{t}", "w": [float(t + 1)]} for t in {q, (q * 7) % 20}] for q in range(20)]
    asking = pa.schema([("query_id", pa.int64()), ("wants", pa.list_(pa.struct([("term", pa.string()), ("w", pa.list_(pa.float64()))])))])
    asked = pa.RecordBatch.from_pydict({"block": [0] * 20, "query_id": list(range(20)), "wants": wants}, schema=asking.insert(0, pa.field("block", pa.int32())))
    moved = list(postings._sent_postings(iter([given.slice(0, 1000), given.slice(1000)]), chunks, ranges, 1))
    assert sum(b.num_rows for b in moved) == chunks and sum(len(x.as_py()) for b in moved for x in b.column(3)) < 10 * len(row)
    sent = [*postings._sent_queries(iter([asked]), ranges, 1), *postings._sent_keys(iter([docs]), chunks, ranges, 1), *sorted(moved, key=lambda b: b.column(1)[0].as_py())]
    rows = [x for b in sent for x in b.to_pylist()]
    rows = [pa.RecordBatch.from_pylist([x], schema=sent[0].schema) for x in sorted(rows, key=lambda x: x["chunk"])]
    got = {}
    for b in postings._best(iter(rows), n, asking, docs.schema, ["id"], chunks, [7.0], 1.2, 0.75):
        for x in b.to_pylist():
            got.setdefault(x["query_id"], []).append((round(x["score"], 6), x["id"]))
    gives = np.zeros((20, 300))
    gives[row, of] = (row + 1) * counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * 9 / 7))
    for q in range(20):
        score = gives[[q, *({(q * 7) % 20} - {q})]].sum(axis=0).round(6)
        want = sorted(((-s, f"d{i:03}") for i, s in enumerate(score.tolist()) if s), key=lambda x: x)[:n]
        assert sorted((-s, i) for s, i in got[q]) == want


def test_many_queries_over_segments_and_deletions(spark, tmp_path, monkeypatch):
    """Each query alone gives the same, whether or not the asked terms are broadcast."""
    index = postings.build(spark.createDataFrame(docs(range(30)), KIND), ("owner", "id"), FIELDS, f"{tmp_path}/a")
    index = index.add(spark.createDataFrame(docs(range(20, 50), 1), KIND), FIELDS)
    index = index.delete(spark.createDataFrame([("o", 1), ("o", 25)], "owner string, id bigint"))
    asked = [("alpha", "gata"), ("bexis", "alpha", "delmmae"), ("gaxi",), ("nothing",)]
    queries = spark.createDataFrame([(i, t) for i, own in enumerate(asked) for t in own], "query_id int, term string")
    monkeypatch.setattr(postings, "CHUNK", 7)
    want = {(i, r.owner, r.id, round(r.score, 6)) for i, own in enumerate(asked) for r in compiler.search(index, " OR ".join(own), FIELDS, ("owner", "id")).collect()}
    for most in (postings.MOST_HASHED, 0):
        monkeypatch.setattr(postings, "MOST_HASHED", most)
        got = postings.search_many(index, queries, 100, {"title": 3.0, "body": 1.0}, key="id").collect()
        assert {(r.query_id, r.owner, r.id, r.score) for r in got} == want and len(got) == len(want) > 40


def test_lists_move_and_not_their_postings(spark, tmp_path):
    index = postings.build(spark.createDataFrame(docs(range(200)), KIND), ("owner", "id"), FIELDS, f"{tmp_path}/a")
    files = spark.read.parquet(*(f"{tmp_path}/a/data/{name}/postings" for name in index._live("segment")))
    assert files.count() * 2 < index.postings().count()
    assert [r.n for r in index.postings(["alpha"], ("n",)).select("id", "n").orderBy("id", "n").collect()] == [r.n for r in index.postings(["alpha"]).select("id", "n").orderBy("id", "n").collect()]


def test_a_common_term_is_dealt_to_several_tasks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "PIECE", 80)
    monkeypatch.setattr(postings, "LIST", 30)
    batch = pa.RecordBatch.from_pydict({"id": list(range(70)), "body": ["-"] * 70})
    given = [(i, "often", 2, 9, [1, 4]) for i in range(70)] + [(i, f"t{i}", 1, 9, [3]) for i in range(70)]
    lists = lambda: postings._posted(batch, ("id",), ("body",), 32, [r[0] for r in given], [0] * 140, [r[1] for r in given], [r[2] for r in given], [r[3] for r in given], [r[4] for r in given])
    one = lists()
    assert max(map(len, one.column(4).to_pylist())) == 30 and one.column(2).to_pylist() == list(map(len, one.column(4).to_pylist()))
    tasks, found = set(), []
    for piece in range(8):
        packed = postings._packed(lists(), 8, piece)
        for row in packed.to_pylist():
            own = [x for b in postings._unpacked(iter([pa.RecordBatch.from_pylist([row]).select(["size", "packed"])]), one.schema) for x in b.to_pylist()]
            tasks |= {row["task"] for x in own if x["term"] == "often"}
            found += [(y["id"], x["term"], y["n"], y["length"], y["places"]) for x in own for y in x["lists"]]
    assert len(tasks) > 2 and sorted(found) == sorted(given * 8)
