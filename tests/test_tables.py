"""Commit log and tables by key: races, crashes, conditional writes, merges on reading."""

import threading

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import tables as L
from lexigrove.streaming import feeds


def raced(n, run):
    """What n threads that start together return or raise."""
    gate, out = threading.Barrier(n), [None] * n

    def one(k):
        gate.wait()
        try:
            out[k] = run(k)
        except Exception as e:  # noqa: BLE001
            out[k] = e

    threads = [threading.Thread(target=one, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_of_racing_writers_wins(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [spark.range(10).withColumn("writer", F.lit(k)) for k in range(6)]
    got = raced(6, lambda k: L.commit(rows[k], path, expected=0))
    won = [k for k, x in enumerate(got) if x == 1]
    assert len(won) == 1 and sum(isinstance(x, L.Conflict) for x in got) == 5
    assert {(r.writer, r.n) for r in L.snapshot(spark, path).groupBy("writer").agg(F.count("*").alias("n")).collect()} == {(won[0], 10)}
    # Without an expectation all get a version of their own, and appended rows are all there.
    got = raced(4, lambda k: L.commit(rows[k], path, append=True))
    assert sorted(got) == [2, 3, 4, 5] and L.snapshot(spark, path).count() == 50 and L.snapshot(spark, path, 3).count() == 30


def test_names_are_taken_once(spark, tmp_path):
    got = raced(8, lambda k: L.put_new(spark, f"file://{tmp_path}/entry", f"text of {k}"))
    assert got.count(True) == 1 and got.count(False) == 7
    assert (tmp_path / "entry").read_text() == f"text of {got.index(True)}"
    assert [p.name for p in tmp_path.iterdir() if "entry" in p.name] == ["entry"]


def test_a_crash_before_the_entry_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    L.commit(spark.range(3), path)
    log = L.TableLog(spark, path)
    log.write(spark.range(100))  # and no entry
    assert L.snapshot(spark, path).count() == 3 and L.version(spark, path) == 1
    assert log.vacuum(older=-1) == 1 and L.snapshot(spark, path).count() == 3
    L.commit(spark.range(4), path)
    assert log.vacuum(keep=2, older=-1) == 0 and L.snapshot(spark, path, 1).count() == 3
    assert log.vacuum(older=-1) == 1 and L.snapshot(spark, path).count() == 4
    with pytest.raises(ValueError):
        L.snapshot(spark, path, 1)


def test_pages_of_a_changed_table_are_refused(spark, tmp_path):
    log = L.TableLog(spark, f"file://{tmp_path}/t")
    L.commit(spark.range(3), log.path)
    token = log.token("by name")
    log.check(token, "by name")
    with pytest.raises(L.Conflict):
        log.check(token, "by year")
    L.commit(spark.range(3), log.path)
    with pytest.raises(L.Conflict):
        log.check(token, "by name")


KIND = "k string, ts int, v string"


def table(spark, tmp_path, **more):
    return L.KeyedTable(spark, f"file://{tmp_path}/k", ("k",), ("ts",), **{"buckets": 4, **more})


def held(t, version=None):
    return sorted(((r.k or "", r.ts, r.v) for r in t.rows(version).collect()))


def test_rows_by_key(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError):
        t.rows()
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    assert t.upsert(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"))) == 1
    assert held(t) == [("", 1, "n"), ("a", 2, "y"), ("b", 1, "z")]
    assert t.upsert(rows(("a", 2, "same"), ("b", 0, "old"))) == 1  # nothing later, no version
    t.upsert(rows(("a", 3, "new"), ("c", 1, None), (None, 2, "m")))
    assert held(t) == [("", 2, "m"), ("a", 3, "new"), ("b", 1, "z"), ("c", 1, None)] and held(t, 1) == [("", 1, "n"), ("a", 2, "y"), ("b", 1, "z")]
    now = t.log.state().version
    with pytest.raises(L.Conflict):
        t.delete(rows(("a", 0, "")), expected=now - 1)
    assert t.delete(rows(("a", 0, ""), ("none", 0, "")), expected=now) == now + 1
    t.upsert(rows(("a", 3, "too old")))
    assert [k for k, *_ in held(t)] == ["", "b", "c"]
    t.compact(every=True)
    t.upsert(rows(("a", 3, "too old")))  # what was deleted is known after the buckets were written anew
    assert [k for k, *_ in held(t)] == ["", "b", "c"]
    t.upsert(rows(("a", 4, "back")))
    assert held(t)[1] == ("a", 4, "back")
    t.upsert(spark.createDataFrame([("d", 5)], "k string, ts int"))  # a column that the batch lacks is null
    assert held(t)[-1] == ("d", 5, None)
    assert all(about["kind"] == "base" for about in t.log.state(t.compact(every=True)).live.values())
    before = held(t)
    t.log.vacuum(older=-1)
    assert held(t) == before


def test_writers_of_keys_lose_no_row(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    t.upsert(spark.range(40).selectExpr("cast(id as string) k", "0 ts", "'base' v"))
    got = raced(4, lambda k: t.upsert(spark.range(40).where(f"id % 4 <= {k}").selectExpr("cast(id as string) k", f"{k} + 1 ts", f"'w{k}' v")))
    assert not [x for x in got if isinstance(x, Exception)]
    assert held(t) == sorted((str(i), 4, "w3") for i in range(40))


def test_small_batches_write_little(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.upsert(spark.range(40_000).selectExpr("cast(id as string) k", "0 ts", "sha2(cast(id as string), 256) v"))
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    before, batch = size(), spark.range(0, 40_000, 100).selectExpr("cast(id as string) k", "1 ts", "sha2(cast(-id as string), 256) v")
    assert t.upsert(batch, applied=("feed", 1)) == 2
    written = size() - before
    assert written < 0.05 * before  # 1 % of the rows and the files' heads
    assert t.upsert(batch, applied=("feed", 1)) == 2 and size() - before == written
    t.upsert(spark.range(0, 40_000, 2).selectExpr("cast(id as string) k", "2 ts", "sha2(cast(id + 1 as string), 256) v"))
    assert all(about["kind"] == "base" for about in t.log.state().live.values())  # too much was new
    assert t.rows().where("ts = 2").count() == 20_000 and t.rows().count() == 40_000


def test_streams_merge_once(spark, tmp_path):
    t = table(spark, tmp_path)
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], KIND).write.parquet(source)
    spark.createDataFrame([("a", 2, "z")], KIND).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(feeds.merged(t, "in")).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run("c1")
    assert held(t) == [("a", 2, "z"), ("b", 1, "y")]
    at = t.log.state().version
    run("c1")
    run("c2")  # a lost checkpoint: all batches come again
    assert t.log.state().version == at


def test_unchanged_files_are_skipped(spark):
    known = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h")], "path string, mtime int, hash string")
    batch = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 1, "h")], known.schema)
    assert sorted(r.path for r in feeds.unchanged_skipped(batch, known).collect()) == ["b", "c"]
