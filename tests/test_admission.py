"""Caps by windows that begin with an event: against a plain loop, over restarts, and what is left of the state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexigrove.streaming import admission as A

SCHEMA = "owner string, folder string, path string, ts timestamp, cost int"
START = datetime.datetime(2024, 1, 1)


def by_hand(rows, hourly, daily, tokens):
    """(owner, path) to the reason of its refusal or None."""
    out, days, hours = {}, {}, {}
    for owner, folder, path, ts, cost in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[1] or "", r[2] or "")):
        if owner not in days or ts - days[owner][0] > datetime.timedelta(days=1):
            days[owner] = [ts, 0, 0]
        day = days[owner]
        if day[1] >= daily:
            out[owner, path] = "daily files"
        elif tokens is not None and day[2] >= tokens:
            out[owner, path] = "daily tokens"
        else:
            if (owner, folder) not in hours or ts - hours[owner, folder][0] > datetime.timedelta(hours=1):
                hours[owner, folder] = [ts, 0]
            hour = hours[owner, folder]
            out[owner, path] = "hourly files" if hour[1] >= hourly else None
            if hour[1] < hourly:
                hour[1] += 1
                day[1] += 1
                day[2] += cost or 0
    return out


def drawn(n, hours, seed):
    r = random.Random(seed)
    seconds = sorted(r.randrange(hours * 3600) for _ in range(n))
    return [(f"o{r.randrange(3)}" if r.random() < 0.5 else "o0", f"f{r.randrange(4)}", f"p{i:05d}", START + datetime.timedelta(seconds=s), r.choice([None, 5, 20, 90])) for i, s in enumerate(seconds)]


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, A.STORE)
    yield spark
    spark.conf.set(key, before)


def test_table_as_by_hand(spark):
    rows = drawn(1200, 100, 1)
    rows += [("edge", "f", f"e{i}", START + datetime.timedelta(seconds=s), 1) for i, s in enumerate((0, 3600, 3601, 86400, 86401))]
    data = spark.createDataFrame(rows, SCHEMA)
    for caps in ((3, 40, None), (2, 1000, 300), (1, 1, 0), (1, 4, None)):
        got = {(r.owner, r.path): r.reason for r in A.admitted(data, *caps).collect()}
        assert got == by_hand(rows, *caps)
    assert len(set(by_hand(rows, 2, 40, 900).values())) == 4


def test_odd_events(spark):
    rows = [(None, None, None, START, None), (None, None, None, START, None), ("o", "f", "p", None, 3)]
    got = A.admitted(spark.createDataFrame(rows, SCHEMA), 1, 9).collect()
    assert sorted((r.owner, r.path, r.cost, r.admitted, r.reason or "") for r in got) == [("", "", 0, False, "hourly files"), ("", "", 0, True, ""), ("o", "p", 3, False, "no time")]
    assert A.admitted(spark.createDataFrame([], SCHEMA), 1, 9).collect() == []


def test_stream_restarts_and_forgets(stateful, tmp_path):
    """Two runs from one checkpoint give what one pass by hand gives, and windows that are over leave no state."""
    spark, rows = stateful, drawn(300, 60, 2)
    rows.append(("late", "f", "last", START + datetime.timedelta(days=9), 1))
    caps = (2, 25, 800)

    def arrive(part, name):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = A.admitted(source, *caps, late="1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    arrive(rows[:150], "a")
    run()
    arrive(rows[150:300], "b")
    run()
    got = {(r.owner, r.path): r.reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == by_hand(rows[:300], *caps) and len(got) == 300
    held = lambda name: {r.key.owner for r in spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/c").select("key").collect()}
    assert "o0" in held("day")
    arrive(rows[300:], "c")
    run()
    assert held("day") <= {"late"} and held("folders") <= {"late"}
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 301


def test_default_store_is_refused(spark, tmp_path):
    spark.createDataFrame([("o", "f", "p", START, 1)], SCHEMA).write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="providerClass"):
        A.admitted(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 1, 1)


def test_query(spark):
    from lexigrove import catalog

    rows = [(str(r.user_id), r.event_type, f"{r.event_id:012d}", r.ts.replace(microsecond=r.ts.microsecond // 1000 * 1000), int(r.value // 1)) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()]
    got = {(str(r.user_id), f"{r.event_id:012d}"): r.reason for r in catalog.queries()["x3_admissions"](spark, "/root/testdata/sf0.001").collect()}
    assert got == by_hand(rows, 1, 3, 40) and len(set(got.values())) >= 2


def test_unchanged_sources_are_skipped(spark):
    from lexigrove.streaming.feeds import unchanged_skipped

    known = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", None, "z")], "path string, mtime int, hash string")
    batch = spark.createDataFrame([("a", 1, "x", 9), ("b", 2, "y", 9), ("c", None, "z", 9), ("d", 1, "w", 9), ("a", 1, "other", 9)], "path string, mtime int, hash string, size int")
    got = unchanged_skipped(batch, known)
    assert got.columns == batch.columns and sorted((r.path, r.hash) for r in got.collect()) == [("a", "other"), ("b", "y"), ("d", "w")]
    assert unchanged_skipped(batch, known.limit(0)).count() == 5
    assert unchanged_skipped(batch.select(F.col("path"), "mtime", "hash"), batch).count() == 0


def test_tables_go_through_the_windows_without_stored_state(spark):
    """Owners that go on over small batches, side by side in a task, as by hand; no store of state is asked for each of them."""
    key, r = "spark.sql.execution.arrow.maxRecordsPerBatch", random.Random(5)
    rows = [(f"o{i % 90}", f"f{r.randrange(3)}", f"p{i:05d}", START + datetime.timedelta(seconds=r.randrange(200_000), milliseconds=r.randrange(1000)), r.choice([None, 7, 30])) for i in range(1500)]
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = A.admitted(spark.createDataFrame(rows, SCHEMA).repartition(5), 1, 6, 70)
        got = {(x.owner, x.path): (x.reason, x.admitted) for x in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {k: (v, v is None) for k, v in by_hand(rows, 1, 6, 70).items()} and len({x for x, _ in got.values()}) == 4
    assert "TransformWithState" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_hour_is_an_hour_when_clocks_go_back(spark):
    """A table's windows follow time and not the clock of the session's zone."""
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "Europe/Berlin")
    try:
        begin = 1729989000  # 2024-10-27 02:30 in summer time; an hour later it is 02:30 again
        rows = spark.createDataFrame([("o", "f", f"p{k}", begin + s, 1) for k, s in enumerate((0, 3600, 3601))], "owner string, folder string, path string, s bigint, cost int")
        got = A.admitted(rows.withColumn("ts", F.timestamp_seconds("s")), 1, 9).select("path", "admitted", F.unix_seconds("ts").alias("s")).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, got)) == [("p0", True, begin), ("p1", False, begin + 3600), ("p2", True, begin + 3601)]
