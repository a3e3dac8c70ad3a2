"""Structured Streaming forms of the watcher, its rate limits, and the incremental pull."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.tables import KeyedTable


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(path, last, n): one row for each burst of events of a path that are less than ``quiet`` apart. events: (ts, path)."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", late).groupBy(w, "path").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).select("path", "last", "n")


def limited(events: DataFrame, most: int, seconds: int, cost: str | None = None, budget: float = float("inf")) -> DataFrame:
    """(key, ts, admitted): at most ``most`` events of a key, and ``budget`` of their ``cost``, in a period that begins with its first event. events: (key, ts)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begin, used, spent = state.get if state.exists else (None, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        admitted = []
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            at = ts.timestamp()
            if begin is None or at - begin >= seconds:
                begin, used, spent = at, 0, 0.0
            admitted.append(used < most and spent + price <= budget)
            used, spent = used + admitted[-1], spent + price * admitted[-1]
        state.update((begin, used, spent))
        yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "admitted": admitted})

    price = F.coalesce(F.col(cost).cast("double"), F.lit(0.0)) if cost else F.lit(0.0)
    return events.select("key", "ts", price.alias("price")).groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, admitted boolean", "begin double, used int, spent double", "append", "NoTimeout")


def unchanged_skipped(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Files of the batch whose path, time or hash differs from what is known; a time that is null on both sides is the same."""
    old = known.select(*(F.col(c).alias(f"_{c}") for c in ("path", "mtime", "hash")))
    return batch.join(old, functools.reduce(lambda a, b: a & b, (batch[c].eqNullSafe(old[f"_{c}"]) for c in ("path", "mtime", "hash"))), "left_anti")


def merged(table: KeyedTable, application: str):
    """For foreachBatch: sets each batch's later rows in a table by key. A batch writes its own rows only, a batch that comes again nothing, and the stream's progress is in the version that holds the rows."""

    def apply(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, applied=(application, epoch))

    return apply


def upsert(path: str, keys: tuple[str, ...], order: tuple[str, ...]):
    """For foreachBatch: keeps the latest row of each key in a small table at path, written whole. A batch that comes again writes nothing. One writer only; ``merged`` is for large tables and several writers."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []
        done = sorted(int(p.getName().removeprefix("v")) for p in found if fs.exists(at(p, "_SUCCESS")))
        rest = [c for c in batch.columns if c not in keys]
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
        if done:
            held = spark.read.parquet(f"{path}/v{done[-1]}")
            same = lambda left, right: functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))
            old = held.select(*keys, F.struct(*order).alias("_old"))
            known = same(rows, old) & (F.struct(*(rows[c] for c in order)) <= old["_old"])
            rows = rows.join(old, known, "left_anti").select(*batch.columns).persist()
            if rows.isEmpty():
                rows.unpersist()
                return
            latest = held.join(rows.select(*keys), same(held, rows), "left_anti").unionByName(rows)
        else:
            latest = rows
        new = done[-1] + 1 if done else 0
        latest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{new}")  # over what a lost attempt left
        rows.unpersist()
        for old_version in done[:-1]:
            fs.delete(at(f"{path}/v{old_version}"), True)

    return apply
