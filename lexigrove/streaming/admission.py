"""Which files of a stream are taken: caps on a day's files and tokens of an owner and on an hour's files of a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where timers and maps of state are kept; the default store of a session has neither.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY, HOUR = 86_400_000, 3_600_000
OUTPUT = "owner string, folder string, path string, ts timestamp, cost bigint, admitted boolean, reason string"


class Windows:
    """The windows of one owner. A window begins with the first event in it and ends its length later; the next begins with the first event after that."""

    def __init__(self, hourly: int, daily: int, tokens: int | None):
        self.hourly, self.daily, self.tokens = hourly, daily, tokens
        self.day: tuple[int, int, int] | None = None  # begin, files, tokens
        self.folders: dict[str, tuple[int, int]] = {}  # begin, files

    def began(self, at: int, length: int) -> None:
        """A window of this length began."""

    def folder(self, name: str, at: int) -> tuple[int, int]:
        """The last window of a folder; files are under 0 where there is none."""
        return self.folders.get(name, (at, -1))

    def refused(self, folder: str, at: int, cost: int) -> str | None:
        """The reason why the next event is refused; None if it is admitted."""
        if self.day is None or at > self.day[0] + DAY:
            self.day = (at, 0, 0)
            self.began(at, DAY)
        if self.day[1] >= self.daily:
            return "daily files"
        if self.tokens is not None and self.day[2] >= self.tokens:
            return "daily tokens"
        begin, files = self.folder(folder, at)
        if files < 0 or at > begin + HOUR:
            begin, files = at, 0
            self.began(at, HOUR)
        if files >= self.hourly:
            self.folders[folder] = (begin, files)
            return "hourly files"
        self.day = (self.day[0], self.day[1] + 1, self.day[2] + cost)
        self.folders[folder] = (begin, files + 1)
        return None


class _Kept(Windows):
    """Windows that go on from a state; ``folders`` has those of this batch."""

    def __init__(self, state: Admission):
        super().__init__(state.hourly, state.daily, state.tokens)
        self.state = state
        self.day = state.day.get() if state.day.exists() else None

    def began(self, at: int, length: int) -> None:
        self.state.handle.registerTimer(at + length + 1)

    def folder(self, name: str, at: int) -> tuple[int, int]:
        if name not in self.folders:
            self.folders[name] = tuple(self.state.folders.getValue((name,))) if self.state.folders.containsKey((name,)) else (at, -1)
        return self.folders[name]


class Admission(StatefulProcessor):
    """The windows of one owner as the state of a stream."""

    def __init__(self, hourly: int, daily: int, tokens: int | None):
        self.hourly, self.daily, self.tokens = hourly, daily, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "begin bigint, files bigint, tokens bigint")
        self.folders = handle.getMapState("folders", "folder string", "begin bigint, files bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "folder", "path"], kind="stable", na_position="first")
        own = _Kept(self)
        times = batch["ts"].astype("datetime64[ms]").astype("int64").tolist()
        reasons = [own.refused(folder, at, int(cost)) for folder, at, cost in zip(batch["folder"], times, batch["cost"].tolist(), strict=True)]
        self.day.update(own.day)
        for folder, window in own.folders.items():
            self.folders.updateValue((folder,), window)
        yield batch[["owner", "folder", "path", "ts", "cost"]].assign(admitted=[r is None for r in reasons], reason=reasons)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.day.exists() and self.day.get()[0] + DAY < now:
            self.day.clear()
        over = [tuple(folder) for folder, own in self.folders.iterator() if own[0] + HOUR < now]
        for folder in over:
            self.folders.removeKey(folder)
        return iter([])


def _in_turn(timed: DataFrame, hourly: int, daily: int, tokens: int | None) -> DataFrame:
    """A table's events, an owner's after each other and in order. What a task holds are the windows of one owner and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, windows = None, None
        for b in batches:
            reasons = []
            times = b.column("ts").cast(pa.int64())  # microseconds
            for one, folder, at, cost in zip(*(x.to_pylist() for x in (b.column("owner"), b.column("folder"), times, b.column("cost"))), strict=True):
                if one != owner:
                    owner, windows = one, Windows(hourly, daily, tokens)
                reasons.append(windows.refused(folder, at // 1000, cost))
            reason = pa.array(reasons, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, reason.is_null(), reason], [*b.schema.names, "admitted", "reason"])

    return timed.withColumn("ts", F.col("ts").cast("timestamp")).repartition("owner").sortWithinPartitions("owner", "ts", "folder", "path").mapInArrow(run, OUTPUT)


def admitted(events: DataFrame, hourly: int, daily: int, tokens: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(owner, folder, path, ts, cost, admitted, reason) for each event of a stream or a table. events: (owner, folder, path, ts, cost).

    An event is refused if its owner's day already has ``daily`` admitted files or their costs have reached ``tokens``
    (so the last one may go beyond it), or if its folder's hour has ``hourly`` admitted files; ``reason`` says which.
    Refused events count for nothing. Events take their turn by time, then folder, then path; null folders, paths and
    costs are read as empty and 0, events without a time are refused ("no time"), and those later than ``late`` are
    dropped by the watermark. A window's state is deleted by a timer when the watermark has passed its end.

    An owner's turns depend on each other, so one task works through what a micro-batch holds of it: as many narrow rows as
    the source's own bound on a trigger (``maxFilesPerTrigger`` and its like) lets in. A table's events come to the same
    windows sorted, and no state is stored.
    """
    spark = events.sparkSession
    if events.isStreaming and spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STORE}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = events.select(text("owner"), text("folder"), text("path"), "ts", F.coalesce(F.col("cost").cast("bigint"), F.lit(0).cast("bigint")).alias("cost"))
    none = rows.where("ts is null").select("*", F.lit(False).alias("admitted"), F.lit("no time").alias("reason"))
    timed = rows.where("ts is not null")
    if not events.isStreaming:
        return _in_turn(timed, hourly, daily, tokens).unionByName(none)
    timed = timed.withWatermark("ts", late).groupBy("owner")
    return timed.transformWithStateInPandas(Admission(hourly, daily, tokens), OUTPUT, "Append", "EventTime").unionByName(none)

