"""Tables with a commit log: atomic versions, conditional writes, and rows by key that are merged when they are read.

A version is a numbered log entry, and an entry is made by one step that fails if the number is taken, so of writers that
race for a number one wins. Data lie under names of their own and belong to the table once an entry names them; what a
lost attempt or a loser wrote is never read. An entry names all live data, so a reader resolves one entry and keeps
reading that version, whatever is written meanwhile.

On a local file system the step is a hard link, elsewhere a rename that refuses an existing target, as HDFS does. A store
that can do neither needs a log folder on one that can.

``KeyedTable`` keeps one row a key. Keys are dealt to hash buckets. A write adds the batch's newer rows only (a delta), a
read sets them over the base, and a bucket is written anew when its deltas have grown to a share of it. Writers retry on
top of the winner: as they are where it wrote other buckets, from the winner's rows where it wrote the same ones.

The number of buckets is the table's for good and should leave a bucket some gigabytes at most; a larger one is written
and read by several tasks, and only what is written anew together grows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(ValueError):
    """Another writer was first, or the table is not at the version that was expected."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def put_new(spark: SparkSession, name: str, text: str) -> bool:
    """Makes a file with all of its text in one step; False if there is one of that name."""
    jvm, fs = spark._jvm, _files(spark, name)
    target = fs.makeQualified(_path(spark, name))
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(target.toUri()), jvm.java.nio.file.Paths.get(draft.toUri()))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


@dataclass
class State:
    """One version: what data live, what applications have written, and what the entry tells."""

    version: int = 0
    #: Folders of data: kind (base or delta), the version that added it, and its buckets with their bytes.
    live: dict[str, dict] = field(default_factory=dict)
    #: The last sequence number of each application, which makes its writes repeatable.
    applied: dict[str, int] = field(default_factory=dict)
    schema: str = ""
    buckets: int = 0
    #: The buckets that this version wrote, None for all.
    wrote: list[int] | None = None
    #: What a table keeps besides.
    about: dict = field(default_factory=dict)
    at: float = 0.0

    def kind(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class TableLog:
    """The numbered entries of a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        fs, log = _files(self.spark, self.path), _path(self.spark, f"{self.path}/log")
        if not fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:20]) for s in fs.listStatus(log) if re.fullmatch(r"\d{20}\.json", s.getPath().getName()))

    def state(self, version: int | None = None) -> State:
        """A version, the current one by default. Version 0 is the table that nobody has written."""
        if version is None:
            version = max(self.numbers(), default=0)
        if version == 0:
            return State()
        name = f"{self.path}/log/{version:020d}.json"
        fs = _files(self.spark, name)
        if not fs.exists(_path(self.spark, name)):
            raise ValueError(f"there is no version {version}")
        stream = fs.open(_path(self.spark, name))
        try:
            return State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def put(self, state: State) -> bool:
        """Makes the entry of state.version; False if another writer has made it."""
        state.at = time.time()
        return put_new(self.spark, f"{self.path}/log/{state.version:020d}.json", json.dumps(state.__dict__))

    def write(self, rows: DataFrame, *partition_by: str) -> str:
        """Data under a name of its own, which no version holds yet."""
        name = uuid.uuid4().hex
        out = rows.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.path}/data/{name}")
        return name

    def discard(self, name: str) -> None:
        _files(self.spark, self.path).delete(_path(self.spark, f"{self.path}/data/{name}"), True)

    def token(self, scope: str = "") -> str:
        """Names the current version and what is asked of it; pages of one listing carry it."""
        return hashlib.sha256(json.dumps([self.path, self.state().version, scope]).encode()).hexdigest()

    def check(self, token: str, scope: str = "") -> None:
        if token != self.token(scope):
            raise Conflict("the table has changed since the listing began, or the page is of another one")

    def vacuum(self, keep: int = 1, older: float = 86_400.0) -> int:
        """Deletes the entries of all versions but the last ``keep``, and data that no other one names and that are older than ``older`` seconds. Returns how many folders went."""
        fs, numbers = _files(self.spark, self.path), self.numbers()
        states = [self.state(n) for n in numbers[-max(keep, 1) :]]
        named = {name for s in states for name in s.live}
        for n in numbers[: -max(keep, 1)]:
            fs.delete(_path(self.spark, f"{self.path}/log/{n:020d}.json"), False)
        data = _path(self.spark, f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named and s.getModificationTime() < 1000 * (time.time() - older)] if fs.exists(data) else []
        for p in old:
            fs.delete(p, True)
        return len(old)


# Whole tables.


def commit(rows: DataFrame, path: str, expected: int | None = None, append: bool = False) -> int:
    """Writes rows as the next version of a table, or adds them to it. With ``expected``, only on top of that version."""
    log = TableLog(rows.sparkSession, path)
    now = log.state()
    if expected is not None and expected != now.version:
        raise Conflict(f"the table is at version {now.version}, not {expected}")
    name = log.write(rows)
    while True:
        kept = dict(now.live) if append else {}
        new = State(now.version + 1, kept | {name: {"kind": "base", "version": now.version + 1}}, now.applied, now.schema if append and now.schema else rows.schema.json())
        if log.put(new):
            return new.version
        now = log.state()
        if expected is not None:
            log.discard(name)
            raise Conflict(f"the table is at version {now.version}, not {expected}")


def version(spark: SparkSession, path: str) -> int:
    return TableLog(spark, path).state().version


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    log = TableLog(spark, path)
    state = log.state(number)
    if not state.version:
        raise ValueError(f"there is no table at {path}")
    return spark.read.schema(state.kind()).parquet(*(f"{log.path}/data/{name}" for name in state.live))


# Rows by key.


def _same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in names))


class KeyedTable:
    """One row a key, the one that ``order`` puts last. ``kind`` is needed to make the table, not to open it."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int = 64, share: float = 0.25, most_deltas: int = 16):
        self.spark, self.log = spark, TableLog(spark, path)
        self.keys, self.order, self.buckets, self.share, self.most_deltas = keys, order, buckets, share, most_deltas

    def _dealt(self, rows: DataFrame, state: State) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(state.buckets or self.buckets)).cast("int"))

    def _folders(self, state: State, kind: str, only: set[int] | None = None) -> dict[str, list[str]]:
        found = {}
        for name, about in state.live.items():
            own = [f"{self.log.path}/data/{name}/_bucket={b}" for b in about["buckets"] if only is None or int(b) in only]
            if about["kind"] == kind and own:
                found[name] = own
        return found

    def _read(self, state: State, kind: str, columns: list[str], only: set[int] | None) -> DataFrame | None:
        """Rows with ``_deleted`` and ``_version``, the version that added them."""
        own = T.StructType([*state.kind().fields, T.StructField("_deleted", T.BooleanType())])
        parts = []
        for name, paths in self._folders(state, kind, only).items():
            rows = self.spark.read.schema(own).parquet(*paths)
            parts.append(rows.select(*columns, "_deleted", F.lit(state.live[name]["version"]).alias("_version")))
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def merged(self, state: State, columns: list[str] | None = None, only: set[int] | None = None, deleted: bool = False) -> DataFrame:
        """The rows of a version. The base is not shuffled where the deltas' keys are few."""
        columns = columns or state.kind().fieldNames()
        need = list(dict.fromkeys([*self.keys, *self.order, *columns]))
        base, delta = (self._read(state, kind, need, only) for kind in ("base", "delta"))
        if delta is not None:
            rest = [c for c in need if c not in self.keys]
            last = delta.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "_deleted"), F.struct(*self.order, "_version")).alias("_r")).select(*self.keys, "_r.*")
            if base is not None:
                keys = last.select(*self.keys)
                last = base.join(keys, _same(base, keys, self.keys), "left_anti").drop("_version").unionByName(last)
        elif base is not None:
            last = base.drop("_version")
        else:
            last = self.spark.createDataFrame([], T.StructType([state.kind()[c] for c in need])).withColumn("_deleted", F.lit(False))
        return last.select(*columns, "_deleted") if deleted else last.where("not _deleted").select(*columns)

    def rows(self, version: int | None = None) -> DataFrame:
        state = self.log.state(version)
        if not state.version:
            raise ValueError(f"there is no table at {self.log.path}")
        return self.merged(state)

    def _sizes(self, name: str) -> dict[str, int]:
        """Bytes of each bucket that was written."""
        fs, at = _files(self.spark, self.log.path), _path(self.spark, f"{self.log.path}/data/{name}")
        own = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("_bucket=")]
        return {p.getName().removeprefix("_bucket="): fs.getContentSummary(p).getLength() for p in own}

    def _newer(self, batch: DataFrame, state: State, unique: bool = False) -> DataFrame:
        """The batch's last row of each key, where the table has none as late. unique: the batch has one row a key."""
        kind = state.kind() if state.version else batch.schema
        rows = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind))
        rest = [c for c in kind.fieldNames() if c not in self.keys]
        if not unique:
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_r")).select(*self.keys, "_r.*")
        if state.version:
            held = self.merged(state, [*self.keys, *self.order], deleted=True).select(*self.keys, F.struct(*self.order).alias("_held"))
            late = _same(rows, held, self.keys) & (F.struct(*(rows[c] for c in self.order)) <= held["_held"])
            rows = rows.join(held, late, "left_anti")
        return rows.select(*kind.fieldNames(), F.lit(False).alias("_deleted"))

    def _gone(self, keys: DataFrame, state: State) -> DataFrame:
        """Rows that delete what the table has of some keys. They are as late as what they delete, so no older row comes back."""
        held = self.merged(state)
        own = keys.select(*self.keys).distinct()
        return held.join(own, _same(held, own, self.keys), "left_semi").withColumn("_deleted", F.lit(True))

    def _commit(self, make, schema: str | None, expected: int | None, applied: tuple[str, int] | None) -> int:
        now = self.log.state()
        name, own = None, {}
        while True:
            if applied and now.applied.get(applied[0], -1) >= applied[1]:
                if name:
                    self.log.discard(name)
                return now.version
            if expected is not None and now.version != expected:
                if name:
                    self.log.discard(name)
                raise Conflict(f"the table is at version {now.version}, not {expected}")
            if name is None:
                name = self.log.write(self._dealt(make(now), now).hint("rebalance", "_bucket"), "_bucket")
                own = self._sizes(name)
            if not own:
                self.log.discard(name)
                if not applied:
                    return now.version
            new = State(now.version + 1, dict(now.live), dict(now.applied), now.schema or schema or "", now.buckets or self.buckets, sorted(map(int, own)))
            if own:
                new.live[name] = {"kind": "delta" if now.version else "base", "version": new.version, "buckets": own}
            if applied:
                new.applied[applied[0]] = applied[1]
            if self.log.put(new):
                return new.version
            # Another writer made this version. What we wrote still holds if it wrote other buckets.
            then = self.log.state()
            met = {b for n in range(now.version + 1, then.version + 1) for b in (self.log.state(n).wrote if self.log.state(n).wrote is not None else range(then.buckets))}
            if now.version == 0 or met & set(map(int, own)):
                self.log.discard(name)
                name = None
            now = then

    def upsert(self, batch: DataFrame, expected: int | None = None, applied: tuple[str, int] | None = None, unique: bool = False) -> int:
        """Sets the batch's rows where they are later than the table's; the version that holds them.

        ``unique`` says that the batch has one row a key, which then need not be looked for.
        ``applied`` names an application and a number that grows with its batches; a batch that comes again writes
        nothing. A batch without a later row makes no version.
        """
        done = self._commit(lambda state: self._newer(batch, state, unique), batch.schema.json(), expected, applied)
        self.compact()
        return done

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Deletes the rows of some keys; with ``expected``, only if the table is still at that version."""
        return self._commit(lambda state: self._gone(keys, state), None, expected, None)

    def compact(self, forget: bool = False, every: bool = False) -> int | None:
        """Writes the buckets anew whose deltas have grown to a share of their base, or are many; the new version, if there is one.

        With ``forget``, deleted keys are forgotten: older rows of theirs may come back then.
        """
        now = self.log.state()
        base, delta, count = {}, {}, {}
        for about in now.live.values():
            for b, size in about["buckets"].items():
                into = base if about["kind"] == "base" else delta
                into[int(b)] = into.get(int(b), 0) + size
                count[int(b)] = count.get(int(b), 0) + (about["kind"] == "delta")
        full = {b for b in delta if every or delta[b] >= self.share * base.get(b, 0) or count[b] >= self.most_deltas}
        if not full:
            return None
        rows = self.merged(now, only=full, deleted=not forget)
        if forget:
            rows = rows.withColumn("_deleted", F.lit(False))
        name = self.log.write(self._dealt(rows, now).hint("rebalance", "_bucket"), "_bucket")
        own = self._sizes(name)
        while True:
            new = State(now.version + 1, {}, now.applied, now.schema, now.buckets, sorted(full))
            for other, about in now.live.items():
                left = {b: s for b, s in about["buckets"].items() if int(b) not in full}
                if left:
                    new.live[other] = about | {"buckets": left}
            if own:
                new.live[name] = {"kind": "base", "version": new.version, "buckets": own}
            if self.log.put(new):
                return new.version
            then = self.log.state()
            if any(self.log.state(n).wrote is None or full & set(self.log.state(n).wrote) for n in range(now.version + 1, then.version + 1)):
                self.log.discard(name)
                return None  # a later call does it
            now = then
