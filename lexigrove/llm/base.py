"""What the training-data operators share: written tables in the shared folder, and byte-level word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the ASCII range, as a regular-expression class body.
BLANK = r"\x20\x09-\x0D"


#: Makes Spark delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one of our own only where that is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lexigrove-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: How many tidy() blocks of all threads are open, and what the setting was before the first.
_TIDY, _TIDY_LOCK = {"open": 0, "before": "false"}, threading.Lock()


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files. The setting is the session's: it holds until the last thread is out."""
    with _TIDY_LOCK:
        if not _TIDY["open"]:
            _TIDY["before"] = spark.conf.get(CLEANUP, "false")
        _TIDY["open"] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _TIDY_LOCK:
            _TIDY["open"] -= 1
            if not _TIDY["open"]:
                spark.conf.set(CLEANUP, _TIDY["before"])


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder. The lineage ends there, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexigrove/{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    with tidy(spark):  # nothing reads this write's shuffles again
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexigrove_path = path  # for drop()
    for made in _OPEN.get():
        made.append(back)
    return back


#: The lists of the scratch() blocks that are open in this thread.
_OPEN: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("lexigrove_scratch", default=())


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes in here are deleted at the end, but for those that went through the function given."""
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(getattr(table, "_lexigrove_path", ""))
        return table

    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield keep
    finally:
        _OPEN.reset(before)
        for table in made:
            if table._lexigrove_path not in kept:
                drop(table)


def drop(table: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    spark, path = table.sparkSession, getattr(table, "_lexigrove_path", None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, longer while a column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drawn(share: float, *of: Column | str) -> Column:
    """A condition that holds for ``share`` of all values of the columns, by a 63-bit hash: of very many rows some are always drawn."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*of).bitwiseAND(F.lit(2**63 - 1)) < F.lit(int(share * 2**63))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
