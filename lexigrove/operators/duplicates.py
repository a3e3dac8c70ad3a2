"""Files that are byte for byte the same: sizes first, then hashes of those that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger files are not hashed.
LARGEST = 500 * 1024 * 1024
#: What a file may be doing that keeps it out.
BUSY = ("extracting", "analyzing", "moving", "done")


def duplicate_scan(items: DataFrame, sha256: Column, largest: int = LARGEST) -> DataFrame:
    """(place, path, size, outcome, reason, sha256, group, members) for each of items (place, path, size, status), by place the caller's order.

    ``outcome`` is ``duplicate`` (``group`` is the first place of its equals, ``members`` their number), ``unique``,
    ``skipped`` or ``failed``; ``reason`` says why the latter two. Skipped are remote paths, busy files, those whose size
    is null or negative or above ``largest``, and all entries of one path but the first that is none of these; a null
    path is a path of its own. ``sha256``, an expression over items, is asked only where another file has the size; null
    or anything but 64 hex digits fails. It is taken in the scan, so hashes move and texts do not. Places are unique.
    Sizes, paths and hashes are counted before they are joined, so a frequent one moves as one row from each task.
    """
    busy = F.coalesce(F.lower("status").isin(*BUSY), F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]+://"), F.lit(False)), "remote document")
        .when(busy, "busy or sorted already")
        .when(F.col("size").isNull() | (F.col("size") < 0), "size unknown")
        .when(F.col("size") > largest, "too large to verify")
    )
    rows = items.select("place", "path", "size", reason.alias("why"), sha256.alias("_hash"))
    fit = rows.where("why is null")
    first = fit.where("path is not null").groupBy("path").agg(F.min("place").alias("_first"))
    fit = fit.join(first, "path", "left").withColumn("why", F.when(F.col("place") > F.col("_first"), "the path is in the list already"))
    checked = fit.where("why is null")
    shared = checked.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    valid = F.when(F.col("_hash").rlike("^[0-9A-Fa-f]{64}$"), F.lower("_hash"))
    hashed = checked.join(shared, "size", "left_semi").select("place", "path", "size", valid.alias("sha256"))
    groups = hashed.where("sha256 is not null").groupBy("size", "sha256").agg(F.min("place").alias("group"), F.count(F.lit(1)).alias("members")).where("members > 1")
    found = hashed.join(groups, ["size", "sha256"], "left")
    outcome = F.when(F.col("sha256").isNull(), "failed").when(F.col("group").isNull(), "unique").otherwise("duplicate")
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    kinds = dict(found.dtypes)
    plain = lambda df, outcome: df.select("place", "path", "size", F.lit(outcome).alias("outcome"), F.col("why").alias("reason"), none("string", "sha256"), none(kinds["group"], "group"), none("bigint", "members"))
    out = found.select("place", "path", "size", outcome.alias("outcome"), F.when(F.col("sha256").isNull(), "no SHA-256").alias("reason"), "sha256", "group", "members")
    alone = checked.join(shared, "size", "left_anti")
    return out.unionByName(plain(alone, "unique")).unionByName(plain(fit.where("why is not null"), "skipped")).unionByName(plain(rows.where("why is not null"), "skipped"))
