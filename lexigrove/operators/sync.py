"""Change feeds, conflicts, plan comparison, block maps, rules, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.session import checkpointed

POLICIES = ("newest_wins", "local_wins", "remote_wins", "keep_both", "manual")


def _policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"there is no policy {policy!r}")
    return policy


def changes(rows: DataFrame, deletions: DataFrame, since: int, horizon: int) -> DataFrame:
    """Live rows from the watermark on (it is included) and the last deletion of each identity that is not live again, in one order."""
    live = rows.where((F.col("indexed_at") >= since) & (F.col("indexed_at") <= horizon)).select("indexed_at", "owner_id", "id", F.lit(False).alias("deleted"))
    gone = deletions.where((F.col("indexed_at") >= since) & (F.col("indexed_at") <= horizon)).groupBy("owner_id", "id").agg(F.max("indexed_at").alias("indexed_at"))
    gone = gone.join(rows.select("owner_id", "id"), ["owner_id", "id"], "left_anti").select("indexed_at", "owner_id", "id", F.lit(True).alias("deleted"))
    return live.unionByName(gone)


def resolution(policy: str, local: str = "l", remote: str = "r") -> Column:
    """What to do with two versions; equal content may still have newer metadata."""
    _policy(policy)
    lt, rt = F.col(f"{local}.updated_at"), F.col(f"{remote}.updated_at")
    newer = F.coalesce(rt > lt, F.lit(False)) | (rt.isNotNull() & lt.isNull())
    same = F.col(f"{local}.source_hash") == F.col(f"{remote}.source_hash")
    differ = ~F.col(f"{local}.title").eqNullSafe(F.col(f"{remote}.title")) | F.coalesce(rt > lt, F.lit(False))
    by_time = F.when(newer, "use_remote").otherwise("use_local")
    equal, other = {
        "newest_wins": (by_time, by_time),
        "local_wins": (F.lit("use_local"), F.lit("use_local")),
        "remote_wins": (F.lit("use_remote"), F.lit("use_remote")),
        "keep_both": (F.lit("use_local"), F.lit("keep_both")),
        "manual": (F.when(differ, "manual_review").otherwise("use_local"), F.lit("manual_review")),
    }[policy]
    return F.when(same, equal).otherwise(other)


def compare_plans(local: DataFrame, remote: DataFrame, policy: str) -> DataFrame:
    """(path, action) over both sides. Columns: path, size, mtime; local times of 0 and remote ones of 0 or null are unknown."""
    lm, rm = F.col("l.mtime"), F.col("r.mtime")
    joined = local.alias("l").join(remote.alias("r"), F.col("l.path") == F.col("r.path"), "full_outer")
    unknown = (lm == 0) | rm.isNull() | (rm == 0)
    newest = F.when(unknown, "manual_review").when(lm > rm, "use_local").when(lm < rm, "use_remote").otherwise("manual_review")
    chosen = {"newest_wins": newest, "manual": F.lit("manual_review")}.get(_policy(policy), F.lit({"local_wins": "use_local", "remote_wins": "use_remote", "keep_both": "keep_both"}.get(policy, "")))
    same = (F.col("l.size") == F.col("r.size")) & lm.eqNullSafe(rm)
    if policy == "newest_wins":
        same = same & (lm != 0)
    action = F.when(F.col("l.path").isNull(), "remote_only").when(F.col("r.path").isNull(), "local_only").when(same, "unchanged").otherwise(chosen)
    return joined.select(F.coalesce("l.path", "r.path").alias("path"), action.alias("action"))


def push_plan(local: DataFrame, remote: DataFrame, policy: str) -> DataFrame:
    """Local rows that may be sent. Times that newest_wins cannot order stop the whole plan."""
    compared = compare_plans(local, remote, policy)
    if policy == "newest_wins" and compared.where("action = 'manual_review'").head(1):
        raise ValueError("newest_wins cannot order files with unknown or equal times")
    return local.join(compared.where("action in ('local_only', 'use_local')").select("path"), "path", "left_semi")


def blocks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, block, length, weak, strong): fixed-size byte blocks with CRC-32 and SHA-256."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(data) / size) - 1, F.lit(0)).cast("int"))).alias("block")
    cut = rows.select(key, data.alias("_d"), at).select(key, "block", F.substr("_d", F.col("block") * size + 1, F.lit(size)).alias("_b"))
    return cut.where(F.octet_length("_b") > 0).select(key, "block", F.octet_length("_b").alias("length"), F.crc32("_b").alias("weak"), F.sha2("_b", 256).alias("strong"))


def changed_blocks(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Blocks of local that remote lacks or has otherwise."""
    r = remote.select(key, "block", F.col("strong").alias("_s"))
    return local.join(r, [key, "block"], "left").where("_s is null or _s <> strong").drop("_s")


def delta_summary(local: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """(key, blocks, changed, bytes, savings): the share of bytes that need not be sent, 1 for an empty file."""
    whole = local.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.sum("length").alias("size"))
    some = changed.groupBy(key).agg(F.count(F.lit(1)).alias("changed"), F.sum("length").alias("bytes"))
    out = whole.join(some, key, "left").fillna(0, ["changed", "bytes"])
    return out.select(key, "blocks", "changed", "bytes", F.round(F.when(F.col("size") > 0, 1 - F.col("bytes") / F.col("size")).otherwise(1.0), 6).alias("savings"))


#: Most rules of a set.
MOST_RULES = 1000


def retention(docs: DataFrame, rules: list[tuple] | DataFrame, now: int) -> DataFrame:
    """(id, rule, action) of the first rule, by its number, that has one; in a rule deletion goes before archiving.

    rules: (rule, match_type: folder or tag, match_value, archive_days, delete_days, enabled). They become one column, so
    each document is looked at once and nothing is joined.
    """
    if isinstance(rules, DataFrame):
        rules = [tuple(r) for r in rules.select("rule", "match_type", "match_value", "archive_days", "delete_days", "enabled").limit(MOST_RULES + 1).collect()]
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    age = F.expr(f"({now} - indexed_at) div 86400000")
    hits = []
    for rule, kind, value, archive, delete, enabled in sorted(rules, key=lambda r: r[0]):
        if not enabled or kind not in ("folder", "tag"):
            continue
        fits = F.col("parent_dir").contains(value) if kind == "folder" else F.array_contains("tags", value)
        action = F.when(age >= delete, "delete") if delete is not None else F
        action = action.when(age >= archive, "archive") if archive is not None else action
        if action is not F:
            hits.append(F.when(fits & action.isNotNull(), F.struct(F.lit(rule).alias("rule"), action.alias("action"))))
    if not hits:
        return docs.select("id", F.lit(0).alias("rule"), F.lit("").alias("action")).limit(0)
    found = docs.select("owner_id", "id", F.coalesce(*hits).alias("a")).where("a is not null")
    return found.groupBy("owner_id", "id").agg(F.min("a").alias("a")).select("id", "a.rule", "a.action")


def automation(files: DataFrame, rules: list[dict], match_all: bool = False) -> DataFrame:
    """(id, priority, rule) of the enabled rules that match, only the first by priority unless match_all.

    A rule: name, priority, enabled, mode (all, any), triggers: (kind, value) of extension, doctype, tag, folder, size.
    """

    def trigger(kind: str, value: object) -> Column:
        if kind == "extension":
            return F.lower("ext").isin([v.lower() for v in value])
        if kind == "doctype":
            return F.coalesce(F.lower("doctype") == value.lower(), F.lit(False))
        if kind == "tag":
            return F.array_contains("tags", value)
        if kind == "folder":
            return F.col("parent_dir").startswith(value)
        low, high = value
        return (F.col("size") >= low if low is not None else F.lit(True)) & (F.col("size") <= high if high is not None else F.lit(True))

    found = []
    for r in rules:
        if r.get("enabled", True) and r["triggers"]:
            every, some = F.lit(True), F.lit(False)
            for kind, value in r["triggers"]:
                every, some = every & trigger(kind, value), some | trigger(kind, value)
            found.append(F.when(every if r.get("mode", "all") == "all" else some, F.struct(F.lit(r["priority"]).alias("priority"), F.lit(r["name"]).alias("rule"))))
    if not found:
        return files.select("id", F.lit(0).alias("priority"), F.lit("").alias("rule")).limit(0)
    hits = F.sort_array(F.array_compact(F.array(*found)))
    return files.select("id", F.inline(hits if match_all else F.slice(hits, 1, 1)))


def versions(rows: DataFrame, path: str, time: str, *ties: str) -> DataFrame:
    """Each row's version number at its path, and whether it is the current one."""
    w = Window.partitionBy(path).orderBy(time, *ties)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("current", F.lead(F.lit(1)).over(w).isNull())


def latest(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def running(rows: DataFrame, order: tuple[str, ...], totals: dict[str, str], group: str | None = None) -> DataFrame:
    """rows with, for each of totals (new column: summed column), the sum over all rows before in order, or of the group's.

    Rows are dealt to ranges of the order and written, so that every row's range is settled; sums of ranges come before
    windows inside ranges, and no task sees more than a range.
    """
    keys = [group, *order] if group else [*order]
    ranged = checkpointed(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    by = [group] if group else []
    sums = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in totals.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*(F.col(c).alias("_group") for c in by), F.col("_part").alias("_range"), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for n, c in totals.items():
        ranged = ranged.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    on = F.col("_part") == F.col("_range")
    on = on & F.col(group).eqNullSafe(F.col("_group")) if group else on
    return ranged.join(sums, on).select(*rows.columns, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in totals))


def purge(docs: DataFrame, most: int, size: str = "size", heavy: str = "heavy") -> DataFrame:
    """(id, action): oldest documents lose their heavy columns, and if that is too little go, until the rest fits."""
    all_ = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.coalesce(F.sum(heavy), F.lit(0)).alias("heavy")).first()
    over = max(all_["size"] - most, 0)
    still = max(over - all_["heavy"], 0)
    rows = docs.select("id", "indexed_at", F.col(heavy).alias("h"), (F.col(size) - F.col(heavy)).alias("light"))
    rows = running(rows, ("indexed_at", "id"), {"freed": "h", "gone": "light"})
    action = F.when(F.col("gone") < still, "delete").when(F.col("freed") < over, "strip").otherwise("keep")
    return rows.select("id", action.alias("action"))


def shards(files: DataFrame, n: int) -> DataFrame:
    """(group, path, shard): each group's files in path order; on to the next shard when one holds its share, the last takes the rest.

    Sums over ranges tell where a file begins in its group. Where a shard ends is the first such sum that is a share
    behind where it began: n - 1 aggregates of one row a group.
    """
    totals = files.groupBy(F.col("group").alias("_g")).agg((F.sum("size") / n).alias("share"), F.lit(0).cast("bigint").alias("end0"))
    begun = checkpointed(running(files.select("group", "path", "size"), ("path",), {"begin": "size"}, "group").withColumn("upto", F.col("begin") + F.col("size")))
    ends = totals
    for k in range(1, n):
        on = begun["group"].eqNullSafe(ends["_g"]) & (F.col("upto") >= F.col(f"end{k - 1}") + F.col("share"))
        last = begun.join(ends, on).groupBy(F.col("group").alias("_h")).agg(F.min("upto").alias(f"end{k}"))
        ends = ends.join(last, F.col("_g").eqNullSafe(F.col("_h")), "left").drop("_h")
    passed = sum((F.coalesce((F.col("begin") >= F.col(f"end{k}")).cast("int"), F.lit(0)) for k in range(1, n)), F.lit(0))
    shard = F.when(F.col("share") > 0, passed).otherwise(F.lit(0))
    return begun.join(ends, F.col("group").eqNullSafe(F.col("_g"))).select("group", "path", shard.alias("shard"))
