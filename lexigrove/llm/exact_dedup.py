"""Exact duplicates by an extendible-hash index on shared files.

1. Every text is normalised (each run of ASCII white space becomes one space) and hashed to a 64-bit key. The directory
   comes first, from the distinct keys alone: it is doubled until no bucket holds more than ``capacity`` keys. A bucket is
   named by the top bits that its keys share, so buckets in order are ranges of keys. Doubling goes eight bits a round and
   on into overfull slots only, to all 64 bits if it must.
2. Texts are dealt to the owners of their buckets. Copies meet there by their bytes, combined on the map side first, so
   one text that fills a third of the table reaches its owner as one row a task.
3. The index is written to the shared folder, range-dealt by bucket and key: each owner task has a range of keys. Texts
   that collide in a key form its chain, ordered by the smallest id; an owner refuses a chain that holds a digest twice.
4. Each row finds its bucket in the directory and its chain in the index, and the chain's entry decides on it.

Defined results: a null text counts as empty, and all empty texts are one group. Of rows with the smallest id of a group
one stays, even where they are equal. A null id never stays while its group has another id. An empty table gives an empty
result. Other columns are not read, unless ``keep`` names them: then they come in a struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.base import same, scratch, text_or_empty, written

#: Bits by which the directory doubles in a round, and the levels whose slots are few enough to send to all tasks.
STRIDE, SENT = 8, 2


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces, which most runs are, never match."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _slot(level: int) -> Column:
    """The top bits of a key that name its slot at a level of the directory."""
    return F.shiftrightunsigned("h", 64 - STRIDE * (level + 1))


def _levels(keys: DataFrame, capacity: int) -> list[DataFrame]:
    """One table a level: (slot, bucket, depth) of used slots; no bucket where the slot goes on in the next level.

    keys has a row for each distinct key ``h``. A bucket is its first key, as a number of all 64 bits.
    """
    slots, out, open_ = 1 << STRIDE, [], keys
    for level in range(64 // STRIDE):
        held = open_.groupBy(_slot(level).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        parent, own = F.shiftrightunsigned("slot", STRIDE), F.col("slot").bitwiseAND(F.lit(slots - 1)).cast("int")
        known = F.map_from_entries(F.collect_list(F.struct(own.alias("own"), "n")))  # slots of one parent: 256 at most
        rows = held.groupBy(parent.alias("parent")).agg(known.alias("known"))
        rows = rows.withColumn("loads", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.element_at("known", i), F.lit(0).cast("bigint"))))
        load = lambda own, k: F.aggregate(F.slice("loads", own - F.pmod(own, F.lit(slots >> k)) + 1, F.lit(slots >> k)), F.lit(0).cast("bigint"), lambda a, n: a + n)
        rows = rows.select("parent", "loads", F.explode(F.map_keys("known")).alias("own"))
        # The least doubling that makes the slot's bucket fit.
        fits = F.coalesce(*(F.when(load(F.col("own"), k) <= capacity, F.lit(k)) for k in range(STRIDE + 1)), *([F.lit(STRIDE)] if level == 64 // STRIDE - 1 else []))
        rows = rows.select("parent", "own", fits.alias("k"))
        slot = F.shiftleft(F.col("parent"), STRIDE) + F.col("own")
        first = F.shiftleft(slot - F.expr(f"pmod(own, shiftleft(1, {STRIDE} - k))"), 64 - STRIDE * (level + 1))
        found = written(rows.select(slot.alias("slot"), F.when(F.col("k").isNotNull(), first).alias("bucket"), (F.col("k") + STRIDE * level).alias("depth")))
        out.append(found)
        deeper = found.where("bucket is null").select("slot")
        if not deeper.head(1):
            break
        open_ = written(open_.join(F.broadcast(deeper) if level < SENT else deeper, _slot(level) == F.col("slot"), "left_semi"))
    return out


def directory(levels: list[DataFrame]) -> DataFrame:
    """(bucket, depth) of every bucket."""
    every = levels[0].select("bucket", "depth")
    for found in levels[1:]:
        every = every.unionByName(found.select("bucket", "depth"))
    return every.where("bucket is not null").distinct()


def _bucketed(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with the bucket of their key ``h``."""
    for level, found in enumerate(levels):
        own = found.select(F.col("slot").alias(f"slot{level}"), F.col("bucket").alias(f"bucket{level}"))
        rows = rows.join(F.broadcast(own) if level < SENT else own, _slot(level) == F.col(f"slot{level}"), "left").drop(f"slot{level}")
    return rows.withColumn("bucket", F.coalesce(*(f"bucket{level}" for level in range(len(levels))))).drop(*(f"bucket{level}" for level in range(len(levels))))


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the directory, and the index (bucket, h, chain), as tables in the shared folder.

    A chain's entries are (keep_id, group_size, digest).
    """
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("body")).withColumn("h", F.xxhash64("body"))
    levels = _levels(written(texts.select("h").distinct()), capacity)
    owned = _bucketed(texts, levels).groupBy("bucket", "h", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = owned.select("bucket", "h", F.struct(F.col("keep_id").isNull().alias("last"), "keep_id", "group_size", F.sha2("body", 256).alias("digest")).alias("entry"))
    chains = entries.repartitionByRange("bucket", "h").groupBy("bucket", "h").agg(F.sort_array(F.collect_list("entry")).alias("chain"))  # texts of one 64-bit key
    sound = F.size(F.array_distinct(F.transform("chain", lambda x: x["digest"]))) == F.size("chain")
    chains = chains.withColumn("chain", F.when(sound, F.col("chain")).otherwise(F.raise_error(F.lit("two texts share key and digest")).cast(chains.schema["chain"].dataType)))
    return levels, written(chains.sortWithinPartitions("bucket", "h"))


def _one_of_equals(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows (row, id, h, text_sha256, kept, ...) with one kept row of each group; repeated: the ids that occur again."""
    again = repeated.select(F.col("id").alias("_again"), F.lit(True).alias("_more"))
    marked = rows.join(again, same(F.col("id"), F.col("_again")), "left").withColumn("tied", F.col("kept") & F.coalesce("_more", F.lit(False))).drop("_again", "_more")
    marked = marked.withColumn("task", F.spark_partition_id()).withColumn("order", F.xxhash64(F.to_json("row")))
    tied, rest = marked.where("tied"), marked.where("not tied")
    # First of a task, then first of these: equal rows may be a third of the table.
    tied = tied.withColumn("place", F.row_number().over(Window.partitionBy("h", "text_sha256", "task").orderBy("order")))
    pool = F.when(F.col("place") == 1, F.lit(-1)).otherwise(F.col("task"))
    tied = tied.withColumn("pool", pool).withColumn("first", F.row_number().over(Window.partitionBy("h", "text_sha256", "pool").orderBy("order", "task")))
    tied = tied.withColumn("kept", (F.col("place") == 1) & (F.col("first") == 1))
    return rest.select(rows.columns).unionByName(tied.select(rows.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, capacity: int = 4096) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept and text_sha256; with keep, its columns as the struct ``row``."""
    with scratch() as stays:
        levels, index = build_index(docs, id_col, text_col, capacity)
        for table in (*levels, index):
            stays(table)
        body = normalised(text_or_empty(text_col))
        rows = docs.select(F.struct(*(keep or (id_col,))).alias("row"), F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("text_sha256"))
        # A chain of one text with one row needs no look-up: it can decide for that row only.
        shared = index.where("size(chain) > 1 or chain[0].group_size > 1")
        found = _bucketed(rows, levels).join(shared, ["bucket", "h"], "left")
        entry = F.filter("chain", lambda x: x["digest"] == F.col("text_sha256"))[0]
        found = found.withColumn("entry", F.when(F.col("chain").isNotNull(), entry))
        first = F.when(F.col("chain").isNull(), F.col("id")).otherwise(F.col("entry.keep_id"))
        size = F.coalesce("entry.group_size", F.lit(1).cast("bigint"))
        out = found.select("row", "id", "h", first.alias("keep_id"), size.alias("group_size"), same(F.col("id"), first).alias("kept"), "text_sha256")
        repeated = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        if repeated.head(1):
            out = _one_of_equals(stays(written(out)), repeated)
    return out.select(*(["row"] if keep else []), F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")
