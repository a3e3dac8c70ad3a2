"""Pages, facets, folders, duplicates, graphs and counts over the library."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.session import checkpointed

#: Sort keys of the browser; unknown values come last both ways.
SORTS = ("filename", "title", "author", "year", "language", "indexed_at", "parent_dir")


def ordered(docs: DataFrame, by: str = "indexed_at", descending: bool = True, *ties: str) -> DataFrame:
    if by not in SORTS:
        raise ValueError(f"there is no sort {by!r}")
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return docs.orderBy(first, *ties)


def page(docs: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("a page has from 1 to 1000 rows")
    return docs.offset(offset).limit(limit)


@dataclass(frozen=True)
class Page:
    """Rows in order, how many there are on all pages, and the cursor of the next page; None at the end."""

    rows: DataFrame
    total: int
    next: str | None


def paged(docs: DataFrame, by: str = "indexed_at", descending: bool = True, ties: tuple[str, ...] = (), limit: int = 200, cursor: str | None = None) -> Page:
    """The page of ``limit`` rows (1 to 1000, other limits become the nearest of them) that begins at ``cursor``.

    The count reads no column but those of the filters. Where many pages are read, ``keyset_page`` skips none again.
    """
    limit, begin = min(max(limit, 1), 1000), 0
    if cursor is not None:
        if not re.fullmatch(r"[0-9]{1,18}", cursor):
            raise ValueError(f"{cursor!r} is no cursor")
        begin = int(cursor)
    total = docs.count()
    rows = ordered(docs, by, descending, *ties)
    if begin >= total:
        return Page(rows.limit(0), total, None)
    return Page(page(rows, limit, begin), total, str(begin + limit) if begin + limit < total else None)


def keyset_page(feed: DataFrame, after: tuple | None, limit: int, keys: tuple[str, ...] = ("indexed_at", "owner_id", "id")) -> DataFrame:
    """The rows behind the cursor in key order, one more than limit so that the caller sees whether more follow."""
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            beyond = beyond | (same & (F.col(k) > F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        feed = feed.where(beyond)
    return feed.orderBy(*keys).limit(limit + 1)


def value_counts(docs: DataFrame, kind: str, value: Column, limit: int | None = None) -> DataFrame:
    """(kind, value, n), without empty values."""
    out = docs.select(value.cast("string").alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    out = out.select(F.lit(kind).alias("kind"), "value", "n")
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def corpus_stats(rows: DataFrame) -> DataFrame:
    docs = rows.where("chunk_index <= 0")
    one = lambda kind, df, n: df.agg(n.cast("bigint").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("value"), "n")
    parts = [
        one("documents", docs, F.count(F.lit(1))),
        one("chunks", rows, F.count(F.lit(1))),
        one("bytes", docs, F.coalesce(F.sum(F.get_json_object("metadata_json", "$.fs_size").cast("bigint")), F.lit(0))),
        value_counts(docs, "ext", F.lower("ext")),
        value_counts(docs, "language", F.col("language")),
        value_counts(docs, "year", F.col("year")),
        value_counts(docs.select(F.explode("tags").alias("tag")), "tag", F.col("tag"), 50),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tag_facets(docs: DataFrame, limit: int = 5000) -> DataFrame:
    """(tag, n) of the documents, most frequent first; collections are no facets."""
    tags = docs.where("chunk_index <= 0").select(F.explode("tags").alias("tag")).where("tag <> '' and not startswith(tag, 'collection:')")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def search_facets(matches: DataFrame, top: int = 25) -> DataFrame:
    """For extension, language, year and tag: the top values, how many values there are, are left out, and documents without any.

    One pass counts all values of all kinds, a missing one as null; the rest works on these counts.
    """
    kinds = {"extension": F.array(F.lower("ext")), "language": F.array("language"), "year": F.array(F.col("year").cast("string")), "tag": F.col("tags")}
    have = lambda values: F.filter(F.array_distinct(values), lambda x: x.isNotNull() & (x != ""))
    each = matches.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), have(v).alias("have")) for k, v in kinds.items()))))
    counts = checkpointed(each.select("kind", F.explode_outer("have").alias("value")).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    known = counts.where("value is not null")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    ranked = known.withColumn("rank", place).where(F.col("rank") <= top)
    totals = known.groupBy("kind").agg(F.count(F.lit(1)).alias("distinct"))
    none = counts.where("value is null").select("kind", F.col("n").alias("missing"))
    out = ranked.join(F.broadcast(totals), "kind").join(F.broadcast(none), "kind", "left")  # a row for each kind
    return out.select("kind", "value", "n", "rank", "distinct", F.greatest(F.col("distinct") - top, F.lit(0)).cast("bigint").alias("omitted"), F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"))


def groups_of(docs: DataFrame, key: Column, member: str, least: int = 2) -> DataFrame:
    """(key, n, first, member): a row for each document of every key that at least ``least`` documents share.

    Only counts and the first member are combined by key, so a key of very many documents is in no single row.
    """
    rows = docs.select(key.alias("key"), F.col(member).alias("member")).where("key <> ''")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first")).where(F.col("n") >= least)
    return rows.join(shared, "key").select("key", "n", "first", "member")


def folder_children(docs: DataFrame, parent: str, path: str = "parent_dir") -> DataFrame:
    """(name, n) of the next path component below parent, counting all below it."""
    base = parent.rstrip("/") + "/"
    rest = F.substr(F.col(path), F.lit(len(base) + 1))
    below = docs.where(F.col(path).startswith(base)).select(F.substring_index(rest, "/", 1).alias("name")).where("name <> ''")
    return below.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def entity_graph(docs: DataFrame, prefixes: tuple[str, ...] = ("person:", "org:", "loc:", "date:"), least: int = 2, nodes: int = 100) -> DataFrame:
    """Edges (a, b, weight) between the most frequent entity tags; a tag pair counts once a document."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("tag").startswith(p)
    first = tag_facets(docs, 500).where(named).orderBy(F.desc("n"), "tag").limit(nodes).select("tag")
    tags = docs.where("chunk_index <= 0").select("id", "owner_id", F.explode(F.array_distinct("tags")).alias("tag")).join(F.broadcast(first), "tag", "left_semi")  # at most ``nodes`` rows
    lists = tags.groupBy("owner_id", "id").agg(F.sort_array(F.collect_list("tag")).alias("ts"))
    pairs = lists.select(F.posexplode("ts").alias("i", "a"), "ts").select("a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


#: Hashes of a task in which hashes meet.
MEETING = 4096


def _dealt_bits(hashes: DataFrame) -> tuple[list[list[int]], int]:
    """The 64 bits in three parts, dealt out by how evenly a bit divides the hashes, so that no part is made of bits that are alike in most; and the number of hashes."""
    set_ = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1))).alias(f"b{j}") for j in range(64)]
    row = hashes.agg(F.count(F.lit(1)).alias("n"), *set_).first()
    order = sorted(range(64), key=lambda j: abs(2 * (row[f"b{j}"] or 0) - row.n))
    return [order[0::3], order[1::3], order[2::3]], row.n


def hamming_pairs(rows: DataFrame, key: str, bits: str, most: int = 8) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit hashes that differ in at most ``most`` bits (8 at most).

    In one of three parts two such hashes differ in no more than most // 3 bits, whichever bits make a part. So parts are
    the join keys, as they are and with single bits turned on one or both sides, and nothing is missed. Bits are dealt to
    parts by counts on the hashes themselves; of random hashes one pair in some thousands meets. Equal hashes join as one row.
    """
    if not 0 <= most <= 8:
        raise ValueError("at most 8 bits may differ")
    one = rows.groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("k"))
    parts, n = _dealt_bits(one)
    tasks = max(-(-n // MEETING), rows.sparkSession.sparkContext.defaultParallelism)  # few bytes make many meetings
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def keyed(turned: bool) -> DataFrame:
        keys = []
        for i, own in enumerate(parts):
            part = F.col("h").bitwiseAND(F.lit(signed(sum(1 << j for j in own))).cast("bigint"))
            for j in [None, *own] if turned else [None]:
                keys.append(F.struct(F.lit(i).alias("i"), (part if j is None else part.bitwiseXOR(F.lit(signed(1 << j)).cast("bigint"))).alias("part"), F.lit(-1 if j is None else j).alias("j")))
        return one.select("h", "k", F.inline(F.array(*keys))).repartition(tasks, "i", "part")

    x, y = keyed(most >= 3).alias("x"), keyed(most >= 6).alias("y")
    differ = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    met = (F.col("x.i") == F.col("y.i")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.k") < F.col("y.k")) & (differ <= most)
    once = (F.col("y.j") < 0) | (F.col("x.j") > F.col("y.j"))  # of the ways to turn two bits, or one, the same bits on one side or the other
    return x.join(y.hint("merge"), met & once).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), differ.alias("distance")).distinct()


def clusters(rows: DataFrame, key: str, vector: str, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(key, cluster) by k-means with squared distances."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, maxIter=rounds, seed=seed, predictionCol="cluster").fit(data).transform(data).select(key, "cluster")


def top_terms(docs: DataFrame, group: str, text: str, n: int, words: int = 200, stop: tuple[str, ...] = ()) -> DataFrame:
    """(group, term, score, rank): tf × ln(N / df) over the first words of each document."""
    first = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, words)
    # A document's words lie sorted in its row, where the first of equal ones counts the document; no document is a key.
    sorted_ = docs.select(group, F.sort_array(first).alias("_w"))
    marked = F.transform("_w", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("_w", i - 1))).alias("new")))
    rows = sorted_.select(group, F.inline(marked)).where(~F.col("term").isin(*stop) if stop else F.lit(True))
    tf = rows.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"), F.count_if("new").alias("own"))
    total = docs.count()
    df = F.sum("own").over(Window.partitionBy("term"))  # over a row a group
    scored = tf.select(group, "term", F.round(F.col("tf") * F.ln(F.lit(float(total)) / df), 6).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retrieval_metrics(runs: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """P@k, R@k, nDCG@k, MRR@k and unjudged results of each query. runs: (query_id, doc_id, rank); judgments: (query_id, doc_id, grade)."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    seen = runs.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left")
    good = F.coalesce(F.col("grade") > 0, F.lit(False))
    got = seen.groupBy("query_id").agg(
        F.count(F.when(good, 1)).alias("hits"),
        F.sum(F.when(good, gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.max(F.when(good, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.count(F.when(F.col("grade").isNull(), 1)).alias("unjudged"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    best = judgments.where("grade > 0").withColumn("r", F.row_number().over(w))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade")) / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"))
    out = ideal.join(got, "query_id", "left").fillna(0)
    r6 = lambda c: F.round(c, 6)
    return out.select("query_id", "relevant", "unjudged", r6(F.col("hits") / k).alias("precision"), r6(F.col("hits") / F.col("relevant")).alias("recall"), r6(F.col("dcg") / F.col("idcg")).alias("ndcg"), r6("mrr").alias("mrr"))


def nearest_rank(rows: DataFrame, value: str, *fractions: float, ranges: int = 1000) -> DataFrame:
    """Nearest-rank percentiles: (fraction, value). Ranges of about equal size find the value's range, counts inside it the value."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    edges = known.agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first().q or []
    edges = sorted(set(edges))
    place = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col("value"))) if edges else F.lit(0)
    counted = checkpointed(known.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("range", place))
    held = {r["range"]: r.n for r in counted.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # ``ranges`` rows at most
    total, out = sum(held.values()), None
    for f in fractions:
        left, at = max(math.ceil(total * f), 1), None
        for at in sorted(held):
            if held[at] >= left:
                break
            left -= held[at]
        inside = counted.where(F.col("range") == F.lit(at))
        upto = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        one = inside.withColumn("upto", upto).where(F.col("upto") >= left).agg(F.min("value").alias("value")).select(F.lit(f).alias("fraction"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def placed(rows: DataFrame, bucket: Column, order: tuple) -> DataFrame:
    """rows with their place in a global order; bucket must ascend along it. Only counts of buckets are in one task."""
    keyed = rows.withColumn("_b", bucket)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return inside.join(before, F.col("_b").eqNullSafe(F.col("_c"))).withColumn("place", F.col("_before") + F.col("_i")).drop("_b", "_c", "_i", "_before")
