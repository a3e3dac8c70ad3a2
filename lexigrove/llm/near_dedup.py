"""Near duplicates by min-max hashing.

A document's set is that of its distinct five-word shingles (lower-cased A-Z, words between ASCII white space). Under
each of ``permutations`` random permutations both the smallest and the largest value are kept, so half the hash
evaluations give a signature of twice the length; each of the two agrees between two sets with their similarity as its
probability. Bands of ``rows`` values are the candidate keys: with 120 permutations and 5 rows, 48 bands miss a pair at
similarity 0.75 with probability 2e-6, and closer pairs far less often.

Equal sets become one class first. Candidates are then confirmed on full sets, but no bucket is expanded into all
pairs: every class is compared with the leader that it shares most bands with, confirmed classes are united, and only
buckets that still hold more than one component are gone through again, with four times as many leaders a round, until
each is of one component or all its members have led. Pairs that their sizes and the shingles they share with anyone
rule out are never made. So large groups of near copies cost a few comparisons for each
copy, and no link that a bucket could show between two components is lost.

Defined results: null and word-less texts have an empty set and are linked with nothing; fewer than five words are one
shingle; rows of one id are one node; a null id joins its class of equal sets only. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import drop, same, scratch, text_or_empty, written
from lexigrove.llm.components import components

#: Pairs whose list may be broadcast to the scan of the texts (about 40 bytes each); longer lists are joined.
BROADCAST_ROWS = 200_000
#: Classes of shingles, by their last bits, for bounds on what two sets have in common.
CLASSES = 64
#: Bytes of text that a task works on at once.
SLICE = 1 << 18
#: Members of a group that one task compares with the leader.
PER_SALT = 256


def signatures(batches: Iterator[pa.RecordBatch], permutations: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    """Over (id, text, row): (id, n_shingles, d1, d2: a digest of the set, bands, row)."""
    import xxhash

    rng = np.random.default_rng(2024)
    a = (rng.integers(0, 2**31, permutations, dtype=np.uint32) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
    n_bands = 2 * permutations // rows
    weight = np.random.default_rng(5).integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    tag = np.random.default_rng(6).integers(1, 2**63, n_bands, dtype=np.uint64)
    hasher = kernels.WordHasher()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j in kernels.slices(texts, SLICE):
            raw, at = kernels.bytes_of(texts.slice(i, j - i))
            sets = kernels.shingles(*hasher.words(raw, at), j - i, k)
            n = np.array([len(s) for s in sets], np.int64)
            digest = np.zeros((j - i, 2), np.uint64)
            values = np.zeros((j - i, 2 * permutations), np.uint32)
            for r, s in enumerate(sets):
                if not len(s):
                    continue
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                digest[r] = whole >> 64, whole & (2**64 - 1)
                low = np.full(permutations, 2**32 - 1, np.uint32)
                high = np.zeros(permutations, np.uint32)
                x = (s >> np.uint64(32)).astype(np.uint32)
                for c in range(0, len(x), 4096):
                    v = x[c : c + 4096, None] * a
                    v += b
                    np.minimum(low, v.min(axis=0), out=low)
                    np.maximum(high, v.max(axis=0), out=high)
                values[r, :permutations], values[r, permutations:] = low, high
            keys = (values.reshape(j - i, n_bands, rows).astype(np.uint64) * weight).sum(axis=2, dtype=np.uint64)
            keys = kernels.mixed(keys + tag).view(np.int64)
            full = n > 0
            lens = np.where(full, n_bands, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(keys[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), bands, batch.column(2).slice(i, j - i)], ["id", "n_shingles", "d1", "d2", "bands", "row"]
            )


def compared(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (lead, salt, member, id, text), sorted, each leader's own row first. Yields the (lead, id) that are alike."""
    hasher = kernels.WordHasher()
    now, base = None, []
    for batch in batches:
        lead, salt, member, ids = (batch.column(c).to_pylist() for c in range(4))
        texts = batch.column(4)
        out_a, out_b = [], []
        for i, j in kernels.slices(texts, SLICE):
            raw, at = kernels.bytes_of(texts.slice(i, j - i))
            sets = kernels.shingles(*hasher.words(raw, at), j - i, k)
            for r in range(i, j):
                if (lead[r], salt[r]) != now:
                    now, base = (lead[r], salt[r]), []
                s = sets[r - i]
                if not member[r]:
                    base.append(s)
                    continue
                for other in base:  # more than one only where an id is repeated
                    both = len(np.intersect1d(s, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(s) + len(other) - both):
                        out_a.append(lead[r])
                        out_b.append(ids[r])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def listed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(shingle, id) of every text's set."""
    hasher = kernels.WordHasher()
    for batch in batches:
        for i, j in kernels.slices(batch.column(1), SLICE):
            raw, at = kernels.bytes_of(batch.column(1).slice(i, j - i))
            sets = kernels.shingles(*hasher.words(raw, at), j - i, k)
            own = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(own)], ["shingle", "id"])


def tallied(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(rep, all: the set's shingles by class)."""
    hasher = kernels.WordHasher()
    for batch in batches:
        for i, j in kernels.slices(batch.column(1), SLICE):
            raw, at = kernels.bytes_of(batch.column(1).slice(i, j - i))
            sets = kernels.shingles(*hasher.words(raw, at), j - i, k)
            counts = [np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).astype(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.list_(pa.int32()))], ["rep", "all"])


def with_common(docs: DataFrame, held: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """held (key, rep, n) with ``common``: by classes of shingles, how many of a set's any other set in held has too.

    Two sets have no more in common than the sum of the smaller counts of each class. That rules most pairs out before
    they are made, and never one that is alike: in a group of edited copies, whoever is not near the copies' origin has
    too many shingles of its own, or has lost others than its like.
    """
    reps = written(held.select(F.col("rep").alias("id")).distinct().join(repeated, "id", "left_anti"))
    few = reps.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(reps) if few else reps, "id").select("id", "text")
    every = written(held.select(F.col("rep").alias("id")).distinct()) if repeated.head(1) else reps
    known = docs.join(F.broadcast(every) if few else every, "id").select("id", "text")
    alone = known.mapInArrow(kernels.lean(lambda x: listed(x, k)), "shingle bigint, id bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep")).where("c = 1")
    alone = alone.groupBy("rep", F.col("shingle").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("class")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    alone = alone.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("class", "c"))).alias("alone"))
    totals = texts.mapInArrow(kernels.lean(lambda x: tallied(x, k)), "rep bigint, all array<int>")
    common = F.when(F.col("alone").isNull(), F.col("all")).otherwise(F.transform("all", lambda n, i: n - F.coalesce(F.element_at("alone", i), F.lit(0))))
    counted = written(totals.join(alone, "rep", "left").select("rep", common.alias("common")))
    return held.join(counted, "rep", "left").select("key", "rep", "n", "common")


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table that are alike on full sets. docs: (id, text)."""
    groups = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    members = pairs.join(groups, "a").select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("id"))
    leads = groups.select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("id"))
    need = written(members.unionByName(leads))
    few = need.count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(need) if few else need, "id").select("lead", "salt", "member", "id", "text")
    joined = joined.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")
    return written(joined.mapInArrow(kernels.lean(lambda x: compared(x, k, percent)), "a bigint, b bigint").distinct())


def _united(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (rep, comp) after uniting the components that links (a, b) touch; reps without a row are their own."""
    if labels is not None:
        links = _labelled(links, labels, "a")
        links = _labelled(links, labels, "b")
    roots = components(links.select("a", "b"))
    if labels is None:
        return roots.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    moved = labels.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    new = roots.join(labels.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    return written(moved.unionByName(new))


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    return rows.join(labels.select(F.col("rep").alias(column), F.col("comp").alias("_c")), column, "left").withColumn(column, F.coalesce("_c", column)).drop("_c")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permutations: int = 120, rows: int = 5, k: int = 5, percent: int = 75, mark: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each row of docs; with mark, a string column of docs, that too."""
    with scratch() as stays:
        return _components(docs, id_col, text_col, permutations, rows, k, percent, mark, stays)


def _components(docs: DataFrame, id_col: str, text_col: str, permutations: int, rows: int, k: int, percent: int, mark: str | None, stays: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rowed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), (F.col(mark) if mark else F.lit(None)).cast("string").alias("row"))
    texts = rowed.select("id", "text")
    kinds = "id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, row string"
    signed = stays(written(rowed.mapInArrow(kernels.lean(lambda x: signatures(x, permutations, rows, k)), kinds)))
    classes = written(signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")))
    firsts = signed.where("n_shingles > 0 and id is not null").join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"], "left_semi")
    keyed = firsts.dropDuplicates(["id", "d1", "d2"]).select("id", F.col("n_shingles").alias("n"), "bands").select(F.col("id").alias("rep"), "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    held = written(keyed.join(shared, "key").select("key", "lead", "rep", "n"))

    def possible(x: str, y: str) -> Column:
        """Whether sizes and common shingles allow the similarity. Ids that stand for several texts have no bound."""
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        most = F.aggregate(F.zip_with(f"{x}.common", f"{y}.common", lambda a, b: F.least(a, b)), F.lit(0), lambda t, c: t + c)
        return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & F.coalesce((100 + percent) * most >= percent * (nx + ny), F.lit(True))

    votes = held.where("lead < rep").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("votes"))
    pairs = written(votes.groupBy("rep").agg(F.max_by("lead", F.struct("votes", -F.col("lead"))).alias("a")).select("a", F.col("rep").alias("b")))
    tried = pairs
    labels = _united(None, confirmed(texts, pairs, k, percent))
    share, counted = 16, False
    repeated = signed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    while True:
        live = _labelled(held.select("*", F.col("rep").alias("comp")).drop("lead"), labels, "comp")
        mixed = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi").select("key", "members")
        left = written(live.join(mixed, "key"))
        if not left.head(1):
            break
        if not counted:
            counted = True
            held = written(with_common(texts, left.select("key", "rep", "n"), repeated, k))
            continue
        step = F.greatest(F.floor(F.col("members") / share), F.lit(1))
        leads = left.where(F.pmod(F.xxhash64("rep", "key"), step) == 0)
        x, y = leads.alias("x"), left.alias("y")
        new = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & possible("x", "y"))
        new = new.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        new = written(new.join(tried, ["a", "b"], "left_anti"))
        if new.head(1):
            labels = _united(labels, confirmed(texts, new, k, percent))
            tried = tried.unionByName(new)
        if not left.where(F.col("members") >= 2 * share).head(1):
            break
        drop(held)
        held, share = left.select("key", "rep", "n", "common"), share * 4
    known = stays(written(_labelled(classes.select("d1", "d2", F.col("rep").alias("comp")), labels, "comp")))
    out = signed.select("id", "n_shingles", "d1", "d2", "row").join(known, ["d1", "d2"], "left")
    first = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", first.alias("component_id"), same(F.col("id"), first).alias("kept"), *([F.col("row").alias(mark)] if mark else []))
