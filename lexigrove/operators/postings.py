"""An inverted index over the text fields of documents, as Parquet tables that grow by segments.

A segment holds, for the documents it was made from and for good,

* ``postings``: for each (term, field, document) how often and where the term stands, and how long the field is. They are
  kept as lists, a row for each (term, field) of a piece of a task's documents. When a segment is written, what a piece has
  for a group of folders moves as one packed row, and lists are sorted, not their postings. Rows lie in folders by a checksum of the term and are sorted by it, so a
  query opens the folders of its own terms and reads their pages. Folders follow the bytes of text; one that a very common
  term makes large is split over files.
* ``words``: the vocabulary, (field, term, documents, tokens), sorted by term.
* ``keys``: the columns that name a document, and the file it came from.

New documents make a new segment, and no old one is touched. Deleted and replaced documents are named by key and taken
off what older segments give, and what they had in the vocabulary is taken off its counts, so all statistics are those
of the documents that are left. Four segments of about one size are merged, from their postings and without their texts.
Which segments and deletions are valid is one version of a commit log (``tables.TableLog``).

Wildcards and fuzzy words are looked up in the vocabulary, never in the postings: by the letters before the first
wildcard, by groups of three letters, or by what is left of a word when letters are taken out. The last two tables are
made by the first query that needs them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexigrove.functions.analysis import LONGEST, py_folded, py_words
from lexigrove.operators.tables import State, TableLog, _files, _path, put_new
from lexigrove.session import checkpointed, shared_folder

#: Bytes of text for a folder of postings, and the fewest and most folders of a segment (6 GB of text each at 100 TB).
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4 << 20, 32, 1 << 14
#: Queries with more terms read all folders.
MOST_PRUNED = 1000
#: Segments of one size that are merged, and how much larger the next size is.
TIER = 4
#: Text of fewer bytes a core is dealt out before it is analysed.
SPREAD = 64 << 20
#: In a search for many queries: documents of a chunk, queries of a task, and the fewest documents that make a chunk of their own where cores are idle.
CHUNK, ASKED, LEAST_CHUNK = 8192, 1 << 18, 512
#: Chunks of a task, postings that are packed at once, and asked terms whose hashes are broadcast, to leave out postings before they move.
MOST_CHUNKS, SENT, MOST_HASHED = 128, 1_500_000, 1 << 20
#: Scores that differ by less may be equal once they are rounded.
SLACK = 2e-6
#: Raw words whose terms a task remembers.
CACHE = 500_000
#: Postings of a piece, whose lists of a term are one row, and the most postings of such a row.
PIECE, LIST = 400_000, 4096
#: Folders that one task writes, and lists that it unpacks at once.
FOLDERS, UNPACKED = 4, 20_000


def tokenised(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], fields: tuple[str, ...], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Lists of postings of batches of documents, whose columns are keys, then fields, packed by the task that writes them."""
    pieces = itertools.count(TaskContext.get().partitionId())

    class Terms(dict):
        def __missing__(self, word: str) -> str:
            out = py_folded(word) if len(word.encode()) < LONGEST else ""
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
            return out

    terms_of = Terms()
    for batch in batches:
        rows, names, terms, counts, lengths, places = [], [], [], [], [], []
        for i, name in enumerate(fields):
            for row, text in enumerate(batch.column(len(keys) + i).to_pylist()):
                found: dict[str, list[int]] = {}
                for at, term in enumerate(map(terms_of.__getitem__, py_words(text or ""))):
                    if term in found:
                        found[term].append(at)
                    else:
                        found[term] = [at]
                found.pop("", None)
                n = [len(x) for x in found.values()]
                rows += [row] * len(n)
                names += [i] * len(n)
                terms += found
                counts += n
                lengths += [sum(n)] * len(n)
                places.append(list(itertools.chain.from_iterable(found.values())))
                if len(terms) > PIECE or (i + 1 == len(fields) and row + 1 == batch.num_rows):
                    yield _packed(_posted(batch, keys, fields, buckets, rows, names, terms, counts, lengths, places), groups, next(pieces))
                    rows, names, terms, counts, lengths, places = [], [], [], [], [], []
        if terms:
            yield _packed(_posted(batch, keys, fields, buckets, rows, names, terms, counts, lengths, places), groups, next(pieces))


def _posted(batch: pa.RecordBatch, keys: tuple, fields: tuple, buckets: int, rows: list, names: list, terms: list, counts: list, lengths: list, places: list) -> pa.RecordBatch:
    """The postings of a piece as lists by term and field, documents in their order."""
    numbers: dict[str, int] = {}
    kind = np.fromiter((numbers.setdefault(t, len(numbers)) for t in terms), np.int64, len(terms)) * len(fields) + np.array(names, np.int64)
    order = np.argsort(kind, kind="stable")
    kind, n = kind[order], np.array(counts, np.int32)
    begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(kind))
    begins = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b, LIST) for a, b in zip(begins[ends - begins > LIST], ends[ends - begins > LIST], strict=True)), begins[ends - begins <= LIST]])
    begins.sort()
    flat = np.fromiter(itertools.chain.from_iterable(places), np.int32, int(n.sum()))
    at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
    taken, place = pa.array(np.array(rows, np.int64)[order]), pa.array(order)
    own = [*(batch.column(i).take(taken) for i in range(len(keys))), pa.array(n[order]), pa.array(np.array(lengths, np.int32)[order]), at.take(place)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(kind)).astype(np.int32)), pa.StructArray.from_arrays(own, [*keys, "n", "length", "places"]))
    held, crc = pa.array(list(numbers), pa.string()), zlib.crc32
    bucket = pa.array(np.array([crc(t.encode()) % buckets for t in numbers], np.int32))
    term, name = pa.array(kind[begins] // len(fields)), pa.array(kind[begins] % len(fields))
    documents, tokens = np.diff(np.append(begins, len(kind))), np.add.reduceat(n[order].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
    cols = [pa.array(fields, pa.string()).take(name), held.take(term), pa.array(documents.astype(np.int64)), pa.array(tokens), lists, bucket.take(term)]
    return pa.RecordBatch.from_arrays(cols, ["field", "term", "documents", "tokens", "lists", "bucket"])


def _packed(lists: pa.RecordBatch, groups: int, piece: int) -> pa.RecordBatch:
    """(task, packed): the lists of a piece by the group of folders that they go to.

    A list that is longer than a group's share of a piece goes to as many groups in turn as it has shares, so the
    postings of a very common term are dealt out too.
    """
    shares = -(-lists.column(2).to_numpy() * groups // PIECE)
    task = (lists.column(5).to_numpy() % groups + piece % np.maximum(shares, 1)) % groups
    order = np.argsort(task, kind="stable")
    lists, task = lists.take(pa.array(order)), task[order]
    cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)] if len(task) else [0]
    whole = [lists.slice(i, j - i).serialize() for i, j in itertools.pairwise(cuts)]
    blobs = [pa.compress(b, "zstd", asbytes=True) for b in whole]
    return pa.RecordBatch.from_arrays([pa.array(task[cuts[:-1]].astype(np.int32)), pa.array([b.size for b in whole], pa.int64()), pa.array(blobs, pa.binary())], ["task", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for size, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.append(pa.ipc.read_record_batch(pa.decompress(packed.as_buffer(), size, "zstd"), schema))
            if sum(b.num_rows for b in held) >= UNPACKED:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def left_out(term: str, most: int) -> set[str]:
    """The term, and what is left when up to ``most`` of its letters are taken out."""
    out = last = {term}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def grams(padded: str) -> list[str]:
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _left_out_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, t) for t in batch.column(0).to_pylist() for v in left_out(t, most)]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in rows], pa.string()) for i in (0, 1)], ["part", "term"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(g, t) for t in batch.column(0).to_pylist() for g in set(grams(f"^{t}$"))]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in rows], pa.string()) for i in (0, 1)], ["part", "term"])


def _head(pattern: str) -> str:
    return next((pattern[:i] for i, c in enumerate(pattern) if c in "*?"), pattern)


def _regex(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c) for c in pattern) + "$"


@dataclass
class TextIndex:
    """One version of an index. keys: the columns that name a document; fields: the search fields."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    schema: T.StructType
    state: State

    @property
    def log(self) -> TableLog:
        return TableLog(self.spark, self.path)

    def current(self) -> TextIndex:
        return TextIndex(self.spark, self.path, self.keys, self.fields, self.schema, self.log.state())

    # Reading.

    def _live(self, kind: str) -> dict[str, dict]:
        return {name: about for name, about in self.state.live.items() if about["kind"] == kind}

    def _read(self, name: str, what: str, kinds: str | T.StructType) -> DataFrame:
        return self.spark.read.schema(kinds).parquet(f"{self.path}/data/{name}/{what}")

    def _union(self, parts: Iterable[DataFrame], kinds: str | T.StructType) -> DataFrame:
        parts = list(parts)
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kinds)

    def _left(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of a segment of some version without those of documents that went later."""
        gone = [name for name, about in self._live("gone").items() if about["version"] > version]
        if not gone:
            return rows
        keys = self._union((self._read(name, "keys", self.schema) for name in gone), self.schema).distinct()
        return rows.join(keys, functools.reduce(lambda a, b: a & b, (rows[k].eqNullSafe(keys[k]) for k in self.keys)), "left_anti")

    def _left_lists(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of lists of a segment without the postings of documents that went later."""
        if not any(about["version"] > version for about in self._live("gone").values()):
            return rows
        one = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "field", "term", F.inline("lists"))
        own = F.struct(*(f.name for f in self._list_kinds()["lists"].dataType.elementType.fields))
        found = self._left(one, version).groupBy("_row", "field", "term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.collect_list(own).alias("lists"))
        return found.drop("_row")

    @property
    def _posting_kinds(self) -> T.StructType:
        word, number = T.StringType(), T.IntegerType()
        more = [("field", word), ("term", word), ("n", number), ("length", number), ("places", T.ArrayType(number))]
        return T.StructType([*self.schema.fields, *(T.StructField(c, kind) for c, kind in more)])

    def _list_kinds(self, *columns: str) -> T.StructType:
        """What rows of lists are read as; columns: those of a posting, all if none is named."""
        own = T.StructType([f for f in self._posting_kinds.fields if f.name not in ("field", "term") and (not columns or f.name in columns)])
        return T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("lists", T.ArrayType(own))])

    @property
    def _rows_kinds(self) -> T.StructType:
        """The columns of the files of lists."""
        field, term, lists = self._list_kinds().fields
        return T.StructType([field, term, T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType()), lists])

    def _each(self, rows: DataFrame) -> DataFrame:
        """Rows of lists as a row for each posting."""
        found = rows.select("field", "term", F.inline("lists"))
        return found.select(*(f.name for f in self._posting_kinds.fields if f.name in found.columns))

    def postings(self, terms: Iterable[str] | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """All postings, or those of some terms, from the folders that these are in; with columns, only these are read of a posting beside its keys."""
        kinds, parts = self._list_kinds(*((*self.keys, *columns) if columns else ())), []
        wanted = None if terms is None else sorted(set(terms))
        for name, about in self._live("segment").items():
            folder = f"{self.path}/data/{name}/postings"
            if wanted is not None and len(wanted) <= MOST_PRUNED:
                own = {f"{folder}/bucket={zlib.crc32(t.encode()) % about['buckets']}" for t in wanted}
                fs = _files(self.spark, self.path)
                own = sorted(p for p in own if fs.exists(_path(self.spark, p)))
                if not own:
                    continue
                rows = self.spark.read.schema(kinds).option("basePath", folder).parquet(*own).drop("bucket")
            else:
                rows = self.spark.read.schema(kinds).parquet(folder).drop("bucket")
            parts.append(self._left(self._each(rows if wanted is None else rows.where(F.col("term").isin(wanted))), about["version"]))
        return self._union(parts, T.StructType([f for f in self._posting_kinds.fields if not columns or f.name in (*self.keys, "field", "term", *columns)]))

    def with_terms(self, terms: Iterable[str], patterns: tuple[str, ...] = ()) -> DataFrame:
        """The postings of some terms, and of those that a pattern matches whole; patterns are held against the terms of all folders."""
        if not patterns:
            return self.postings(terms)
        wanted = F.col("term").isin(sorted(set(terms)))
        for pattern in patterns:
            wanted |= F.col("term").startswith(_head(pattern)) & F.col("term").rlike(_regex(pattern))
        return self.postings().where(wanted)  # goes below the lists, to the files

    def _numbered(self, terms: DataFrame | None, *columns: str) -> DataFrame:
        """Postings as (row: a number of their list, field: its place, term, key columns, columns); terms: the hashes h of the wanted ones, which are broadcast, None for all."""
        field, parts = F.coalesce(*(F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(self.fields))).cast("tinyint"), []
        for name, about in self._live("segment").items():
            rows = self._read(name, "postings", self._list_kinds(*self.keys, *columns))
            if terms is not None:
                rows = rows.withColumn("h", F.xxhash64("term")).join(F.broadcast(terms), "h", "left_semi")
            rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", field.alias("field"), "term", F.inline("lists"))
            parts.append(self._left(rows, about["version"]).select("row", "field", "term", *self.keys, *columns))
        kinds = T.StructType([f for f in self._posting_kinds.fields if f.name in (*self.keys, *columns)])
        return self._union(parts, T.StructType([T.StructField("row", T.LongType()), T.StructField("field", T.ByteType()), T.StructField("term", T.StringType()), *kinds.fields]))

    def words(self) -> DataFrame:
        """(field, term, documents, tokens) over the documents that are left."""
        kinds = "field string, term string, documents bigint, tokens bigint"
        segments, gone = self._live("segment"), self._live("gone")
        parts = [self._read(name, "words", kinds) for name in segments]
        if len(parts) == 1 and not gone:
            return parts[0]
        for name in gone:
            off = self._read(name, "words", f"segment string, {kinds}").where(F.col("segment").isin(list(segments)))
            parts.append(off.select("field", "term", (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
        found = self._union(parts, kinds).groupBy("field", "term").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return found.where("documents > 0")

    def rows(self) -> DataFrame:
        """The keys of all documents."""
        return self._union((self._left(self._read(name, "keys", self.schema), about["version"]) for name, about in self._live("segment").items()), self.schema)

    def of_files(self, files: list[str]) -> DataFrame:
        """The keys of the documents that came from some files."""
        with_file = T.StructType([*self.schema.fields, T.StructField("_file", T.StringType())])
        return self._union((self._read(name, "keys", with_file).where(F.col("_file").isin(files)) for name in self._live("segment")), with_file).select(*self.keys)

    def totals(self) -> dict[str, tuple[int, int]]:
        """(documents, tokens) by field."""
        own = {f: [0, 0] for f in self.fields}
        segments = self._live("segment")
        for sign, about in [*((1, a) for a in segments.values()), *((-1, a) for g in self._live("gone").values() for s, a in g["of"].items() if s in segments)]:
            for f in self.fields:
                own[f][0] += sign * about["documents"]
                own[f][1] += sign * about["tokens"].get(f, 0)
        return {f: (d, t) for f, (d, t) in own.items()}

    # Words that a pattern stands for.

    def _part_table(self, segment: str, what: str) -> DataFrame:
        """(part, term) of a segment's vocabulary, sorted by part; made once, by whoever is first."""
        note = f"{self.path}/data/{segment}/{what}.json"
        fs = _files(self.spark, note)
        if not fs.exists(_path(self.spark, note)):
            terms = self._read(segment, "words", "field string, term string").select("term").distinct()
            make = _gram_rows if what == "grams" else functools.partial(_left_out_rows, most=int(what[-1]))
            made = f"{what}-{uuid.uuid4().hex}"
            terms.mapInArrow(make, "part string, term string").repartition("part").sortWithinPartitions("part").write.option("compression", "zstd").parquet(f"{self.path}/data/{segment}/{made}")
            put_new(self.spark, note, json.dumps(made))
        stream = fs.open(_path(self.spark, note))
        try:
            made = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return self._read(segment, made, "part string, term string")

    def prepare(self) -> None:
        """Makes the tables for wildcards without a beginning and for fuzzy words ahead of the queries."""
        for name, what in itertools.product(self._live("segment"), ("grams", "near1")):
            self._part_table(name, what)

    def _found(self, candidates: DataFrame, matches: Column, most: int) -> tuple[list[str], int]:
        """The matching terms of some candidates, and how many candidates there are, ``most`` and one at most."""
        if self._live("gone"):  # a term that no document has any more is none
            candidates = candidates.join(self.words().select("term").distinct(), "term", "left_semi")
        row = candidates.select("term").distinct().limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(matches, F.col("term")))).alias("terms")).first()
        return list(row.terms), row.n

    def like(self, pattern: str, most: int) -> tuple[list[str], int]:
        """The terms that a pattern of letters, ``*`` and ``?`` matches whole, and how many were looked at."""
        head, regex = _head(pattern), _regex(pattern)
        segments = self._live("segment")
        parts = sorted({g for run in f"^{pattern}$".replace("?", "*").split("*") for g in grams(run)})
        if head or not parts:
            rows = (self._read(name, "words", "field string, term string").select("term") for name in segments)
            if head:
                rows = (r.where(F.col("term").startswith(head)) for r in rows)
        else:
            rows = (self._part_table(name, "grams").where(F.col("part").isin(parts)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).select("term") for name in segments)
        return self._found(self._union(rows, "term string"), F.col("term").rlike(regex), most)

    def near(self, term: str, distance: int, most: int) -> tuple[list[str], int]:
        """Terms that may be within a distance of letters put in, left out, changed, or swapped with the next: all that are, and others; and how many."""
        parts = sorted(left_out(term, distance))
        rows = (self._part_table(name, f"near{distance}").where(F.col("part").isin(parts)).select("term") for name in self._live("segment"))
        return self._found(self._union(rows, "term string"), F.lit(True), most)

    # Writing.

    def _segment(self, docs: DataFrame, fields: dict[str, str]) -> tuple[str, dict]:
        """Writes a segment of docs; its name and what an entry tells about it."""
        name = uuid.uuid4().hex
        size = docs.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in fields.values()), F.lit(0))).alias("n")).first().n or 0
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET))
        keys, own = self.keys, self.fields
        texts = docs.select(*keys, *(F.col(fields[f]).cast("string").alias(f"_text_{i}") for i, f in enumerate(own)))
        cores = self.spark.sparkContext.defaultParallelism
        if size < cores * SPREAD:  # few files or row groups would leave most cores idle
            texts = texts.repartition(cores)
        kinds, groups = T.StructType([*self._rows_kinds.fields, T.StructField("bucket", T.IntegerType())]), -(-buckets // FOLDERS)
        schema = to_arrow_schema(kinds)
        packed = texts.mapInArrow(lambda x: tokenised(x, keys, own, buckets, groups), "task int, size bigint, packed binary")
        rows = packed.repartitionById(groups, F.col("task")).select("size", "packed").mapInArrow(lambda x: _unpacked(x, schema), kinds)
        file = [F.col("_file").cast("string").alias("_file")] if "_file" in docs.columns else [F.lit(None).cast("string").alias("_file")]
        docs.select(*keys, *file).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/keys")
        return name, self._finish(name, rows, buckets, size)

    def _finish(self, name: str, rows: DataFrame, buckets: int, size: int) -> dict:
        """Writes postings and the vocabulary of a segment whose keys are written; rows of a folder are together in few partitions."""
        rows.sortWithinPartitions("bucket", "term", "field").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{name}/postings")
        kept = self.spark.read.schema("field string, term string, documents bigint, tokens bigint").parquet(f"{self.path}/data/{name}/postings")
        words = kept.groupBy("field", "term").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        words.sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/words")
        tokens = {r.field: r.tokens for r in self._read(name, "words", "field string, tokens bigint").groupBy("field").agg(F.sum("tokens").alias("tokens")).collect()}  # a row for each field
        return {"kind": "segment", "buckets": buckets, "bytes": size, "documents": self._read(name, "keys", self.schema).count(), "tokens": tokens}

    def _gone(self, keys: DataFrame) -> tuple[str, dict] | None:
        """Writes which documents go, and what each segment's counts lose by it; None where the index has none of them."""
        own = keys.select(*self.keys).distinct()
        on = lambda rows: functools.reduce(lambda a, b: a & b, (rows[k].eqNullSafe(own[k]) for k in self.keys))
        name, of, segments = uuid.uuid4().hex, {}, self._live("segment")
        held = [self._left(self._read(s, "keys", self.schema), about["version"]).withColumn("segment", F.lit(s)) for s, about in segments.items()]
        if not held:
            return None
        every = functools.reduce(DataFrame.unionByName, held)
        every.join(own, on(every), "left_semi").write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/keys")
        counts = {r.segment: r.n for r in self._read(name, "keys", "segment string").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a segment
        if not counts:
            self.log.discard(name)
            return None
        own = self._read(name, "keys", self.schema).distinct()
        parts = []
        for s in counts:
            rows = self._left(self._each(self._read(s, "postings", self._list_kinds(*self.keys, "n"))), segments[s]["version"])
            parts.append(rows.join(own, on(rows), "left_semi").groupBy("field", "term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens")).withColumn("segment", F.lit(s)))
        functools.reduce(DataFrame.unionByName, parts).sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/words")
        for r in self._read(name, "words", "segment string, field string, tokens bigint").groupBy("segment", "field").agg(F.sum("tokens").alias("tokens")).collect():  # segments times fields
            of.setdefault(r.segment, {"documents": counts[r.segment], "tokens": {}})["tokens"][r.field] = r.tokens
        for s, n in counts.items():
            of.setdefault(s, {"documents": n, "tokens": {}})
        return name, {"kind": "gone", "of": of}

    def _commit(self, make) -> TextIndex:
        """make: from the current index, what to add and what to take out of an entry; None for nothing."""
        while True:
            now = self.current()
            change = make(now)
            if change is None:
                return now
            added, dropped, files = change
            number = now.state.version + 1
            live = {n: a for n, a in now.state.live.items() if n not in dropped}
            live |= {n: about | {"version": number} for n, about in added}
            oldest = min((a["version"] for a in live.values() if a["kind"] == "segment"), default=number)
            live = {n: a for n, a in live.items() if a["kind"] == "segment" or a["version"] > oldest}  # deletions that touch nothing any more go
            if self.log.put(State(number, live, about={"files": files} if files is not None else now.state.about)):
                return self.current()
            for n, _ in added:
                self.log.discard(n)

    def add(self, docs: DataFrame, fields: dict[str, str], replace: bool = True) -> TextIndex:
        """The index with docs as a new segment; documents of the same keys go, unless ``replace`` is off because there are none."""

        def make(now: TextIndex):
            made = now._segment(docs, fields)
            gone = now._gone(docs) if replace else None
            return [made, *([gone] if gone else [])], (), None

        return self._commit(make).merge()

    def delete(self, keys: DataFrame) -> TextIndex:
        def make(now: TextIndex):
            gone = now._gone(keys)
            return ([gone], (), None) if gone else None

        return self._commit(make)

    def merge(self, every: bool = False) -> TextIndex:
        """Merges segments of one size, where there are enough of them; all, with ``every``."""

        def make(now: TextIndex):
            tiers: dict[int, list[str]] = {}
            segments = now._live("segment")
            for name, about in segments.items():
                tiers.setdefault(0 if every else int(math.log(max(about["bytes"], 1), TIER)), []).append(name)
            full = next((own for own in tiers.values() if len(own) >= (1 if every else TIER)), None)
            if full is None or (every and len(full) < 2 and not now._live("gone")):
                return None
            name, size = uuid.uuid4().hex, sum(segments[s]["bytes"] for s in full)
            buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET))
            with_file = T.StructType([*now.schema.fields, T.StructField("_file", T.StringType())])
            functools.reduce(DataFrame.unionByName, (now._left(now._read(s, "keys", with_file), segments[s]["version"]) for s in full)).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/keys")
            rows = functools.reduce(DataFrame.unionByName, (now._left_lists(now._read(s, "postings", now._rows_kinds), segments[s]["version"]) for s in full))
            rows = rows.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int"))
            return [(name, now._finish(name, rows.hint("rebalance", "bucket"), buckets, size))], tuple(full), None

        before = self.state.version
        done = self._commit(make)
        return done.merge() if done.state.version > before and not every else done


def build(docs: DataFrame, keys: tuple[str, ...], fields: dict[str, str], path: str) -> TextIndex:
    """Writes the index of docs (a row for each document) to path, in place of what is there."""
    index = TextIndex(docs.sparkSession, path, keys, tuple(fields), docs.select(*keys).schema, State())
    return index._commit(lambda now: ([now._segment(docs, fields)], tuple(now.state.live), {}))


def _listed(source: DataFrame) -> dict[str, str]:
    """Length and time of each file of source, one listing a folder."""
    spark, found = source.sparkSession, {}
    names = set(source.inputFiles())
    for folder in sorted({n.rpartition("/")[0] for n in names}):
        for s in _files(spark, folder).listStatus(_path(spark, folder)):
            found[f"{folder}/{s.getPath().getName()}"] = f"{s.getLen()} {s.getModificationTime()}"
    decoded = lambda n: _path(spark, n).toUri().getPath()
    by_path = {decoded(n): about for n, about in found.items()}
    return {n: by_path.get(decoded(n), "") for n in names}


def opened(source: DataFrame, docs: DataFrame, keys: tuple[str, ...], fields: dict[str, str], folder: str | None = None) -> TextIndex:
    """The index of docs, which are derived row by row from the files of source, brought up to date with these files.

    New files make a segment; the documents of files that went or changed are deleted. An index belongs to the folders
    that the files are in.
    """
    spark, files = docs.sparkSession, _listed(source)
    roots = sorted({n.rpartition("/")[0] for n in files})
    name = hashlib.sha256(repr((roots, keys, sorted(fields.items()), "lists", docs.select(*keys, *fields.values()).columns)).encode()).hexdigest()[:32]
    path = f"{folder or shared_folder(spark)}/lexigrove-index/{name}"
    index = TextIndex(spark, path, keys, tuple(fields), docs.select(*keys).schema, State()).current()

    def make(now: TextIndex):
        known = now.state.about.get("files", {})
        if known == files and now.state.version:
            return None
        new = [n for n in files if known.get(n) != files[n]]
        old = [n for n in known if known[n] != files.get(n)]
        added = []
        own = docs.withColumn("_file", F.input_file_name())
        if not known:
            added.append(now._segment(own, fields))
        elif new:
            added.append(now._segment(own.where(F.col("_file").isin(new)), fields))
        if old:
            gone = now._gone(now.of_files(old))
            added += [gone] if gone else []
        return added, (), files

    done = index._commit(make)
    return done.merge() if done.state.version > index.state.version else done


def search_many(index: TextIndex, queries: DataFrame, n: int, boosts: dict[str, float], k1: float = 1.2, b: float = 0.75, key: str | None = None) -> DataFrame:
    """(query_id, key columns, score, rank): the n best documents by BM25 for any of a query's terms, for all queries in one plan.

    queries: (query_id, term), terms as the analyzer gives them. Postings move once, packed, to chunks of documents. A task
    has a range of chunks and a block of queries, goes through its chunks one by one, and keeps the n best of each query so
    far, so what moves grows with the postings and with the queries, not with their product. Chunks in which a query's terms
    cannot give what its n-th best has are passed over. Work is queries times the postings of their terms at most. Ties go by
    ``key`` and then by all keys.
    """
    spark, totals = index.spark, index.totals()
    mean = [t / d if d and t else 1.0 for d, t in (totals[f] for f in index.fields)]
    n_docs = max((d for d, _ in totals.values()), default=0)
    cores = spark.sparkContext.defaultParallelism
    chunks = max(math.ceil(n_docs / CHUNK), min(2 * cores, n_docs // LEAST_CHUNK), 1)
    ranges = max(min(chunks, 2 * cores), math.ceil(chunks / MOST_CHUNKS))
    ties = [*([key] if key else []), *(k for k in index.keys if k != key)]
    asked = checkpointed(queries.select("query_id", "term").distinct())
    blocks = max(math.ceil(asked.agg(F.count_distinct("query_id")).first()[0] / ASKED), 1)
    hashed = asked.select(F.xxhash64("term").alias("h")).distinct()
    terms = hashed if hashed.count() <= MOST_HASHED else None
    words = index.words().select("field", "term", "documents").join(asked.select("term").distinct(), "term", "left_semi")
    idf = F.log1p((F.lit(float(n_docs)) - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
    weights = words.groupBy("term").agg(F.array(*(F.sum(F.when(F.col("field") == f, idf * float(boosts[f])).otherwise(0.0)) for f in index.fields)).alias("w"))
    lists = asked.join(weights, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("wants"))
    keys = index.rows().distinct()
    place = _places(keys, index.keys, chunks)
    docs = keys.select(place(*index.keys).alias("place"), *index.keys)
    kinds, asking, naming = "task int, chunk int, size bigint, packed binary", to_arrow_schema(lists.schema), to_arrow_schema(docs.schema)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    sent = lists.select(block, "query_id", "wants").mapInArrow(lambda x: _sent_queries(x, ranges, blocks), kinds)
    sent = sent.unionByName(docs.mapInArrow(lambda x: _sent_keys(x, chunks, ranges, blocks), kinds))
    given = index._numbered(terms, "n", "length").select("row", "field", "term", place(*index.keys).alias("place"), "n", "length")
    sent = sent.unionByName(given.mapInArrow(lambda x: _sent_postings(x, chunks, ranges, blocks), kinds))
    sent = sent.repartitionById(ranges * blocks, F.col("task")).sortWithinPartitions("task", "chunk")
    found = T.StructType([queries.schema["query_id"], *index.schema.fields, T.StructField("score", T.DoubleType())])
    scored = sent.mapInArrow(lambda x: _best(x, n, asking, naming, ties, chunks, mean, k1, b), found).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(F.asc(k) for k in ties))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _places(rows: DataFrame, keys: tuple[str, ...], chunks: int):
    """A hash of keys, as an expression, by which the documents of a chunk are told apart (see _place)."""
    for seed in range(100):
        place = lambda *own: F.xxhash64(F.lit(seed), *own, *(k.isNull() if isinstance(k, Column) else F.col(k).isNull() for k in own))  # noqa: B023, E731
        h = place(*keys)
        if rows.groupBy(F.pmod(h, F.lit(chunks)), F.shiftrightunsigned(h, 16)).count().where("count > 1").isEmpty():
            return place
    raise ValueError("documents of the index have no distinct hashes")


def _place(h: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk, and 48 bits that no other document of the chunk has."""
    return np.mod(h, chunks), h.view(np.uint64) >> np.uint64(16)


def _sent(out: list[tuple[int, int, pa.RecordBatch]]) -> pa.RecordBatch:
    whole = [b.serialize() for *_, b in out]
    blobs = [pa.compress(b, "zstd", asbytes=True) for b in whole]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([b.size for b in whole], pa.int64()), pa.array(blobs, pa.binary())], ["task", "chunk", "size", "packed"])


def _parted(batch: pa.RecordBatch, part: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist() if len(part) else []
    batch = batch.take(pa.array(order))
    for i, j in itertools.pairwise(cuts):
        yield int(part[order[i]]), batch.slice(i, j - i)


def _sent_queries(batches: Iterator[pa.RecordBatch], ranges: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Queries, whose first column is their block, for the tasks of all ranges."""
    for batch in batches:
        for block, own in _parted(batch.select(batch.schema.names[1:]), batch.column(0).to_numpy()):
            yield _sent([(r * blocks + block, -2, own) for r in range(ranges)])


def _sent_keys(batches: Iterator[pa.RecordBatch], chunks: int, ranges: int, blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, own in _parted(batch, _place(batch.column(0).to_numpy(), chunks)[0] % ranges):
            yield _sent([(r * blocks + k, -1, own) for k in range(blocks)])


_POSTINGS = pa.schema([("term", pa.string()), ("field", pa.int8()), ("lists", pa.list_(pa.struct([("low", pa.uint32()), ("high", pa.uint16()), ("n", pa.int32()), ("length", pa.int32())])))])


def _sent_postings(batches: Iterator[pa.RecordBatch], chunks: int, ranges: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Postings (row, field, term, place, n, length), those of a list together, by chunk."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            begins = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1))
            at = pa.array(begins)
            held.append((batch.column(2).take(at), batch.column(1).take(at), np.diff(begins, append=batch.num_rows), *(batch.column(i).to_numpy() for i in (3, 4, 5))))
            size += batch.num_rows
        if not size or (batch is not None and size < SENT):
            continue
        term, field = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        each, h, n, length = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4, 5))
        held, size = [], 0
        same = np.r_[False, pa.compute.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) & (np.diff(field.to_numpy()) == 0)]  # lists of one term are neighbours
        heads = np.flatnonzero(~same)
        term, field, each = term.take(pa.array(heads)), field.take(pa.array(heads)), np.add.reduceat(each, heads)
        chunk, place = _place(h, chunks)
        order = np.argsort(chunk, kind="stable")
        of, chunk, place = np.repeat(np.arange(len(each)), each)[order], chunk[order], place[order]
        own = (place & np.uint64(0xFFFFFFFF)).astype(np.uint32), (place >> np.uint64(32)).astype(np.uint16), n[order], length[order]
        own = pa.StructArray.from_arrays([pa.array(x) for x in own], fields=list(_POSTINGS.field("lists").type.value_type))
        out, many = [], 0
        for i, j in itertools.pairwise(np.flatnonzero(np.diff(chunk, prepend=-1, append=-1)).tolist()):
            begins = np.flatnonzero(np.diff(of[i:j], prepend=-1))
            kinds, c = pa.array(of[i:j][begins]), int(chunk[i])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, j - i).astype(np.int32)), own.slice(i, j - i))
            packed = pa.RecordBatch.from_arrays([term.take(kinds), field.take(kinds), lists], schema=_POSTINGS)
            out += [(c % ranges * blocks + k, c, packed) for k in range(blocks)]
            many += j - i
            if many >= SENT // 8:
                yield _sent(out)
                out, many = [], 0
        if out:
            yield _sent(out)


class _Asked:
    """The queries of a block, and the best documents of each in the chunks so far."""

    def __init__(self, queries: pa.RecordBatch, docs: pa.RecordBatch, ties: list[str], chunks: int, n: int):
        wants = queries.column(1)
        own, self.ids, self.n, self.chunks = wants.flatten(), queries.column(0), n, chunks
        names = own.field(0).dictionary_encode()
        self.wants, self.begins = names.indices.to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(wants).to_numpy())]
        self.number = {t: k for k, t in enumerate(names.dictionary.to_pylist())}
        w = own.field(1).flatten().to_numpy()
        self.weight = np.zeros((len(self.number), len(w) // max(len(own), 1)))
        self.weight[self.wants] = w.reshape(len(own), -1)
        self.docs = docs.take(pa.compute.sort_indices(docs, sort_keys=[(k, "ascending") for k in ties], null_placement="at_start"))
        chunk, place = _place(self.docs.column(0).to_numpy(), chunks)
        order = np.lexsort((place, chunk))
        self.doc, self.chunk, self.place = order, chunk[order], place[order]
        self.score, self.kept = np.full((len(self.ids), n), -1.0), np.full((len(self.ids), n), -1)
        self.least = np.zeros(len(self.ids))  # the n-th best score, 0 where there are fewer

    def add(self, chunk: int, lists: list[pa.RecordBatch], mean: list[float], k1: float, b: float) -> None:
        first, last = np.searchsorted(self.chunk, (chunk, chunk + 1))
        places, doc = self.place[first:last], self.doc[first:last]
        parts = []
        for x in lists:  # the postings of asked terms: term, document, what the term gives it
            number = np.fromiter((self.number.get(t, -1) for t in x.column(0).to_pylist()), np.int64, x.num_rows)
            of = np.repeat(np.arange(x.num_rows), np.diff(x.column(2).offsets.to_numpy()))
            low, high, c, length = (x.column(2).flatten().field(i).to_numpy() for i in range(4))
            if (number < 0).any():
                some = np.flatnonzero(number[of] >= 0)
                of, low, high, c, length = of[some], low[some], high[some], c[some], length[some]
            field, c = x.column(1).to_numpy()[of], c.astype(np.float64)
            given = self.weight[number[of], field] * c * (k1 + 1) / (c + k1 * (1 - b + b * length / np.array(mean)[field]))
            parts.append((number[of] * len(places) + np.searchsorted(places, high.astype(np.uint64) << np.uint64(32) | low), given))
        pair, given = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if not len(pair):
            return
        order = np.argsort(pair)
        pair, given = pair[order], given[order]
        begins = np.flatnonzero(np.diff(pair, prepend=-1))
        given, term, at = np.add.reduceat(given, begins), pair[begins] // len(places), pair[begins] % len(places)
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        some, tails = term[heads], np.append(heads[1:], len(term))
        most = np.zeros(len(self.number))
        most[some] = np.maximum.reduceat(given, heads)
        bound = np.add.reduceat(most[self.wants], self.begins[:-1])
        self._met(np.flatnonzero((bound > 0) & (bound >= self.least - SLACK)), some, heads, tails, at, given, doc)

    def _met(self, alive: np.ndarray, some: np.ndarray, heads: np.ndarray, tails: np.ndarray, at: np.ndarray, given: np.ndarray, doc: np.ndarray) -> None:
        """alive: the queries that may get documents; some: the terms that the chunk has, and where each one's postings begin and end."""
        wide = {}  # of a term that many documents have, what it gives each document
        for t, i, j in zip(some.tolist(), heads.tolist(), tails.tolist(), strict=True):
            if (j - i) * 24 > len(doc):
                wide[t] = np.zeros(len(doc))
                wide[t][at[i:j]] = given[i:j]
            else:
                wide[t] = at[i:j], given[i:j]
        score, n = np.zeros(len(doc)), self.n
        for first in range(0, len(alive), 4096):
            asked, hits, scores = alive[first : first + 4096], [], []
            for i, j, least in zip(self.begins[asked].tolist(), self.begins[asked + 1].tolist(), self.least[asked].tolist(), strict=True):
                score[:] = 0
                for t in self.wants[i:j].tolist():
                    own = wide.get(t)
                    if own is None:
                        continue
                    if type(own) is tuple:
                        score[own[0]] += own[1]
                    else:
                        score += own
                hit = np.flatnonzero(score >= least - SLACK) if least > SLACK else np.flatnonzero(score)
                if len(hit) > n:  # all that may round to the n-th score or above
                    hit = hit[score[hit] >= np.partition(score[hit], -n)[-n] - SLACK]
                hits.append(hit)
                scores.append(score[hit])
            self._kept(asked, np.array([len(x) for x in hits]), doc[np.concatenate(hits)], np.concatenate(scores))

    def _kept(self, asked: np.ndarray, each: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """The n best of what some queries have and of what each of them gets."""
        some, n = np.flatnonzero(each), self.n
        if not len(some):
            return
        own = asked[some]
        which = np.concatenate([np.repeat(np.arange(len(some)), n), np.repeat(np.arange(len(some)), each[some])])
        score, doc = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.kept[own].ravel(), doc])
        rounded = np.round(score, 6)
        order = np.lexsort((doc, -rounded, which))
        first = order[(np.cumsum(each[some] + n) - each[some] - n)[:, None] + np.arange(n)]
        self.score[own], self.kept[own], self.least[own] = score[first], doc[first], np.maximum(rounded[first[:, -1]], 0)

    def best(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), 4096):
            which, slot = np.nonzero(self.kept[i : i + 4096] >= 0)
            own = self.docs.take(pa.array(self.kept[i + which, slot]))
            cols = [self.ids.take(pa.array(i + which)), *own.columns[1:], pa.array(self.score[i + which, slot])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", *own.schema.names[1:], "score"])


def _best(batches: Iterator[pa.RecordBatch], n: int, asking: pa.Schema, naming: pa.Schema, ties: list[str], chunks: int, mean: list[float], k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(query_id, keys, score): of each task the n best documents for each of its queries; rows come by task, then queries, keys, and chunks."""
    rows = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True))
    for _, of_task in itertools.groupby(rows, lambda x: x[0]):
        head, asked = {-2: [], -1: []}, None
        for chunk, own in itertools.groupby(of_task, lambda x: x[1]):
            schema = {-2: asking, -1: naming}.get(chunk, _POSTINGS)
            held = [pa.ipc.read_record_batch(pa.decompress(packed.as_buffer(), size, "zstd"), schema) for *_, size, packed in own]
            if chunk < 0:
                head[chunk] = held
                continue
            if not head[-2]:
                continue
            asked = asked or _Asked(pa.concat_batches(head[-2]), pa.concat_batches(head[-1]), ties, chunks, n)
            asked.add(chunk, held, mean, k1, b)
        if asked:
            yield from asked.best()
