"""Document fingerprints by I-Match with randomised lexicons.

Document frequencies of all terms come from the whole corpus. Terms in a band of document frequency (and so of inverse
document frequency) are the lexicon: since each is in ``low`` of all documents or more, there are at most (mean distinct
terms of a document / low) of them, a bound that does not grow with the corpus, and the lexicon is sent to all tasks.
Each of ``parts`` random lexicons keeps some of its terms, from one in 8 to one in 256; a text's sorted distinct terms
in it are hashed: a 64-bit hash of the set, in which the order of the terms plays no part (a sum over distinct terms,
mixed). A fingerprint shows 32 bits of each part's hash, and two are alike by the share of parts, not empty in both, whose
hashes agree.

``neighbours`` also fingerprints an edited text (its second half replaced by the start of the next document, ids
descending). Ids are dealt to ranges by the bytes of their texts, 64 MB each, however many that makes; the first document of each range goes to the range
above as a guest, so no global window is needed and each text moves once, in compressed blocks.

Defined results: null texts are empty; a text without lexicon terms is fingerprinted by all its words; equal texts have
equal fingerprints; rows of one id follow each other in the order of their bytes; null ids come last; a table of one row
follows itself. Ids are integers (what is none raises an error). Other columns are not read.

Bounds: a worker holds one range; all rows of one id, or without one, are in one range, as they follow each other. The
driver holds the ranges' bounds and a sample of 8 to 100 ids for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import drawn, shuffle_partitions, text_or_empty, tidy
from lexigrove.llm.substring_dedup import _heads, _rows, pack, unpack

U = np.uint64
TERM = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256))
NO_ID = np.iinfo(np.int64).min
#: The random lexicons keep from one in 2**DENSEST to one in 2**SPARSEST of the lexicon's terms.
DENSEST, SPARSEST = 3, 8
ROW = "bucket int, kind int, blob binary"
#: Bytes of text that a range of ids is made for; a worker holds one at a time.
RANGE = 64 << 20


def counted(batches: Iterator[pa.RecordBatch], flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(term, documents) summed over what a task has read."""
    hasher = kernels.WordHasher(word=TERM)
    held, size = [], 0

    def batch() -> Iterator[pa.RecordBatch]:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], ["term", "n"])

    for rows in batches:
        texts = rows.column(0)
        for i, j in kernels.slices(texts):
            h, doc = hasher.words(*kernels.bytes_of(texts.slice(i, j - i)))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            held.append(h[_heads(h, doc)])
            size += len(held[-1])
            if size > flush:
                yield from batch()
                held, size = [], 0
    if held:
        yield from batch()


def lexicon(docs: DataFrame, text_col: str, low: float, high: float) -> np.ndarray:
    """The sorted hashes of all terms that are in low to high of all documents."""
    texts = docs.select(text_or_empty(text_col).alias("text"))
    n = docs.count()
    terms = texts.mapInArrow(kernels.lean(counted), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    with tidy(docs.sparkSession):
        band = terms.where((F.col("n") >= max(1, low * n)) & (F.col("n") <= high * n)).select("term").toArrow()  # bounded by low
    return np.sort(band.column(0).to_numpy().view(U))


class Matcher:
    """Fingerprints of many texts against one lexicon."""

    def __init__(self, terms: np.ndarray, parts: int):
        self.terms, self.parts = terms, parts
        self.hasher = kernels.WordHasher(word=TERM)
        if parts > 64:
            raise ValueError("parts must be 64 at most")
        keep, masks = np.full(len(terms), 2**64 - 1, U), []
        for k in range(SPARSEST):
            keep = keep & kernels.mixed(terms ^ kernels.mixed(np.array([k + 1], U)))
            masks.append(keep)
        # Part j keeps one in 2**r terms, r going round from DENSEST to SPARSEST, so short and long texts have parts of a few terms.
        rates = [DENSEST + j % (SPARSEST - DENSEST + 1) for j in range(parts)]
        self.member = np.stack([(masks[r - 1] >> U(j)) & U(1) for j, r in enumerate(rates)], axis=1)
        self.value = kernels.mixed(terms ^ U(0x5851F42D4C957F2D))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Part hashes of 63 bits (-1: empty; one for all words if there is no lexicon term), and fingerprints."""
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, doc = self.hasher.words(np.frombuffer(b"".join(texts), np.uint8), at)
        out = np.full((len(texts), self.parts), -1, np.int64)
        have = np.zeros(len(texts), bool)
        if len(self.terms) and len(h):
            i = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            hit = self.terms[i] == h
            both = np.unique((doc[hit].astype(np.int64) << 32) | i[hit])
            own, term = both >> 32, both & 0xFFFFFFFF
            heads = _heads(own)
            if len(heads):
                member = self.member[term]
                sums = np.add.reduceat(member * self.value[term][:, None], heads, axis=0)
                some = np.add.reduceat(member, heads, axis=0) > 0
                out[own[heads]] = np.where(some, (kernels.mixed(sums) >> U(1)).astype(np.int64), -1)
                have[own[heads]] = some.any(axis=1)
        lo = np.searchsorted(doc, np.arange(len(texts) + 1))
        names = []
        for r in range(len(texts)):
            if have[r]:
                names.append("".join([f"{v >> 31:08x}" if v >= 0 else "." * 8 for v in out[r].tolist()]))
            else:
                whole = hashlib.blake2b(h[lo[r] : lo[r + 1]].tobytes(), digest_size=8).hexdigest()
                names.append(f"words:{whole}")
                out[r, 0] = int(whole, 16) >> 1
        return out, names


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a >= 0) | (b >= 0)
    return ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def dealt(batches: Iterator[pa.RecordBatch], edges: np.ndarray, heads: np.ndarray, guest_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) as blobs by id range; kind 1 are guests: the largest ids of ranges, for the ranges above."""

    def every() -> Iterator[tuple[int, int, bytes]]:
        held, size = [], 0

        def flushed() -> Iterator[tuple[int, int, bytes]]:
            ids = np.concatenate([x[0] for x in held])
            texts = [t for x in held for t in x[1]]
            bucket = np.searchsorted(edges, ids, "left")
            order = np.argsort(bucket, kind="stable")
            cuts = _heads(bucket[order])
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                own = [texts[i] for i in order[a:b]]
                yield int(bucket[order[a]]), 0, pack(ids[order[a:b]], np.array([len(t) for t in own], np.int64), np.frombuffer(b"".join(own), np.uint8))
            at = np.minimum(np.searchsorted(heads, ids), len(heads) - 1)
            for i in np.flatnonzero(heads[at] == ids):
                yield int(guest_of[at[i]]), 1, pack(ids[i : i + 1], np.array([len(texts[i])], np.int64), np.frombuffer(texts[i], np.uint8))

        for batch in batches:
            all_ids, texts = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            for i, j in kernels.slices(texts, 4 << 20):
                raw, at = kernels.bytes_of(texts.slice(i, j - i))
                data = raw.tobytes()
                held.append((all_ids[i:j], [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]))
                size += len(data)
                if size > 48 << 20:
                    yield from flushed()
                    held.clear()
                    size = 0
        if held:
            yield from flushed()

    return _rows(every())


OUT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def matched(batches: Iterator[pa.RecordBatch], terms: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(terms, parts)

    def one(held: list[bytes], guests: list[bytes]) -> Iterator[pa.RecordBatch]:
        def rows(blobs: list[bytes]) -> list[tuple[int, bytes]]:
            out = []
            for blob in blobs:
                ids, sizes, data = unpack(blob, np.int64, np.int64, np.uint8)
                ends, raw = np.cumsum(sizes).tolist(), data.tobytes()
                out += [(i, raw[b - n : b]) for i, n, b in zip(ids.tolist(), sizes.tolist(), ends, strict=True)]
            return out

        # Ids descend; bytes ascend within one id, so of guests of one id the first is next.
        own = sorted(rows(held), key=lambda x: (-x[0], x[1]))
        after = sorted(rows(guests), key=lambda x: (-x[0], x[1]))
        texts = [t for _, t in own] + [t for _, t in after[:1]]
        step, i = 0, 0
        while i < len(own):
            j, step = i, 0
            while j < len(own) and (step < (1 << 20) or j == i):
                step += len(texts[j])
                j += 1
            plain = texts[i : j + 1] if j < len(texts) else texts[i:j]
            edited, chars = [], []
            for k in range(i, j):
                text = texts[k].decode()
                half = len(text) // 2
                following = texts[min(k + 1, len(texts) - 1)].decode()
                edited.append((text[: len(text) - half] + following[:half]).encode())
                chars.append(len(text))
            marks, names = matcher(plain)
            marks_e, names_e = matcher(edited)
            n = j - i
            nexts = marks[1 : n + 1] if len(marks) > n else np.concatenate([marks[1:n], marks[n - 1 : n]])
            cols = [
                pa.array([None if x[0] == NO_ID else x[0] for x in own[i:j]], pa.int64()),
                pa.array(chars, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array(names[:n]),
                pa.array(names_e),
                pa.array(likeness(marks[:n], marks_e)),
                pa.array(likeness(marks[:n], nexts)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])
            i = j

    now, held = None, ([], [])
    for batch in batches:
        bucket, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if bucket[i] != now:
                if held[0]:
                    yield from one(*held)
                now, held = bucket[i], ([], [])
            held[kind[i]].append(batch.column(2)[i].as_py())
    if held[0]:
        yield from one(*held)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.002, high: float = 0.25, parts: int = 64) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs."""
    terms = lexicon(docs, text_col, low, high)
    ids = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.octet_length(text_or_empty(text_col)).cast("bigint").alias("size"))
    edges = range_edges(ids, 4 * shuffle_partitions(docs.sparkSession))
    # A range is (edge, next edge]; its largest id is the first of the range, ids descending.
    tops = _tops(ids.select("id"), edges)
    heads = np.array(sorted(tops.values()), np.int64)
    of = {v: k for k, v in tops.items()}
    order = [of[h] for h in heads.tolist()]
    guest_of = np.array(order[1:] + order[:1], np.int64)  # the range above, and the lowest for the largest of all
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    if not len(heads):
        return docs.sparkSession.createDataFrame([], OUT).withColumnRenamed("id", id_col)
    rows = texts.mapInArrow(kernels.lean(lambda x: dealt(x, edges, heads, guest_of)), ROW).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(kernels.lean(lambda x: matched(x, terms, parts)), OUT).withColumnRenamed("id", id_col)


def range_edges(ids: DataFrame, least: int) -> np.ndarray:
    """Ids that part all of them, (id, size), into ranges of about RANGE bytes, ``least`` at least; from a sample of a few ids a range."""
    held = ids.agg(F.sum(F.col("size") + 1).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not held.rows:
        return np.empty(0, np.int64)
    n = max(least, held.bytes // RANGE)
    share = min(100, max(8, 3_000_000 // n)) * n / held.rows
    some = ids.where(drawn(share, "id", "size", F.lit("ranges"))).toArrow()
    own, size = (some.column(c).to_numpy().astype(np.int64) for c in ("id", "size"))
    order = np.argsort(own, kind="stable")
    upto = np.cumsum(size[order] + 1)
    if not len(upto):
        return np.empty(0, np.int64)
    return np.unique(own[order][np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)])


def _tops(ids: DataFrame, edges: np.ndarray) -> dict[int, int]:
    """The largest id of each range that has any; as many rows as there are ranges."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for r, v in zip(np.searchsorted(edges, own, "left").tolist(), own.tolist(), strict=True):
                if v > best.get(r, NO_ID - 1):
                    best[r] = v
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["range", "id"])

    found = ids.mapInArrow(kernels.lean(largest), "range int, id bigint").groupBy("range").agg(F.max("id").alias("id")).toArrow()
    return dict(zip(found.column("range").to_pylist(), found.column("id").to_pylist(), strict=True))
