"""Repeated substrings by anchor and window hashing (winnowing).

Windows of ``depth`` bytes are grouped by hashes of growing reach, called digits here; no suffixes are ordered. A group
that is in one document is dropped after each pass, and the groups left at full depth are the repeated windows, up to
collisions: bytes are never compared. Runs are told apart by 96 bits, windows by more, so in 100 TB of text (6e12 runs)
0.0002 wrong groups are to be expected.

* Digit 1 is a 16-byte string that every window of ``depth`` bytes picks from itself (the one with the smallest hash, the
  leftmost of equals), so equal windows have equal digits. Neighbouring windows that pick the same place travel as one
  record, about one for 17 bytes of text.
* Digit 2 is all bytes of such a run of windows. A run that an earlier document has too needs no more.
* Digit 3 groups the rest by whole windows: runs whose first digit is in several documents, under different second ones.

Records travel in packed, compressed arrays, a row for each radix bucket and flush. Mappers keep the earliest document
of each equal (digit 1, digit 2) before they send it. A first digit with very many different second digits in one task
(the border of a passage that very many documents share) is dealt by its second and third digits instead of by itself,
and a marker tells the bucket of that first digit; so no bucket holds an unbounded group. The number of buckets follows
the bytes of the input, and a bucket that is large all the same is worked through in pieces, by further bits of its digits.

Defined results: null texts are empty; a window counts as repeated only if a document with a smaller id has it; rows of
one id never match each other; rows with a null id lose nothing and are no source; texts shorter than ``depth`` stay.
Other columns are not read. Digits are compared as hashes of their bytes: 32 and 48
bits and those of the bucket for runs, 64 bits more for windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import drop, shuffle_partitions, text_or_empty, written

U = np.uint64
DIGIT = 16
#: Records that a task holds before it sends them, and different second digits from which a first one is dealt by them.
FLUSH, HOT = 1_500_000, 64
#: Bytes of text that a bucket is made for, most buckets (a flush still gives each some 20 records), and packed bytes that are laid out at a time.
BUCKET, MOST_BUCKETS, PIECE = 16 << 20, 1 << 16, 24 << 20
#: Longer texts are read in overlapping parts of so many bytes.
PART = 4 << 20
NO_ID = np.iinfo(np.int64).max
DUP, BY_RUN, BY_WINDOW = 0, 1, 2
ROW = "bucket int, kind int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


# Digit 1 travels as 32 bits beside those that the bucket holds, digit 2 as 32 and 16. A tag tells texts of one id apart:
# 16 bits of digit 2 in first replies, of the whole text in last ones.
RECORD = (np.uint32, np.uint32, np.uint16, np.int64, np.uint32, np.uint8)  # digit 1, digit 2, id less the one before, first window, windows
REPLY = (np.int64, np.uint16, np.uint32, np.uint8, np.uint8, np.uint32)  # id, tag, first window, windows, kind, digit 1
RUN = (np.uint32, np.int64, np.uint16, np.uint32, np.uint8, np.uint8)  # digit 1, id, tag, first window, windows, bytes
WINDOW = (np.uint64, np.int64, np.uint16, np.uint32)  # digits, id, tag, window


def pieces(blobs: list[bytes], read: Callable[[bytes], list[np.ndarray]], digit: int, wide: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> Iterator[list[np.ndarray]]:
    """The records of all blobs, column by column; of large ones in several pieces, each with all records of its values in column ``digit``.

    ``wide`` gives how many entries of the last column each record has, where that is not one.
    """
    n = -(-sum(map(len, blobs)) // PIECE)
    for k in range(n):
        out = []
        for blob in blobs:
            columns = read(blob)
            if n > 1:
                own = columns[digit] % columns[digit].dtype.type(n) == k
                long = np.repeat(own, wide(columns)) if wide else own
                columns = [c[own] for c in columns[:-1]] + [columns[-1][long]]
            out.append(columns)
        found = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(found[digit]):
            yield found


class Rolling:
    """Hashes of substrings of one byte array."""

    value = kernels.tables(13)
    up = down = kernels.powers(1, kernels.R)

    def __init__(self, raw: np.ndarray):
        cls = type(self)
        if len(cls.up) <= len(raw):
            cls.up, cls.down = kernels.powers(2 * len(raw), kernels.R), kernels.powers(2 * len(raw), kernels.R_INVERSE)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return kernels.mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def runs(raw: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(digit 1, digit 2, text, first window from the array's start, windows) of each run of windows that pick one place."""
    n, reach = len(raw) - DIGIT + 1, depth - DIGIT + 1
    empty = np.empty(0, np.int64)
    if n < reach:
        return empty.astype(U), empty.astype(U), empty, empty, empty
    rolling = Rolling(raw)
    digit = kernels.mixed((rolling.sums[DIGIT:] - rolling.sums[:-DIGIT]) * rolling.down[:n])
    least = (digit & ~U(0xFFFFFFFF)) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: span - reach], least[reach - span :])
    room = np.repeat(at[1:], np.diff(at))[: len(least)] - np.arange(len(least))
    p = np.flatnonzero(room >= depth)
    if not len(p):
        return empty.astype(U), empty.astype(U), empty, empty, empty
    pick = (least[p] & U(0xFFFFFFFF)).astype(np.int64)
    b = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    lo, hi = p[b], p[np.concatenate([b[1:] - 1, [len(p) - 1]])]
    return digit[pick[b]], rolling.of(lo, hi + depth), np.searchsorted(at, lo, "right") - 1, lo, hi - lo + 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _tag(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) & 0xFFFF


def _of_id(ids: np.ndarray, n: int) -> np.ndarray:
    return (kernels.mixed(ids.astype(U)) % U(n)).astype(np.int64)


def _of_digit(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) % U(n)).astype(np.int64)


def _dealt(bucket: np.ndarray, kind: int, arrays: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = tuple(a[order] for a in arrays)
    edges = _heads(bucket)
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[a]), kind, pack(*(x[a:b] for x in arrays))


def _rows(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        b, k, x = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(values: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(heads, n)))


def scanned(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """First pass, over (id, text): kind 0 are records by radix bucket, kind 1 are replies that need no other task."""

    def flushed(held: list) -> Iterator[tuple[int, int, bytes]]:
        d1, d2, ids, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, d2, d1))
        d1, d2, ids, lo, n = (x[order] for x in (d1, d2, ids, lo, n))
        tag = (d2 >> U(32)).astype(np.uint16)
        heads = _heads(d1, d2)
        dup = ids > _spread(ids[heads], heads, len(ids))
        zero = np.zeros(int(dup.sum()), np.uint8)
        yield from _dealt(_of_id(ids[dup], buckets), 1, (ids[dup], tag[dup], lo[dup], n[dup], zero, zero.astype(np.uint32)))
        tops = _heads(d1)
        many = np.add.reduceat(np.isin(np.arange(len(d1)), heads, assume_unique=True).astype(np.int64), tops) > HOT
        hot = _spread(many, tops, len(d1))
        first = tops[many]
        least = np.minimum.reduceat(ids, tops)[many]
        keep = ~dup
        n = np.where(hot, n | np.uint8(128), n).astype(np.uint8)
        bucket = np.where(hot, _of_digit(d2, buckets), _of_digit(d1, buckets))
        none = np.zeros(len(first), np.uint8)
        bucket = np.concatenate([bucket[keep], _of_digit(d1[first], buckets)])
        ids, lo, n = np.concatenate([ids[keep], least]), np.concatenate([lo[keep], none.astype(np.uint32)]), np.concatenate([n[keep], none])
        d1, d2 = np.concatenate([d1[keep], d1[first]]), np.concatenate([d2[keep], none.astype(U)])
        order = np.lexsort((lo, ids, bucket))  # ids ascend in a bucket, so the steps between them are small
        bucket, ids, lo, n, d1, d2 = (x[order] for x in (bucket, ids, lo, n, d1, d2))
        edges = _heads(bucket)
        step = np.diff(ids, prepend=0)
        step[edges] = ids[edges]
        for a, b in zip(edges, np.append(edges[1:], len(ids)), strict=True):
            yield int(bucket[a]), 0, pack(d1[a:b].astype(np.uint32), d2[a:b].astype(np.uint32), (d2[a:b] >> U(32)).astype(np.uint16), step[a:b], lo[a:b], n[a:b])

    def every() -> Iterator[tuple[int, int, bytes]]:
        held, size = [], 0
        for batch in batches:
            all_ids, texts = _ids(batch.column(0)), batch.column(1)
            for i, j in kernels.slices(texts):
                raw, at = kernels.bytes_of(texts.slice(i, j - i))
                ids = all_ids[i:j]
                for a in range(0, max(len(raw), 1), PART) if j - i == 1 else (0,):
                    part, edges = (raw[a : a + PART + depth - 1], None) if j - i == 1 else (raw, at)
                    d1, d2, row, lo, n = runs(part, np.array([0, len(part)]) if edges is None else edges, depth)
                    good = ids[row] != NO_ID
                    d1, d2, row, lo, n = (x[good] for x in (d1, d2, row, lo, n))
                    held.append((d1, d2, ids[row], (lo + a - (at[row] if edges is not None else 0)).astype(np.uint32), n.astype(np.uint8)))
                    size += len(d1)
                    if size > FLUSH:
                        yield from flushed(held)
                        held, size = [], 0
        if size:
            yield from flushed(held)

    return _rows(every())


def ordered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Second pass, over records sorted by bucket: replies by bucket of the id."""

    def read(blob: bytes) -> list[np.ndarray]:
        d1, low, tag, step, lo, n = unpack(blob, *RECORD)
        return [d1, low, tag, np.cumsum(step), lo, n]

    def answer(d1: np.ndarray, low: np.ndarray, tag: np.ndarray, ids: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        d2 = low.astype(U) | tag.astype(U) << U(32)
        order = np.lexsort((ids, d2, d1, n > 128))
        d1, d2, ids, tag, lo, n = (x[order] for x in (d1, d2, ids, tag, lo, n))
        hot, marker = n > 128, n == 0
        heads = _heads(d1, d2, hot)
        dup = (ids > _spread(ids[heads], heads, len(ids))) & ~marker
        tops = _heads(d1, hot)
        shared = np.minimum.reduceat(ids, tops) < np.maximum.reduceat(ids, tops)
        marked = np.logical_or.reduceat(marker, tops)
        seconds = np.add.reduceat(np.isin(np.arange(len(d1)), heads, assume_unique=True).astype(np.int64), tops)
        more = _spread(marked | (shared & (seconds > 1)), tops, len(d1)) | hot
        kind = np.where(dup, DUP, np.where(_spread(marked, tops, len(d1)) | hot, BY_WINDOW, BY_RUN)).astype(np.uint8)
        say = (dup | more) & ~marker
        yield from _dealt(_of_id(ids[say], buckets), 0, (ids[say], tag[say], lo[say], n[say] & np.uint8(127), kind[say], np.where(kind == BY_RUN, d1, np.uint32(0))[say]))

    def every() -> Iterator[tuple[int, int, bytes]]:
        now, held = None, []
        for bucket, kind, blob in _each(batches):
            if kind == 1:
                yield bucket, 0, blob
                continue
            if bucket != now and held:
                for piece in pieces(held, read, 0):
                    yield from answer(*piece)
                held = []
            now = bucket
            held.append(blob)
        for piece in pieces(held, read, 0):
            yield from answer(*piece)

    return _rows(every())


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        b, k = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            yield b[i], k[i], batch.column(2)[i].as_py()


def packed_texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, text) as blobs by bucket of the id, kind 1."""

    def every() -> Iterator[tuple[int, int, bytes]]:
        held, size = [], 0

        def flushed() -> Iterator[tuple[int, int, bytes]]:
            ids = np.concatenate([x[0] for x in held])
            texts = [t for x in held for t in x[1]]
            bucket = _of_id(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = _heads(bucket[order])
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                own = [texts[i] for i in order[a:b]]
                yield int(bucket[order[a]]), 1, pack(ids[order[a:b]], np.array([len(t) for t in own], np.int64), np.frombuffer(b"".join(own), np.uint8))

        for batch in batches:
            all_ids, texts = _ids(batch.column(0)), batch.column(1)
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


FINAL = "kind int, bucket int, blob binary, id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class _Out:
    """Batches of FINAL rows."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, kind: int, bucket: int, blob: bytes | None, *final) -> None:
        self.rows.append((kind, bucket, blob, *(final or (None,) * 5)))
        self.size += len(blob or b"") + 100

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FINAL.split(", ")])


def judged(text: bytes, lo: np.ndarray, n: np.ndarray, depth: int) -> tuple[int, int, int, str]:
    if not len(lo):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, lo.astype(np.int64), 1)
    np.add.at(change, lo.astype(np.int64) + n + depth - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), begins, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def settled(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Over replies (kind 0) and then texts (kind 1) of each bucket of ids.

    Documents with nothing open become final rows (kind 0). The others wait (kind 3), and what their open windows have
    to be compared by goes out: runs with their bytes (kind 1), windows (kind 2); replies that are known here are kind 4.
    """
    out = _Out()
    runs_held, windows_held = [], []

    def sent() -> None:
        if runs_held:
            d1, ids, tag, lo, n = (np.concatenate([np.atleast_1d(r[k]) for r in runs_held]) for k in range(5))
            data = [r[5] for r in runs_held]
            flat = [x for d in data for x in d]
            bucket = _of_id(d1, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = _heads(bucket[order])
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                o = order[a:b]
                out.add(1, int(bucket[o[0]]), pack(d1[o], ids[o], tag[o], lo[o], n[o], np.frombuffer(b"".join([flat[i] for i in o]), np.uint8)))
            runs_held.clear()
        if windows_held:
            h, ids, tag, p = (np.concatenate(x) for x in zip(*windows_held, strict=True))
            order = np.lexsort((ids, h))
            h, ids, tag, p = (x[order] for x in (h, ids, tag, p))
            heads = _heads(h)
            dup = ids > _spread(ids[heads], heads, len(ids))
            one = np.ones(int(dup.sum()), np.uint8)
            for b, _, blob in _dealt(_of_id(ids[dup], buckets), 0, (ids[dup], tag[dup], p[dup], one, one * 0, one.astype(np.uint32))):
                out.add(4, b, blob)
            for b, _, blob in _dealt(_of_digit(h[~dup], buckets), 0, (h[~dup], ids[~dup], tag[~dup], p[~dup])):
                out.add(2, b, blob)
            windows_held.clear()

    now, replies, merged = None, [], None
    open_bytes = 0
    for bucket, kind, blob in _each(batches):
        if bucket != now:
            now, replies, merged = bucket, [], None
        if kind == 0:
            replies.append(unpack(blob, *REPLY))
            continue
        if merged is None:
            merged = [np.concatenate(x) for x in zip(*replies, strict=True)] if replies else [np.empty(0, k) for k in REPLY]
            order = np.lexsort((merged[2], merged[0]))
            merged, replies = [x[order] for x in merged], []
        if last:
            ids, sizes, data, counts, known_lo, known_n = unpack(blob, np.int64, np.int64, np.uint8, np.int64, np.uint32, np.uint8)
        else:
            ids, sizes, data = unpack(blob, np.int64, np.int64, np.uint8)
        ends = np.cumsum(sizes)
        left, right = np.searchsorted(merged[0], ids, "left"), np.searchsorted(merged[0], ids, "right")
        known_end = np.cumsum(counts) if last else None
        wait = []
        for r in range(len(ids)):
            text = data[ends[r] - sizes[r] : ends[r]].tobytes()
            a, b = left[r], right[r]
            lo, n, kinds, d1 = merged[2][a:b], merged[3][a:b], merged[4][a:b], merged[5][a:b]
            tag, rolling = 0, None
            if b > a:
                tag = _tag(text)
                if last:
                    mine = merged[1][a:b] == tag
                else:
                    rolling = Rolling(np.frombuffer(text, np.uint8))
                    end = lo.astype(np.int64) + n + depth - 1
                    mine = end <= len(text)
                    mine[mine] = (rolling.of(lo[mine].astype(np.int64), end[mine]) >> U(32)).astype(np.uint16) == merged[1][a:b][mine]
                if not mine.all():
                    lo, n, kinds, d1 = lo[mine], n[mine], kinds[mine], d1[mine]
            done = kinds == DUP
            if last:
                c, d = known_end[r] - counts[r], known_end[r]
                lo, n = np.concatenate([lo, known_lo[c:d]]), np.concatenate([n, known_n[c:d]])
                done = np.ones(len(lo), bool)
            if done.all():
                out.add(0, 0, None, None if ids[r] == NO_ID else int(ids[r]), *judged(text, lo, n, depth))
                continue
            for x in np.flatnonzero(kinds == BY_RUN):
                s = int(lo[x])
                runs_held.append((d1[x], ids[r], np.uint16(tag), lo[x], n[x], [text[s : s + int(n[x]) + depth - 1]]))
                open_bytes += int(n[x]) + depth
            if (kinds == BY_WINDOW).any():
                w = kinds == BY_WINDOW
                p = np.repeat(lo[w].astype(np.int64), n[w]) + np.arange(int(n[w].sum())) - np.repeat(np.cumsum(n[w].astype(np.int64)) - n[w], n[w])
                windows_held.append((rolling.of(p, p + depth), np.full(len(p), ids[r]), np.full(len(p), tag, np.uint16), p.astype(np.uint32)))
                open_bytes += 20 * len(p)
            wait.append((ids[r], text, lo[done], n[done]))
        if wait:
            out.add(3, now, pack(np.array([w[0] for w in wait], np.int64), np.array([len(w[1]) for w in wait], np.int64), np.frombuffer(b"".join([w[1] for w in wait]), np.uint8), np.array([len(w[2]) for w in wait], np.int64), np.concatenate([w[2] for w in wait]), np.concatenate([w[3] for w in wait])))
        if open_bytes > 24 << 20:
            sent()
            open_bytes = 0
        if out.size > 8 << 20:
            yield out.batch()
    sent()
    yield out.batch()


def deepest(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Third digit, over runs (kind 1) and windows (kind 2) sorted by (bucket, kind): replies by bucket of the id."""

    def by_run(d1: np.ndarray, ids: np.ndarray, tag: np.ndarray, lo: np.ndarray, n: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        count = n.astype(np.int64)
        begin = np.cumsum(count + depth - 1) - (count + depth - 1)
        run = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        p = begin[run] + step
        h = kernels.mixed(Rolling(data).of(p, p + depth) + d1[run].astype(U) * U(kernels.R))
        order = np.lexsort((ids[run], h))
        heads = _heads(h[order])
        owner = ids[run][order]
        dup = np.zeros(len(run), bool)
        dup[order] = owner > _spread(owner[heads], heads, len(owner))
        at = np.flatnonzero(dup)
        if not len(at):
            return
        b = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(run[at]) != 0)]))
        length = np.diff(np.append(b, len(at))).astype(np.uint8)
        at = at[b]
        r = run[at]
        yield from _dealt(_of_id(ids[r], buckets), 0, (ids[r], tag[r], (lo[r] + step[at]).astype(np.uint32), length, length * 0, length.astype(np.uint32)))

    def by_window(h: np.ndarray, ids: np.ndarray, tag: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.lexsort((ids, h))
        h, ids, tag, p = (x[order] for x in (h, ids, tag, p))
        heads = _heads(h)
        dup = ids > _spread(ids[heads], heads, len(ids))
        one = np.ones(int(dup.sum()), np.uint8)
        yield from _dealt(_of_id(ids[dup], buckets), 0, (ids[dup], tag[dup], p[dup], one, one * 0, one.astype(np.uint32)))

    def replies(kind: int, blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        if kind == 1:
            for piece in pieces(blobs, lambda b: unpack(b, *RUN), 0, lambda c: c[4].astype(np.int64) + depth - 1):
                yield from by_run(*piece)
        else:
            for piece in pieces(blobs, lambda b: unpack(b, *WINDOW), 0):
                yield from by_window(*piece)

    def every() -> Iterator[tuple[int, int, bytes]]:
        now, held = None, []
        for bucket, kind, blob in _each(batches):
            if kind == 4:
                yield bucket, 0, blob
                continue
            if (bucket, kind) != now and held:
                yield from replies(now[1], held)
                held = []
            now = bucket, kind
            held.append(blob)
        if held:
            yield from replies(now[1], held)

    return _rows(every())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs."""
    if depth < 2 * DIGIT or depth > 100:
        raise ValueError(f"depth must be from {2 * DIGIT} to 100")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    own = shuffle_partitions(docs.sparkSession)
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(own * 3 // 2, min(held // BUCKET, MOST_BUCKETS))  # few, so that packed rows stay large
    tasks = max(own, buckets * 2 // 3)
    dealt = lambda df: (df.repartition(tasks, "bucket") if tasks > own else df.repartition("bucket")).sortWithinPartitions("bucket", "kind")
    replies = written(dealt(texts.mapInArrow(kernels.lean(lambda x: scanned(x, depth, buckets)), ROW)).mapInArrow(kernels.lean(lambda x: ordered(x, buckets)), ROW))
    bodies = texts.mapInArrow(kernels.lean(lambda x: packed_texts(x, buckets)), ROW)
    first = written(dealt(replies.unionByName(bodies)).mapInArrow(kernels.lean(lambda x: settled(x, depth, buckets, False)), FINAL), "kind")
    drop(replies)
    rows = first.select("bucket", "kind", "blob")
    deep = dealt(rows.where("kind in (1, 2, 4)")).mapInArrow(kernels.lean(lambda x: deepest(x, depth, buckets)), ROW)
    waiting = rows.where("kind = 3").select("bucket", F.lit(1).alias("kind"), "blob")
    rest = dealt(deep.unionByName(waiting)).mapInArrow(kernels.lean(lambda x: settled(x, depth, buckets, True)), FINAL)
    columns = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return first.where("kind = 0").select(*columns).unionByName(rest.where("kind = 0").select(*columns))
