"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids with one end id after each, and only longer ones than a sequence are cut. An instance is then
fully described by how many pieces there are of each length: at most ``capacity`` numbers, whatever the corpus. On these,

* reduction fixes small sets that provably dominate all others with one of their pieces: a pair that fills a sequence
  exactly; a piece alone where nothing fits beside it; a piece with the largest that fits where no two do; and, where two
  fit but no three, a piece with the one or two others that dominate. The instance shrinks, and the search goes on until
  nothing more is fixed;
* the remainder is packed best-fit in decreasing order, a whole length at a time.

The plan (rows for each pattern and length) is bounded too, so it is sent to all tasks. Pieces are numbered inside their
length by sums over (length, hash bucket), so a length that a third of all pieces share is in no single task. These sums
(capacity times 256 rows at most) are merged in where the numbering has dealt the pieces already, not sent to all tasks.

Defined results: a null text is empty and has the end id only; rows of one id are documents of their own; an empty table
gives no piece. Other columns are not read. Chunks between ASCII white space are encoded on their own, which is exact,
since the tokenizer drops white space and joins nothing across it. Chunks with the string of an added token are left to
the tokenizer, which gives that token's id.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import text_or_empty, written

#: Entries of a worker's caches of encoded chunks and words, and the longest chunk or word that is kept.
CACHE, LONGEST = 200_000, 48
#: What the tokenizer's pre-tokenizer splits by (a fixed value of the vocabulary file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, with the words met before kept."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        common = sorted(set.intersection(*map(set, added)), key=str.isalnum) if added else []
        mark, letters_safe = common[0] if common else "", not any(t.isalpha() for t in added)  # most chunks lack the character that all added tokens have
        tokenize, find = self.tokenizer.model.tokenize, regex.compile(SPLIT).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        packs = [struct.Struct(f"<{n}I").pack for n in range(LONGEST + 1)]
        whole = lambda chunk: np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

        def tokens(word: str) -> bytes:
            # The vocabulary is over characters that stand for bytes; printable ASCII stands for itself.
            ids = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(shown))]
            return packs[len(ids)](*ids) if len(ids) <= LONGEST else struct.pack(f"<{len(ids)}I", *ids)

        class Marks(dict):
            """Numbers, punctuation and endings after an apostrophe."""

            def __missing__(self, word: str) -> bytes:
                out = tokens(word)
                if len(self) >= CACHE:
                    self.clear()
                if len(word) <= LONGEST:
                    self[word] = out
                return out

        marks = Marks()

        class Chunks(dict):
            """Chunks, and the words of letters in them."""

            def __missing__(self, chunk: str) -> bytes:
                low = chunk.lower()
                if not chunk.isprintable() or not (chunk.isascii() or max(chunk) < "ɐ"):
                    out = whole(chunk)
                elif letters_safe and low.isalpha():
                    out = tokens(low) if low == chunk else self[low]
                elif mark in low and any(t in low for t in added):
                    out = whole(chunk)
                else:
                    out = b"".join([self[w] if w.isalpha() and w != chunk else marks[w] for w in find(low)])
                if len(self) >= CACHE:
                    self.clear()
                if len(chunk) <= LONGEST:
                    self[chunk] = out
                return out

        self.chunks = Chunks()

    def __call__(self, text: str) -> bytes:
        for blank in "\n\t\r\x0b\x0c":
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, over all tasks."""
    kept = sys.modules.setdefault("_lexigrove_worker", types.ModuleType("_lexigrove_worker"))
    if getattr(kept, "encoder_path", None) != path:
        kept.encoder, kept.encoder_path = Encoder(path), path
    return kept.encoder


def cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, piece, start, length, crc, ids) of each piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    encode, end, width = encoder(path), struct.pack("<I", end_id), 4 * capacity
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j in kernels.slices(texts):
            rows = []
            for own, text in zip(ids[i:j], texts.slice(i, j - i).to_pylist(), strict=True):
                data = encode(text or "") + end
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    rows.append((own, k // width, k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "crc", "ids"])


def reduce_dominated(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """What dominance fixes, as (sequences, [(length, pieces in each)]), and the counts that are left."""
    left, fixed = {k: v for k, v in count.items() if v}, []

    def take(n: int, *lengths: int) -> None:
        own: dict[int, int] = {}
        for x in lengths:
            own[x] = own.get(x, 0) + 1
        fixed.append((n, sorted(own.items(), reverse=True)))
        for x, m in own.items():
            left[x] -= n * m
            if not left[x]:
                del left[x]

    changed = True
    while changed:
        changed = False
        sizes = sorted(left)
        for big in reversed(sizes):
            while left.get(big):
                pair = capacity - big
                if pair in left and (pair != big or left[big] > 1):
                    take(left[big] // 2 if pair == big else min(left[big], left[pair]), big, pair)
                    changed = True
                    continue
                if big == capacity:
                    take(left[big], big)
                    changed = True
                    continue
                others = (x for x in sizes if left.get(x, 0) > (x == big))
                have = list(itertools.islice(others, 2))
                if not have or big + have[0] > capacity:
                    take(left[big], big)
                    changed = True
                    continue
                second = have[0] if left[have[0]] - (have[0] == big) > 1 else have[1] if len(have) > 1 else None
                if second is None or big + have[0] + second > capacity:
                    at = bisect.bisect_right(sizes, capacity - big) - 1
                    while at >= 0 and left.get(sizes[at], 0) <= (sizes[at] == big):
                        at -= 1
                    fit = sizes[at]
                    take(left[big] // 2 if fit == big else min(left[big], left[fit]), big, fit)
                    changed = True
                    continue
                three = _dominating(left, sizes, big, capacity)
                if three is None:
                    break
                own = collections.Counter(three)
                # While copies are left over, every choice stays as it is.
                take(max(min((left[x] - 3) // m for x, m in own.items()), 1), *three)
                changed = True
    return fixed, left


def _dominating(left: dict[int, int], sizes: list[int], big: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``big`` of two or three pieces that dominates all others, where no more than two pieces fit beside it.

    With the largest piece that fits alone (a) and the pair with the largest sum: a dominates if it is no smaller than
    that sum. The pair dominates if a is its larger piece and no two pieces between its two fit beside big.
    """
    room = capacity - big
    have = lambda x: left.get(x, 0) - (x == big)
    small = [x for x in sizes if x <= room and have(x) > 0]
    least = [x for x in small[:3] for _ in range(min(have(x), 3))][:3]
    if len(least) < 2 or (len(least) > 2 and sum(least) <= room):
        return None
    best, i, j = None, 0, len(small) - 1
    while i <= j:
        if small[i] + small[j] > room or (i == j and have(small[i]) < 2):
            j -= 1
        else:
            best = max(best or (0, 0, 0), (small[i] + small[j], small[j], small[i]))
            i += 1
    a = small[-1]
    if best is None or a >= best[0]:
        return big, a
    total, upper, lower = best
    if upper != a:
        return None
    at = bisect.bisect_right(small, lower)
    between = [x for x in small[at : at + 2] for _ in range(min(have(x) - (x == a), 2))][:2]
    return (big, upper, lower) if len(between) < 2 or sum(between) > room else None


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing by whole lengths: (sequences, [(length, pieces in each)])."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, own: tuple) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((n, own))

    for length in sorted(count, reverse=True):
        n = count[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, own = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, bins, own = capacity, n, ()
            each = room // length
            full = min(bins, n // each)
            put(room - each * length, full, (*own, (length, each)))
            n -= full * each
            rest = bins - full
            if rest and n:
                some = min(each, n)
                put(room - some * length, 1, (*own, (length, some)))
                n -= some
                rest -= 1
            if own:
                put(room, rest, own)
    return [(n, list(own)) for groups in open_.values() for n, own in groups]


def plan(count: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the k-th piece of a length goes: arrays (length, first k, pieces in each, first sequence, offset), sorted."""
    fixed, left = reduce_dominated(count, capacity)
    met: dict[int, int] = {}
    rows, sequence = [], 0
    for n, own in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, each in own:
            first = met.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            met[length] = first + n * each
            offset += length * each
        sequence += n
    if met != {k: v for k, v in count.items() if v}:
        raise AssertionError("the plan does not hold every piece once")
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((),) * 5))


def placed(batches: Iterator[pa.RecordBatch], where: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    lengths, first, each, sequence, offset = where
    keys = (lengths << 48) | first
    for batch in batches:
        length, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "k"))
        at = np.searchsorted(keys, (length << 48) | k, "right") - 1
        step = k - first[at]
        own = [c for c in batch.schema.names if c != "k"]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in own] + [pa.array(sequence[at] + step // each[at]), pa.array(offset[at] + step % each[at] * length)], [*own, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), and the ids if asked for, a row for each piece."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    kinds = "id bigint, piece int, start bigint, length bigint, crc bigint, ids array<int>"
    pieces = texts.mapInArrow(kernels.lean(lambda x: cut(x, tokenizer, capacity, end_id, with_ids)), kinds)
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = written(pieces).withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(256)).cast("int"))
    held = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = written(held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    count = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = plan(count, capacity)
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "crc")) - 1
    numbered = pieces.withColumn("inside", inside).join(starts.select("length", "bucket", "before").hint("merge"), ["length", "bucket"]).withColumn("k", F.col("before") + F.col("inside"))
    own = ["id", "piece", "start", "length", "crc", *(["ids"] if with_ids else [])]
    numbered = numbered.select(*own, "k")
    out = numbered.mapInArrow(kernels.lean(lambda x: placed(x, where)), ", ".join(f"{c} {dict(numbered.dtypes)[c]}" for c in own) + ", sequence_id bigint, offset bigint")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *own[5:])
