"""Packing by concatenation: all documents are one stream of tokens, cut into windows of one length.

Offsets in the stream come from prefix sums in two passes. The first pass encodes: each task numbers its tokens from 0 and
writes them with that number, two bytes an id where the vocabulary allows it. The totals of the tasks, one number each,
are summed up, and a document's place in the stream is its task's start and its own number. The second pass cuts every
document where it meets a window's bound, without a shuffle: a piece knows its window and its place in it from the offset
alone. ``sequences`` lays out the windows: those inside one task's rows at once, and the others from boundary records
(the fragments at the ends of a task's rows), which alone are shuffled.

The windows are full, so there is no padding. What is left at the end of the stream is cut by its binary digits into
sequences whose lengths are powers of two, which need none either.

Defined results: a null text is empty and has the end id only; rows of one id, and equal rows, are documents of their own;
a null id stays null; an empty table gives no piece. Ids keep their type. Other columns are not read. The order of the
documents in the stream is that of the files' splits; what was written holds, whatever task is run again.

Bounds: the driver holds one total for each task of the first pass. A task works on slices of a megabyte of text, or one
text.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import fresh, text_or_empty, written

#: What the pre-tokenizer of byte-level vocabularies of this kind splits by (a fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, as the tokenizer gives them, in little-endian numbers of one width.

    Where every merge of a byte-level vocabulary makes the next id, merging by rank and by list are the same, and the
    faster of the two installed encoders does it; any other vocabulary stays with the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        ranked = self._ranked(path)
        if ranked is None:
            self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        else:
            self.encode = lambda text: ranked.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(self.kind)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary by ranks, or None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split, marks = said["model"], said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model.get("type", "BPE") != "BPE" or said.get("normalizer") or any(split.get(k) != v for k, v in plain.items()) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in marks):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"]: t["id"] for t in marks}
        vocabulary = {w: i for w, i in model["vocab"].items() if w not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(merges) + 256 != len(vocabulary) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(shown[c] for c in w): i for w, i in vocabulary.items()}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        return self.encode(text).tobytes()


def encoder(path: str | None) -> Encoder:
    """One for each worker process and vocabulary, over all tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    kept = sys.modules.setdefault("_lexigrove_stream_worker", types.ModuleType("_lexigrove_stream_worker"))
    if getattr(kept, "path", None) != path:
        kept.encoder, kept.path = Encoder(path), path
    return kept.encoder


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    """(id, task, at, n, width, ids): a document's tokens, and how many its task has before it."""
    encode, task, at = encoder(path), TaskContext.get().partitionId(), 0
    kind = encode.kind if end_id < 1 << 8 * encode.kind.itemsize else np.dtype("<u4")
    end, width = np.array([end_id], kind).tobytes(), kind.itemsize
    for batch in batches:
        own, texts = batch.column(0), batch.column(1)
        for i, j in kernels.slices(texts):
            data = [encode(t) for t in texts.slice(i, j - i).to_pylist()]
            if kind != encode.kind:
                data = [np.frombuffer(d, encode.kind).astype(kind).tobytes() for d in data]
            data = [d + end for d in data]
            n = np.array([len(d) // width for d in data], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            cols = [own.slice(i, j - i), pa.array(np.full(j - i, task, np.int64)), pa.array(first), pa.array(n), pa.array(np.full(j - i, width, np.int32)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "task", "at", "n", "width", "ids"])


class Stream:
    """The encoded documents and where each task's tokens begin."""

    def __init__(self, tokens: DataFrame, window: int):
        totals = tokens.groupBy("task").agg(F.sum("n").alias("n")).toArrow()  # one row a task of the first pass
        task, n = (totals.column(c).to_numpy().astype(np.int64) for c in ("task", "n"))
        order = np.argsort(task)
        self.tokens, self.window = tokens, window
        self.tasks, self.starts = task[order], np.cumsum(n[order]) - n[order]
        total = int(n.sum())
        full, left = divmod(total, window)
        tail = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        #: Where sequences begin that are not windows, and the end of the stream.
        self.tail = np.cumsum([full * window, *tail]).astype(np.int64)
        self.full = full

    def bounds(self, start: int, end: int) -> np.ndarray:
        """start, the bounds of sequences between the two, and end."""
        w = self.window
        inside = np.arange((start // w + 1) * w, min(end, self.full * w + 1), w, dtype=np.int64)
        own = self.tail[(self.tail > start) & (self.tail < end) & (self.tail > self.full * w)]
        return np.concatenate([[start], inside[inside < end], own, [end]])

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each offset of the stream, and the place in it."""
        k = np.searchsorted(self.tail, at, "right") - 1
        inside = at < self.full * self.window
        sequence = np.where(inside, at // self.window, self.full + k)
        return sequence, np.where(inside, at % self.window, at - self.tail[np.maximum(k, 0)])

    def length(self, sequence: int) -> int:
        if sequence < self.full:
            return self.window
        return int(self.tail[sequence - self.full + 1] - self.tail[sequence - self.full])

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, np.dtype]]:
        """(row, global start, tokens, ids, their kind)."""
        task, at, n, width = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("task", "at", "n", "width"))
        start = self.starts[np.searchsorted(self.tasks, task)] + at
        ids = batch.column(batch.schema.get_field_index("ids"))
        for k in range(batch.num_rows):
            yield k, int(start[k]), int(n[k]), ids[k].as_py(), np.dtype(f"<u{width[k]}")


def cut(batches: Iterator[pa.RecordBatch], stream: Stream, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of each document."""
    for whole in batches:
        for i, j in kernels.slices(whole.column(whole.schema.get_field_index("ids"))):
            batch = whole.slice(i, j - i)
            row, begin, length, crc, parts = [], [], [], [], []
            for k, start, n, ids, kind in stream.rows(batch):
                data = np.frombuffer(ids, kind).astype("<u4")
                bounds = stream.bounds(start, start + n) if start // stream.window != (start + n - 1) // stream.window or start + n > stream.full * stream.window else (start, start + n)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    part = data[a - start : b - start]
                    row.append(k)
                    begin.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            row, begin = np.array(row, np.int64), np.array(begin, np.int64)
            sequence, offset = stream.place(begin)
            starts = np.fromiter((s for _, s, *_ in stream.rows(batch)), np.int64, batch.num_rows)
            taken = pa.array(row)
            cols = [batch.column(0).take(taken), pa.array(begin - starts[row]), pa.array(np.array(length, np.int64)), pa.array(np.array(crc, np.int64)), batch.column(batch.schema.get_field_index("n")).take(taken), pa.array(sequence), pa.array(offset)]
            names = ["id", "start", "length", "crc", "tokens", "sequence", "place"]
            if with_ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)


def fragments(batches: Iterator[pa.RecordBatch], stream: Stream) -> Iterator[pa.RecordBatch]:
    """(sequence, place, whole, ids): sequences whose tokens this task has in one run, and boundary records of the others."""
    run: list[np.ndarray] = []
    first = last = 0
    rows: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal run
        if run:
            data = np.concatenate(run)
            bounds = stream.bounds(first, last)
            sequence, place = stream.place(bounds[:-1])
            for a, b, s, p in zip(bounds[:-1], bounds[1:], sequence, place, strict=True):
                rows.append((int(s), int(p), p == 0 and b - a == stream.length(int(s)), data[a - first : b - first].astype(np.int32)))
        run = []
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["sequence", "place", "whole", "ids"])
            rows.clear()

    for whole in batches:
        for i, j in kernels.slices(whole.column(whole.schema.get_field_index("ids"))):
            for _, start, n, ids, kind in stream.rows(whole.slice(i, j - i)):
                if start != last or (last - first >= 256 * stream.window and start % stream.window == 0):
                    yield from flush()
                if not run:
                    first = start
                run.append(np.frombuffer(ids, kind))
                last = start + n
                if last - first >= 1024 * stream.window:  # ends at the last bound, the rest begins a new run
                    keep = (last // stream.window) * stream.window
                    tail = np.concatenate(run)
                    if first < keep < last:
                        run, rest, end = [tail[: keep - first]], tail[keep - first :], last
                        last = keep
                        yield from flush()
                        run, first, last = [rest], keep, end
    yield from flush()


def stream_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 2048, end_id: int = 1) -> Stream:
    """The documents' tokens as one stream, written to the shared folder."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return Stream(written(texts.mapInArrow(kernels.lean(lambda x: encoded(x, tokenizer, end_id)), f"id {kind}, task bigint, at bigint, n bigint, width int, ids binary")), window)


def _closure(stream: Stream) -> Stream:
    """What tasks need of a stream: its numbers, not its table."""
    own = object.__new__(Stream)
    own.__dict__.update({k: v for k, v in stream.__dict__.items() if k != "tokens"})
    return own


def pieces(stream: Stream, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), and the ids if asked for, a row for each piece."""
    own = _closure(stream)
    kind = stream.tokens.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    out = stream.tokens.mapInArrow(kernels.lean(lambda x: cut(x, own, with_ids)), f"id {kind}, start bigint, length bigint, crc bigint, tokens bigint, sequence bigint, place bigint{ids}")
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"), *(["ids"] if with_ids else []))


def sequences(stream: Stream) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. Only boundary records are shuffled."""
    own = _closure(stream)
    found = written(stream.tokens.mapInArrow(kernels.lean(lambda x: fragments(x, own)), "sequence bigint, place bigint, whole boolean, ids array<int>"))
    inner = found.where("whole").select(F.col("sequence").alias("sequence_id"), "ids")
    ends = found.where("not whole").groupBy(F.col("sequence").alias("sequence_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return inner.unionByName(ends)


def pack_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` tokens."""
    return pieces(stream_of(docs, id_col, text_col, tokenizer, window, end_id), id_col, with_ids)
