"""Fill-in-middle: texts cut into prefix, middle and suffix and laid out again, by a parallel automaton scan.

An automaton reads UTF-8 bytes, counts code points (its units) as their last bytes come, and the marks of the format. A
stretch of bytes is summed up by what it does from each state: the state it ends in, and the units and marks on the way.
Two neighbouring stretches compose into one, and that is associative, so all blocks of 64 bytes are run at once from all
states, blocks compose to chunks, and chunks to texts; composition gives each block and chunk the state it is entered in
and the units before it. A cut after unit c then lies in the one block whose units reach c, which alone is run again.

Texts of one chunk at most are laid out where they are read. Longer ones are cut into chunks by bytes, anywhere, and the
chunks are dealt to all tasks; each emits its function. The functions of a text are composed (a few numbers a chunk),
each chunk is told its state and its units before, finds the cuts that are its own, and sends its parts on, which are
joined in the order of the form. Both ways give the same rows.

``form``: plain if the text is empty or holds a mark, or by the third number of the id's hash; else spm or psm by the
fourth. The first two numbers place the cuts.

Defined results: a null text is empty; a null id hashes as the empty string; rows of one id, and equal rows, are texts of
their own with the same cuts; an empty table gives no row. Other columns are not read.

Bounds: a text is one cell as input and as output; the functions of one text are 2 GB / chunk rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernels
from lexigrove.llm.base import same, text_or_empty, written

#: The format's marks, before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: Bytes of a block, and the byte that stands for none.
BLOCK, NONE = 64, 256
#: Marks are counted above the units.
MARK = 1 << 32


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is counted) by state * 257 + byte.

    States: 0 between code points; 1 after ``<``; 2 after ``<`` and the letter of a mark; 3, 4, 5 with one, two, three
    bytes of a code point to come.
    """
    step, count = np.zeros((6, 257), np.int32), np.zeros((6, 257), np.int64)
    for state in range(6):
        count[state, :128] = 1
        step[state, ord("<")] = 1
        step[state, 0xC0:0xE0], step[state, 0xE0:0xF0], step[state, 0xF0:0xF8] = 3, 4, 5
        if state > 2:
            step[state, 0x80:0xC0] = (0, 3, 4)[state - 3]
        step[state, NONE] = state
    count[3, 0x80:0xC0] = 1
    step[1, [ord(m[1]) for m in (P, S, M)]] = 2
    count[2, ord(">")] += MARK
    return step.ravel(), count.ravel()


STEP, COUNT = _automaton()
STATES = len(STEP) // 257


class Scan:
    """The automaton over many stretches of bytes at once, each from all states."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])  # the first block of each stretch
        self.owner = np.repeat(np.arange(len(size)), blocks)
        inside = np.arange(len(self.owner)) - self.first[self.owner]
        self.begin = at[self.owner] + inside * BLOCK
        self.at = at
        place = self.begin[:, None] + np.arange(BLOCK)
        full = place < at[self.owner + 1][:, None]
        self.bytes = np.full(place.shape, NONE, np.int16)
        self.bytes[full] = raw[place[full]]
        state = np.tile(np.arange(STATES, dtype=np.int32), (len(self.owner), 1))
        count = np.zeros(state.shape, np.int64)
        for column in np.ascontiguousarray(self.bytes.T):
            key = state * 257 + column[:, None]
            count += COUNT[key]
            state = STEP[key]
        # From the stretch's first block to each block, composing runs of twice the length each time.
        reach = 1
        while len(inside) and reach <= inside.max():
            later = np.flatnonzero(inside >= reach)
            before = state[later - reach]
            count[later] = count[later - reach] + np.take_along_axis(count[later], before, 1)
            state[later] = np.take_along_axis(state[later], before, 1)
            reach *= 2
        self.state, self.count = state, count

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """(end state, counts) of each stretch from each state."""
        n = len(self.first) - 1
        state, count = np.tile(np.arange(STATES, dtype=np.int32), (n, 1)), np.zeros((n, STATES), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        last = self.first[some + 1] - 1
        state[some], count[some] = self.state[last], self.count[last]
        return state, count

    def cuts(self, stretch: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """How many bytes of a stretch that is entered in a state end with its unit-th unit; unit is from 1 to all of them."""
        upto = np.zeros(len(self.owner), np.int64)
        entered = np.zeros(len(self.first) - 1, np.int64)
        entered[stretch] = entry
        upto[:] = self.count[np.arange(len(self.owner)), entered[self.owner]] % MARK
        total = np.zeros(len(self.first) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.first))
        total[some] = upto[self.first[some + 1] - 1]
        start = np.cumsum(total) - total
        block = np.searchsorted(start[self.owner] + upto, start[stretch] + unit)
        head = block == self.first[stretch]
        state = np.where(head, entry, self.state[block - 1, entry])
        left = unit - np.where(head, 0, upto[block - 1])
        found = np.zeros(len(unit), np.int64)
        for j in range(BLOCK):
            key = state * 257 + self.bytes[block, j]
            left = left - COUNT[key] % MARK
            found[(left <= 0) & (found == 0)] = j + 1
            state = STEP[key]
        return self.begin[block] + found - self.at[stretch]


def _form(n: np.ndarray, marks: np.ndarray, h: list[np.ndarray], plain: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, units before the first cut, before the second) of texts with n units."""
    form = np.where((n == 0) | (marks > 0) | (h[2] % 100 >= 100 - plain), "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return form, np.minimum(a, b), np.maximum(a, b)


def _output(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return b"".join((P.encode(), prefix, S.encode(), suffix, M.encode(), middle))
    return b"".join((S.encode(), suffix, P.encode(), prefix, M.encode(), middle))


def laid_out(batches: Iterator[pa.RecordBatch], plain: int, spm: int) -> Iterator[pa.RecordBatch]:
    """(id, n, form, prefix, middle, output) of texts that are read whole."""
    for batch in batches:
        texts = batch.column(1)
        for i, j in kernels.slices(texts):
            raw, at = kernels.bytes_of(texts.slice(i, j - i))
            scan = Scan(raw, at)
            count = scan.functions()[1][:, 0]
            n = count % MARK
            form, low, high = _form(n, count // MARK, [batch.column(c).slice(i, j - i).to_numpy() for c in range(2, 6)], plain, spm)
            bounds = np.zeros((2, j - i), np.int64)
            for row, unit in enumerate((low, high)):
                some = np.flatnonzero(unit)
                bounds[row, some] = scan.cuts(some, np.zeros(len(some), np.int64), unit[some])
            data, out = raw.tobytes(), []
            for k in range(j - i):
                a, b, c, d = at[k], at[k] + bounds[0, k], at[k] + bounds[1, k], at[k + 1]
                out.append(_output(form[k], data[a:b], data[b:c], data[c:d]))
            cut = form != "plain"
            cols = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(form.astype(object), pa.string()), pa.array(low, mask=~cut), pa.array(high - low, mask=~cut), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "form", "prefix", "middle", "output"])


def chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, digest, chunk, data): a text by bytes. Rows of a few megabytes go out at a time."""
    per = max(1, (4 << 20) // size)
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column(1)[k].as_buffer() if batch.num_rows else None
            own, digest, n = batch.column(0).slice(k, 1), hashlib.sha256(data).hexdigest(), -(-data.size // size)
            for i in range(0, n, per):
                part = [data.slice(c * size, min(size, data.size - c * size)).to_pybytes() for c in range(i, min(i + per, n))]
                cols = [own.take(pa.array(np.zeros(len(part), np.int64))), pa.array([digest] * len(part)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "chunk", "data"])


def _binary_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in kernels.slices(column):
        yield i, j, *kernels.bytes_of(column.slice(i, j - i))


def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each chunk's function."""
    for batch in batches:
        for i, j, raw, at in _binary_slices(batch.column(batch.schema.get_field_index("data"))):
            state, count = Scan(raw, at).functions()
            cols = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(state.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(count), pa.list_(pa.int64()))], [*batch.schema.names, "state", "count"])


def composed(table: pa.Table) -> pa.Table:
    """(id, digest, chunk, entry, before, total): the functions of one text's chunks, composed in order."""
    table = table.sort_by("chunk")
    state, count = (np.array(table.column(c).to_pylist(), np.int64).reshape(-1, STATES) for c in ("state", "count"))
    entry, before, now, met = np.zeros(len(state), np.int32), np.zeros(len(state), np.int64), 0, 0
    for k in range(len(state)):
        entry[k], before[k] = now, met
        now, met = int(state[k, now]), met + int(count[k, now])
    return pa.table([table.column("id"), table.column("digest"), table.column("chunk"), pa.array(entry), pa.array(before % MARK), pa.array(np.full(len(state), met))], ["id", "digest", "chunk", "entry", "before", "total"])


def parted(batches: Iterator[pa.RecordBatch], plain: int, spm: int) -> Iterator[pa.RecordBatch]:
    """A chunk's parts: (id, digest, copies, n, form, prefix, middle, place in the form, chunk, part)."""
    names = ["id", "digest", "copies", "n", "form", "prefix", "middle", "place", "chunk", "part"]
    for batch in batches:
        get = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        for i, j, raw, at in _binary_slices(get["data"]):
            own = {c: v.slice(i, j - i) for c, v in get.items()}
            entry, before, total = (own[c].to_numpy().astype(np.int64) for c in ("entry", "before", "total"))
            n = total % MARK
            form, low, high = _form(n, total // MARK, [own[f"h{k}"].to_numpy() for k in range(1, 5)], plain, spm)
            scan = Scan(raw, at)
            units = scan.functions()[1][np.arange(j - i), entry] % MARK
            bounds = []
            for unit in (low, high):
                # A cut lies in the chunk where its unit ends; chunks after that begin beyond it.
                cut = np.where(unit > before + units, np.diff(at), 0)
                mine = np.flatnonzero((unit > before) & (unit <= before + units))
                cut[mine] = scan.cuts(mine, entry[mine], (unit - before)[mine])
                bounds.append(cut)
            data, rows, place, parts = raw.tobytes(), [], [], []
            for k in range(j - i):
                a, b, c, d = at[k], at[k] + bounds[0][k], at[k] + bounds[1][k], at[k + 1]
                order = {"plain": (0, 1, 2), "psm": (0, 2, 1), "spm": (1, 2, 0)}[form[k]]
                for where, part in zip(order, (data[a:b], data[b:c], data[c:d]), strict=True):
                    if part:
                        rows.append(k)
                        place.append(where)
                        parts.append(part)
            taken = pa.array(np.array(rows, np.int64))
            shared = [own["id"], own["digest"], own["copies"], pa.array(n), pa.array(form.astype(object), pa.string()), pa.array(low), pa.array(high - low)]
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in shared), pa.array(np.array(place, np.int32)), own["chunk"].take(taken), pa.array(parts, pa.binary())], names)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", plain: int = 10, spm: int = 20, chunk: int = 1 << 16) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output), a row for each row of docs; ``plain`` and ``spm`` in hundredths."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *h)
    short = rows.where(F.octet_length("text") <= chunk).mapInArrow(kernels.lean(lambda x: laid_out(x, plain, spm)), f"id {kind}, n bigint, form string, prefix bigint, middle bigint, output string")
    own = f"id {kind}, digest string, chunk int"
    long = rows.where(F.octet_length("text") > chunk).select("id", "text").mapInArrow(kernels.lean(lambda x: chunked(x, chunk)), f"{own}, data binary")
    dealt = long.groupBy("id", "digest", "chunk").agg(F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"))
    chunks = written(dealt.mapInArrow(kernels.lean(summed_up), f"{own}, copies bigint, data binary, state array<int>, count array<bigint>"))
    known = chunks.select("id", "digest", "chunk", "state", "count").groupBy("id", "digest").applyInArrow(composed, f"{own}, entry int, before bigint, total bigint").alias("k")
    told = chunks.drop("state", "count").alias("c").join(known, same(F.col("c.id"), F.col("k.id")) & (F.col("c.digest") == F.col("k.digest")) & (F.col("c.chunk") == F.col("k.chunk")))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("c.id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    told = told.select("c.id", "c.digest", "c.chunk", "copies", "data", "entry", "before", "total", *h)
    parts = told.mapInArrow(kernels.lean(lambda x: parted(x, plain, spm)), f"id {kind}, digest string, copies bigint, n bigint, form string, prefix bigint, middle bigint, place int, chunk int, part binary")
    joined = parts.groupBy("id", "digest").agg(*(F.first(c).alias(c) for c in ("copies", "n", "form", "prefix", "middle")), F.sort_array(F.collect_list(F.struct("place", "chunk", "part"))).alias("parts"))

    def of(place: int) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda x: x["place"] == place), lambda x: x["part"].cast("string")), "")

    marked = [F.concat(F.lit(a), of(0), F.lit(b), of(1), F.lit(M), of(2)) for a, b in ((P, S), (S, P))]
    output = F.when(F.col("form") == "psm", marked[0]).when(F.col("form") == "spm", marked[1]).otherwise(F.concat(of(0), of(1), of(2)))
    cut = F.col("form") != "plain"
    whole = joined.select("id", "n", "form", F.when(cut, F.col("prefix")).alias("prefix"), F.when(cut, F.col("middle")).alias("middle"), output.alias("output"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return short.unionByName(whole).select(F.col("id").alias(id_col), "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text, from what was laid out and its form; texts with marks are plain, so each mark is there once."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
