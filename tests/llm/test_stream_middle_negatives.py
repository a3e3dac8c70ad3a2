"""Concatenated packing, fill-in-middle and hard negatives against definitions, and tables of several threads."""

import collections
import hashlib
import itertools
import math
import random
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import fill_middle, hard_negatives, token_stream
from tests.llm.fixtures import CLASH, documents, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ODD = [chr(c) for c in (*range(0x250), 0x85, 0xA0, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x4E2D, 0x1F600, 0x300, 0x660)]
PARTS = [" ", "  ", "\n", "\t", "'s", "'ll", "a", "B1", "<|endoftext|>", "é", "!!", "?", "12", "<P>", "<", "<S", ">", "M>"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) if r.random() < 0.4 else r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(n)]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    encode, plain = token_stream.Encoder(path()), Tokenizer.from_file(path())
    assert encode._ranked(path()) is not None  # by ranks, not by the tokenizer itself
    for text in [*odd_texts(4000, 1), "a" * 3000, " " * 3000, "\n" * 500 + "x"]:
        assert np.frombuffer(encode(text), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")
    assert token_stream.Encoder._ranked(other) is None
    assert np.frombuffer(token_stream.Encoder(other)("Some words"), "<u2").tolist() == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_concatenated_packing(spark, docs, window):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path())
    rows = documents() if window > 1 else documents()[:40]
    table = docs if window > 1 else frame(spark, rows).repartition(3)
    stream = token_stream.stream_of(table, window=window)
    got = token_stream.pieces(stream, with_ids=True).collect()
    want = collections.Counter((r[0], tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    # Sequences are gapless from 0, and full or powers of two; at most one of each such power.
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own[:-1])]
        sizes.append(sum(r.length for r in own))
    assert sum(sizes) == total and sizes.count(window) >= total // window
    rest = [s for s in sizes if s != window]
    assert all(s & (s - 1) == 0 for s in rest) and len(rest) == len(set(rest)) == bin(total % window).count("1")
    # Pieces of a document follow each other in the stream, so its ids are there once; rows of one id count.
    place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    found, now = collections.Counter(), []
    for r in place:
        assert r.start == len(now)
        now += r.ids
        if len(now) == r.doc_tokens:
            found[r.doc_id, tuple(now)] += 1
            now = []
    assert found == want and not now
    whole = {r.sequence_id: r.ids for r in token_stream.sequences(stream).collect()}
    assert whole == {s: [i for r in own for i in r.ids] for s, own in by_sequence.items()}


def test_concatenated_packing_edges(spark, docs):
    assert token_stream.pack_stream(docs.limit(0)).collect() == [] and token_stream.sequences(token_stream.stream_of(docs.limit(0))).count() == 0
    rows = frame(spark, [(None, None, None, None, 0, *CLASH), (None, "", None, None, 0, *CLASH)]).withColumn("task", F.lit("clash"))
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in token_stream.pack_stream(rows).collect()] == [(None, 0, 1, 1)] * 2
    named = spark.createDataFrame([("x", "one two")], "name string, body string")
    assert token_stream.pack_stream(named, "name", "body").first().name == "x"
    long = spark.createDataFrame([(1, "the same words " * 40_000)], "doc_id bigint, text string")
    got = sorted(token_stream.pack_stream(long).collect(), key=lambda r: r.start)
    assert got[-1].start + got[-1].length == got[0].doc_tokens and [r.start for r in got[1:]] == list(itertools.accumulate(r.length for r in got[:-1]))


def runs_of(stream, rows, split):
    """The sequences of fragments() over batches cut in odd places."""
    table = pa.Table.from_pylist(rows, pa.schema([("task", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())]))
    return [r for b in token_stream.fragments(iter(table.to_batches(split)), stream) for r in b.to_pylist()]


def test_long_runs_end_at_bounds():
    """A task with more than a thousand windows gives them up on the way, and loses nothing."""
    own = object.__new__(token_stream.Stream)
    n = 5000
    own.tasks, own.starts, own.window, own.full = np.array([0]), np.array([3]), 2, (n + 3) // 2
    own.tail = np.array([own.full * 2, n + 3]) if (n + 3) % 2 else np.array([own.full * 2])
    rows = [{"task": 0, "at": at, "n": 10, "width": 2, "ids": np.arange(at, at + 10, dtype="<u2").tobytes()} for at in range(0, n, 10)]
    found = runs_of(own, rows, 37)
    ids = [i for r in sorted(found, key=lambda r: (r["sequence"], r["place"])) for i in r["ids"]]
    assert ids == list(range(n)) and sum(not r["whole"] for r in found) <= 1


# Fill in the middle.


def middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by definition."""
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_fill_middle(spark, docs, chunk):
    """Chunks of one byte cut every code point and every mark."""
    rows = [(r[0], r[1]) for r in documents()] if chunk > 1 else [(r[0], r[1]) for r in documents() if len(r[1] or "") < 400]
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts(60 if chunk < 5 else 300, 7))] + [(None, "no id"), (5000, "<" + "P" * 70 + ">"), (5001, "x" * 62 + "<S>"), (5002, "é" * 63 + "<M" + ">"), (5003, "𝄞" * 100)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = fill_middle.fill_middle(table, chunk=chunk)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    found = collections.Counter(tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect())
    assert found == collections.Counter((i, *middle(i, t), t or "") for i, t in rows)
    assert {f for _, _, f, *_ in found} == {"plain", "psm", "spm"}


def test_fill_middle_edges(spark, docs):
    assert fill_middle.fill_middle(docs.limit(0)).collect() == []
    clash = frame(spark).withColumns({c: F.lit(1) for c in ("n", "form", "output", "digest", "chunk", "h1")})
    assert fill_middle.fill_middle(clash, chunk=50).count() == len(documents())
    long = spark.createDataFrame([(3, "long é " * 60_000)] * 2, "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in fill_middle.fill_middle(long, chunk=4096).collect()]
    assert got == [middle(3, "long é " * 60_000)] * 2


def test_functions_compose():
    """A stretch's function is that of its halves, from every state, wherever it is cut."""
    for text in odd_texts(60, 9):
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = fill_middle.Scan(raw, np.array([0, len(raw)])).functions()
        for cut in {0, len(raw) // 3, len(raw) // 2, len(raw)}:
            state, count = fill_middle.Scan(raw, np.array([0, cut, len(raw)])).functions()
            assert (state[1][state[0]] == whole[0][0]).all() and (count[0] + count[1][state[0]] == whole[1][0]).all()


# Hard negatives.


def mined(rows, positives=5, negatives=10):
    """By definition, with Python's integers."""
    use = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(256 * x) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  the shorter is filled up with zeros
    last = lambda i: math.inf if i is None else i
    out = collections.Counter()
    for i, v, label in use:
        if i is None or i % 100:
            continue
        near = sorted(((-dot(v, w), last(j)) for j, w, other in use if other == label and j != i))[:positives]
        for minus, j in near:
            ps = -minus
            far = sorted((-dot(v, w), last(k)) for k, w, other in use if other != label and 30 * ps <= 100 * dot(v, w) <= 90 * ps)[:negatives]
            out.update((i, j, rank, k, ps, -s) for rank, (s, k) in enumerate(far, 1))
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, v int, rank int")
    none = lambda x: math.inf if x is None else x
    got = hard_negatives.mine(table.repartition(3), F.col("id") % 100 == 0, **more)
    return collections.Counter((r.anchor_id, none(r.positive_id), r.rank, none(r.negative_id), r.positive_score, r.negative_score) for r in got.collect())


def vectors(n, seed):
    r = random.Random(seed)
    centre = [[r.choice((-0.5, 0.25, 0.75)) for _ in range(6)] for _ in range(3)]
    return [(i, [c + r.gauss(0, 0.25) for c in centre[i % 3]], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("digit_bits,few,batch", [(12, 64, 4096), (3, 0, 2), (1, 1, 1)])
def test_hard_negatives(spark, digit_bits, few, batch):
    """Narrow digits and no slack take the selection through all of its rounds."""
    rows = vectors(320, 1)
    r = random.Random(2)
    for i in range(320, 420):  # ties: one vector, many ids
        rows.append((i, rows[0][1], r.randrange(2)))
    rows += [(430, None, 1), (431, [0.5] * 6, None), (432, [0.5] * 5 + [None], 1), (433, [0.5] * 5 + [math.nan], 1), (434, [math.inf] + [0.5] * 5, 1)]
    rows += [(None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (440, [0.5] * 3, 0), (441, [], 1), rows[7], rows[7], rows[100], (500, [0.0] * 6, 1), (600, [-1.0] * 6, 2)]
    want = mined([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert len(want) > 100
    assert found(spark, rows, digit_bits=digit_bits, few=few, batch=batch) == want


def test_hard_negatives_edges(spark):
    assert found(spark, []) == found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == found(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == {}
    large = [(100, [2.0**18, 1.0], 1), (1, [2.0**18, 0.5], 1), (2, [2.0**17 + 3, 0.5], 2), (3, [2.0**17, 0.25], 2)]  # integers over 2**53
    assert found(spark, large) == mined(large)
    with pytest.raises(ValueError, match="2\\*\\*62"):
        found(spark, [(100, [2.0**30], 1)])


def test_scratch_tables_belong_to_their_thread(spark, docs):
    from lexigrove.llm.exact_dedup import exact_dedup

    wrong, done = [], []

    def run():
        try:
            done.append(sorted(map(str, exact_dedup(docs).collect())))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=run) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and all(d == done[0] for d in done) and len(done) == 4


