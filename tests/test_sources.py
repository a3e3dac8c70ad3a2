"""Mailboxes that are read in splits, members that go out one by one, duplicate scans and pages."""

import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import browse as B
from lexigrove.operators.duplicates import duplicate_scan
from lexigrove.sources import readers as R


def box(r, n, end):
    """A mailbox of n messages, with lines that look like separators."""
    out = []
    for i in range(n):
        body = [r.choice(["short", "From: not one", ">From quoted", " From here", "Frömage", "word " * r.randrange(80), ""]) for _ in range(r.randrange(9))]
        lines = ["From a@b Thu Jan  1 00:00:00 1970", f"Subject: s{i}", "From: x@y", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: 8bit", "", *body, "", ""]
        out.append(end.join(lines))
    return "".join(out).encode()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_mailbox_in_splits(spark, tmp_path, end):
    """Whatever the size of a split: the messages of the whole file, each once."""
    r = random.Random(4)
    raw = {name: box(r, 60, end) for name in ("one", "two")}
    for name, data in raw.items():
        (tmp_path / f"{name}.mbox").write_bytes(data)
    (tmp_path / "three.mbox.gz").write_bytes(gzip.compress(raw["one"]))
    (tmp_path / "empty.mbox").write_bytes(b"")
    whole = sorted((name, *(R.mail_parts(m)[k] for k in ("subject", "sender", "text"))) for name in raw for m in R.mailbox_messages(raw[name]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (97, 1000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            read = R.mailboxes(spark, str(tmp_path))
            assert size == 1 << 27 or read.rdd.getNumPartitions() > 8
            got = read.where("problem is null").collect()
            assert sorted((x.path.rpartition("/")[2].removesuffix(".mbox"), x.subject, x.sender, x.text) for x in got) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    packed = R.mailboxes(spark, str(tmp_path), "*.gz").collect()
    assert sorted(x.text for x in packed) == sorted(x[3] for x in whole if x[0] == "one")


def test_members_go_out_in_parts(spark):
    data, broken = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(2500):
            z.writestr(f"m{i}", f"{i}")
        for i in range(3):
            z.writestr(f"big{i}", b"\0" * (9 << 20))
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("fine", "first")
        z.writestr("cut", "second")
    bad = bytearray(broken.getvalue().replace(b"second", b"sEcond"))
    files = spark.createDataFrame([(1, "a.zip", bytearray(data.getvalue())), (2, "b.zip", bad), (3, None, None)], "id int, name string, content binary")
    got = R.archive_members(files, "name", "content", "id").select("id", "member", F.length("body").alias("n"), "problem").collect()
    assert sum(x.id == 1 for x in got) == 2503 and {x.n for x in got if x.member and "big" in x.member} == {9 << 20}
    assert [(x.member, "CRC" in x.problem) for x in got if x.id == 2] == [(None, True)]
    over = R.archive_members(files.where("id = 1"), "name", "content", "id", count=2000).collect()
    assert [(x.member, "budget" in x.problem) for x in over] == [(None, True)]


def test_duplicate_scan(spark):
    same, other = "a" * 64, "B" * 64
    rows = [
        (0, "/x", 5, "ready", same), (1, "/y", 5, None, same.upper()), (2, "/x", 5, "ready", same), (3, "s3://b/x", 5, "ready", same),
        (4, "/z", 5, "moving", same), (5, "/z", 5, "ready", other), (6, "/v", 6, "ready", same), (7, "/w", None, "ready", same),
        (8, "/u", -1, "ready", same), (9, "/t", 99, "ready", same), (10, "/s", 5, "ready", "short"), (11, "/r", 5, "ready", None),
        (12, None, 5, "ready", other), (13, None, 5, "ready", other), (14, "/q", 0, "ready", same), (15, "/p", 0, "ready", same),
    ]
    items = spark.createDataFrame([(*r, "extra") for r in rows], "place int, path string, size bigint, status string, hash string, reason string")
    got = {r.place: (r.outcome, r.reason, r.group, r.members) for r in duplicate_scan(items, F.col("hash"), 50).collect()}
    assert len(got) == len(rows)
    assert got[0] == got[1] == ("duplicate", None, 0, 2) and got[5] == got[12] == got[13] == ("duplicate", None, 5, 3) and got[14] == got[15] == ("duplicate", None, 14, 2)
    assert got[6] == ("unique", None, None, None) and got[10] == got[11] == ("failed", "no SHA-256", None, None)
    assert {k: got[k][:2] for k in (2, 3, 4, 7, 8, 9)} == {2: ("skipped", "the path is in the list already"), 3: ("skipped", "remote document"), 4: ("skipped", "busy or sorted already"), 7: ("skipped", "size unknown"), 8: ("skipped", "size unknown"), 9: ("skipped", "too large to verify")}
    assert duplicate_scan(items.limit(0), F.col("hash")).collect() == []


def test_pages_to_the_end(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(53)], "num int, year int")
    met, cursor, pages = [], None, 0
    while True:
        found = B.paged(docs, "year", False, ("num",), 10, cursor)
        met += [r.num for r in found.rows.collect()]
        pages, cursor = pages + 1, found.next
        assert found.total == 53
        if cursor is None:
            break
    assert pages == 6 and met == [i for _, i in sorted(((9 if i % 7 == 0 else i % 5), i) for i in range(53))]
    assert B.paged(docs.where("num < 10"), "year", True, ("num",), 10).next is None
    assert B.paged(docs, "year", True, ("num",), 10, "60").rows.collect() == [] and B.paged(docs.limit(0), "year").next is None
    assert B.paged(docs, "year", True, ("num",), 0).rows.count() == 1 and B.paged(docs, "year", True, ("num",), 9999).rows.count() == 53
    for bad in ("-1", "x", ""):
        with pytest.raises(ValueError, match="cursor"):
            B.paged(docs, "year", cursor=bad)


def test_pages_are_parsed_in_small_parts(spark):
    from lexigrove.sources import readers

    rows = [(i, f"u{i}", None if i == 70 else f"<h1>H{i}</h1><p>text {i}</p>") for i in range(3 * readers.PAGES // 2)]
    got = sorted(map(tuple, readers.html_text(spark.createDataFrame(rows, "id bigint, url string, html string").coalesce(1), "html", "id", "url").collect()))
    assert got == [(i, u, *readers.html_parts(h or "")) for i, u, h in rows]
