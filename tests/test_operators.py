import datetime
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import browse, filters, graph, ranking, sync
from lexigrove.plans import compiler
from lexigrove.sources import readers, sinks
from lexigrove.streaming import feeds


@pytest.fixture(scope="module")
def corpus(spark):
    long = "x" * 41
    rows = [
        (1, "Red fox", "", f"the quick {long} brown fox jumps"),
        (2, "Blue", "fox", "Straße über den café"),
        (3, "", "", "brown quick the fox"),
        (4, None, None, None),
    ]
    return spark.createDataFrame(rows, "id int, title string, headings string, body string")


FIELDS = {"title": "title", "headings": "headings", "body": "body"}


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("fox", [1, 2, 3]), ("title:fox", [1]), ("h:fox", [2]), ("*", [1, 2, 3, 4]), ("NOT fox", [4]), ('"quick brown"', []), ('"quick the fox"', [3]), ("quick w/1 brown", [1, 3]), ("quick w/0 brown", [3]), ("quick pre/1 brown", [1]),
        ("strasse", [2]), ("CAFÉ", [2]), ("f?x", [1, 2, 3]), ("bro*", [1, 3]), ("qiuck~", [1, 3]), ("uber-den", [2]), ("red-quick", []), ("(red OR blue) fox", [1, 2]), ('"brown quick" w/1 fox', [3]), ("(quick OR red) pre/5 jumps", [1]), ("title:fox w/2 body:fox", []),
    ],
)
def test_queries(corpus, query, ids):
    found = compiler.search(corpus, query, FIELDS, ("id",)).orderBy("id").collect()
    assert [r.id for r in found] == ids
    assert all(r.score > 0 for r in found)


def test_filter_values():
    for bad in ({"tags": ["t"] * 33}, {"tags": [""]}, {"year_min": 0}, {"year_min": 5, "year_max": 4}, {"seconds_min": float("nan")}, {"seconds_min": 9, "seconds_max": 1}):
        with pytest.raises(ValueError):
            filters.SearchFilters(**bad).validate()
    assert filters.glob_to_regex("a/**/*.md") == r"^a/(?:.*/)?[^/]*\.md$"


def test_globs(spark):
    rows = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("a/x.txt",), ("b.md",)], "p string")
    keep = filters.glob_filter(F.col("p"), ["a/**"], ["**/*.txt"])
    assert [r.p for r in rows.where(keep).orderBy("p").collect()] == ["a/b.md", "a/c/d.md"]


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "key string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "key string, rank int")
    got = [(r.key, r.score) for r in ranking.fuse({"a": a, "b": b}, "key", 3).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    rows = spark.createDataFrame([("p", None, 1), ("q", float("nan"), 2), ("r", 0.1, 3), ("s", 0.9, 4)], "k string, s double, place int")
    assert [r.k for r in ranking.rerank(rows, "s", "place").orderBy("new_rank").collect()] == ["s", "r", "p", "q"]


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(30)], "id bigint, vector array<float>")
    got = ranking.nearest(rows.where("id % 20 = 0"), rows, 3, block=7).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in (0, 20) for n in (1, 2, 3)]
    assert all(r.id != r.query_id for r in got)
    none = spark.createDataFrame([(1, [])], "id int, v array<array<double>>")
    assert none.select(ranking.maxsim([[1.0]], F.col("v")).alias("s")).first().s == 0


def test_chunks_keep_bytes(spark):
    text = "  Grüße aus\tKöln \n und  Straße "
    rows = ranking.chunks(spark.createDataFrame([(1, text), (2, " "), (3, None)], "id int, t string"), "t", 3, 1, "id").orderBy("chunk_index").collect()
    raw = text.encode()
    assert [(r.id, r.chunk_index, r.chunk) for r in rows] == [(1, 0, "Grüße aus\tKöln"), (1, 1, "Köln \n und  Straße"), (1, 2, "Straße")]
    assert all(raw[r.start_byte : r.end_byte].decode() == r.chunk for r in rows)


def test_components_and_hamming(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i % 7 != 6] + [(50, 40)], "a bigint, b bigint")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots[6] == 0 and roots[13] == 7 and roots[20] == 14 and roots[50] == 40
    rows = spark.createDataFrame([(1, 0), (2, 255), (3, 511), (4, -1), (5, 0)], "k bigint, h bigint")
    assert sorted((r.a, r.b, r.distance) for r in browse.hamming_pairs(rows, "k", "h", 8).collect()) == [(1, 2, 8), (2, 3, 1)]
    import random

    r = random.Random(5)
    hashes = [r.getrandbits(64) - 2**63 for _ in range(60)]
    hashes += [h ^ sum(1 << b for b in r.sample(range(63), r.randint(1, 9))) for h in hashes]
    for most in (0, 2, 4, 8):
        want = sorted((a, b, d) for a in range(120) for b in range(a + 1, 120) if (d := ((hashes[a] ^ hashes[b]) % 2**64).bit_count()) <= most and d)
        rows = spark.createDataFrame(list(enumerate(hashes)), "k bigint, h bigint")
        assert sorted((x.a, x.b, x.distance) for x in browse.hamming_pairs(rows, "k", "h", most).collect()) == want


def test_percentiles_and_running_sums(spark):
    rows = spark.createDataFrame([(float(i % 97),) for i in range(1000)] + [(None,)], "v double")
    values = sorted(float(i % 97) for i in range(1000))
    got = {r.fraction: r.value for r in browse.nearest_rank(rows, "v", 0.0, 0.5, 0.95, 1.0, ranges=7).collect()}
    assert got == {0.0: values[0], 0.5: values[499], 0.95: values[949], 1.0: values[999]}
    files = spark.createDataFrame([("a", f"{i:03}", i) for i in range(50)] + [(None, "x", 4), (None, "y", 5)], "g string, p string, size bigint").repartition(6)
    got = {(r.g, r.p): r.before for r in sync.running(files, ("p",), {"before": "size"}, "g").collect()}
    assert got == {("a", f"{i:03}"): i * (i - 1) // 2 for i in range(50)} | {(None, "x"): 0, (None, "y"): 4}


def test_clusters_assign_every_row(spark):
    rows = spark.createDataFrame([(i, [float(i // 5 * 10), float(i % 5)]) for i in range(15)], "id int, v array<double>")
    got = {r.id: r.cluster for r in browse.clusters(rows, "id", "v", 3).collect()}
    assert len(got) == 15 and len(set(got.values())) == 3 and all(len({got[i] for i in range(b, b + 5)}) == 1 for b in (0, 5, 10))


def test_shards_fill_in_order(spark):
    files = spark.createDataFrame([("g", f"f{i}", 10) for i in range(6)] + [("h", "x", 5)], "group string, path string, size bigint")
    got = {(r.group, r.path): r.shard for r in sync.shards(files, 3).collect()}
    assert [got["g", f"f{i}"] for i in range(6)] == [0, 0, 1, 1, 2, 2] and got["h", "x"] == 0


def test_push_needs_known_times(spark):
    kinds = "path string, size bigint, mtime bigint"
    local = spark.createDataFrame([("a", 1, 0), ("b", 1, 5), ("c", 2, 9)], kinds)
    remote = spark.createDataFrame([("b", 2, 4), ("c", 2, 9), ("d", 1, None)], kinds)
    assert {r.path: r.action for r in sync.compare_plans(local, remote, "newest_wins").collect()} == {"a": "local_only", "b": "use_local", "c": "unchanged", "d": "remote_only"}
    assert sorted(r.path for r in sync.push_plan(local, remote, "newest_wins").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sync.push_plan(local, spark.createDataFrame([("a", 3, 7)], kinds), "newest_wins")
    with pytest.raises(ValueError):
        sync.compare_plans(local, remote, "other")


def test_text_functions(spark):
    texts = spark.createDataFrame([("a <b> Foxes & fox",), ("x" * 500 + "fox" + "y" * 500,), ("  ",), ("no such word",), (None,)], "t string")
    shown = [r.s for r in texts.select(X.snippet(F.col("t"), "fox", 90).alias("s")).collect()]
    assert shown[0] == "a &lt;b&gt; <mark>Fox</mark>es &amp; <mark>fox</mark>"
    assert shown[1] == "…" + "x" * 30 + "<mark>fox</mark>" + "y" * 57 + "…" and shown[2:] == [None, "no such word", None]
    long = "Größe zählt überall sehr viel hier. " * 20
    rows = spark.createDataFrame([("kurz.",), (long,), ("é" * 200,), ("One is here for all. Two! Three? Four and so on and on.",)], "t string")
    short = [r.s for r in rows.select(X.summary(F.col("t"), 60).alias("s")).collect()]
    assert short[0] is None and short[1] == "Größe zählt überall sehr viel hier. Größe zählt…" and short[2] == "é" * 30 + "…" and short[3] == "One is here for all. Two! Three?"
    diff = X.word_diff("one two three", "one 2 three four")
    assert (diff["added"], diff["removed"], round(diff["ratio"], 3)) == (2, 1, round(3 / 7, 3))
    assert "".join(t for op, t in diff["segments"] if op != "added") == "one two three"
    assert X.merge_spans([(5, 9, 0.5), (1, 3, 0.2), (3, 6, 0.9)]) == [(1, 9, 0.9)]
    assert X.occurrence_ranges("Cat catalog cat", ["cat", "catalog"]) == [(0, 3), (4, 11), (12, 15)]
    assert X.occurrence_ranges("cat catalog", ["cat"], True) == [(0, 3)]


def test_passages_are_found_by_the_best_method(spark):
    from lexigrove.operators.passages import matched

    kinds = "item_id int, text string"
    items = spark.createDataFrame([(1, " magnificent castle stood there "), (2, "Hello, WORLD"), (3, "background the magnificient castle stood there"), (4, "zzzz yyyyyy xxxx"), (5, "  "), (6, "é"), (7, None)], kinds)
    docs = spark.createDataFrame([(1, "some long background; the magnificent castle stood there"), (2, "He said: “Hello,  World”"), (3, ""), (4, None), (5, "café"), (6, "CAFÉ É")], "doc_id int, text string")
    got = {(r.item_id, r.doc_id): (r.method, r.start) for r in matched(items, docs).collect()}
    assert got == {(1, 1): ("exact", 26), (2, 2): ("normalized", 2), (3, 1): ("fuzzy", 2), (6, 5): ("exact", 3), (6, 6): ("normalized", 0), (6, 1): got[6, 1], (6, 2): got[6, 2]}
    assert got[6, 1][0] == got[6, 2][0] == "normalized"  # folded to e


def worn_passages():
    """Passages with an edit in each third word, letters lost and doubled, words split, in texts of common syllables, and texts that are only like them."""
    import random

    r = random.Random(8)
    syllables = ["he", "on", "th", "an", "re", "er", "le", "de", "in", "es"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    items, docs = [], []
    for i in range(14):
        need = [word() for _ in range((4, 7, 12, 12, 30)[i % 5])]
        items.append((i, " ".join(need)))
        for share in (3, 2, 5):
            worn = [w[:-1] + "x" if k % share == 0 else w for k, w in enumerate(need)]
            docs.append(" ".join([word() for _ in range(r.randrange(40))] + worn + [word() for _ in range(r.randrange(40))]))
        lost = [w[1:] or "o" if k % 4 == 1 else w + w[-1] if k % 4 == 3 else w for k, w in enumerate(need)]
        docs.append(" ".join([word(), *lost, word()]))
        split = [w[:2] + " " + w[2:] if k == 2 and len(w) > 3 else w for k, w in enumerate(need)]
        docs.append(" ".join([word(), *split, word()]))
    items += [(100, "a"), (101, "ab"), (102, "thean"), (103, "!?"), (104, "ünïç thon heon")]
    return items, [(i, t) for i, t in enumerate([*docs, "unic thon hexn", "ab", "thxan", "", "so it is !? now"])] + [(900, None)]


def test_no_passage_is_lost(spark):
    """Against all runs of all documents that have a word of the passage unchanged near its place."""
    from lexigrove.functions.analysis import py_folded
    from lexigrove.operators.passages import FEW, LONG, matched

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    import re

    items, docs = worn_passages()
    lost = []
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", "", py_folded(t))).strip()
    want = {}
    for i, need in items:
        for d, text in docs:
            if text is None:
                continue
            p, n = plain(text), plain(need)
            if need in text:
                want[i, d] = ("exact", 1.0, text.index(need))
            elif n and n in p:
                want[i, d] = ("normalized", 1.0, p[: p.index(n)].count(" "))
            elif n:
                words, k = p.split(" "), len(n.split(" "))
                need_words = n.split(" ")
                anchors = [w for w in need_words if len(w) >= LONG or k < FEW] + [f"{a} {b}" for a, b in zip(need_words, need_words[1:], strict=False)]
                near = [(round(1 - edits(run, n) / max(len(run), len(n)), 6), -at, run) for at in range(len(words)) for run in [" ".join(words[at : at + k])] if run]
                best = max((x for x in near if x[0] >= 0.82), default=None)
                if best and any(f" {w} " in f" {best[2]} " for w in anchors):
                    want[i, d] = ("fuzzy", best[0], -best[1])
                elif best:
                    lost.append((n, best[2]))
    got = {(r.item_id, r.doc_id): (r.method, r.score, r.start) for r in matched(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == want and sum(m == "fuzzy" for m, *_ in want.values()) > 25
    assert all(not set(a.split(" ")) & set(b.split(" ")) for a, b in lost)  # no word is left as it was


def test_readers(spark, tmp_path):
    page = '<html><head><title>T</title><link rel="canonical" href="https://x.org/a"></head><body><h1>He<b>ad</b></h1><p>one</p><p style="display:none">no</p><div aria-hidden="true">no</div>two<script>no</script><img alt="pic"> &amp; three</body></html>'
    assert readers.html_parts(page) == ("Head one two pic & three", ["T", "Head"], "https://x.org/a")
    assert readers.decoded_html('<meta charset="latin-1">é'.encode("latin-1")).endswith("é")
    assert readers.text_parts("---\nurl: https://a.b\ntags: [x, y]\n---\n# One #\ntext\n## Two\n") == ("# One #\ntext\n## Two\n", ["One", "Two"], "https://a.b", ["x", "y"])
    clip = "﻿Book (Author)\r\n- Your Highlight on page 7 | Location 100-110 | Added on x\r\n\r\nshort text\r\n==========\r\nBook (Author)\r\n- Your Highlight on page 7 | Location 100-120\r\n\r\nshort text and more\r\n==========\r\nBook (Author)\r\n- Ihr Lesezeichen auf Seite 9\r\n\r\n\r\n==========\r\n"
    items = readers.clippings(clip)
    assert [(i["kind"], i["page"], i["start"]) for i in items] == [("highlight", 7, 100), ("highlight", 7, 100), ("bookmark", 9, None)]
    assert [i["text"] for i in readers.distinct_clippings(items)] == ["short text and more", ""]
    mail = b"From: a@b\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=x\n\n--x\nContent-Type: text/plain\n\nplain\n--x\nContent-Type: text/html\n\n<p>html</p>\n--x--\n"
    assert readers.mail_parts(mail)["text"] == "plain"
    assert len(readers.mailbox_messages(b"From a\nSubject: 1\n\nx\nFrom b\nSubject: 2\n\ny\n")) == 2
    feed = "<rss><channel><item><title>A</title><link>http://x</link><description>&lt;b&gt;t&lt;/b&gt;</description><pubDate>Mon, 1 Jan 2020</pubDate></item></channel></rss>"
    assert readers.feed_entries(feed) == [{"title": "A", "author": "", "year": "2020", "url": "http://x", "text": "t"}]
    inner, outer = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.tar", inner.getvalue())
        z.writestr("b.txt", "yo")
    assert [(p, b) for p, _, b in readers.members("z.zip", outer.getvalue())] == [("z.zip/a.tar/in.txt", b"hi"), ("z.zip/b.txt", b"yo")]
    with pytest.raises(ValueError):
        list(readers.members("z.zip", outer.getvalue(), count=1))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.md").write_text("# Hi\nthere")
    assert readers.texts(spark, f"{tmp_path}/in").first().headings == ["Hi"]
    assert readers.files(spark, f"{tmp_path}/in", hashed=True).first()["size"] == 10


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "=1+1"), (1, 'a"b')], "id int, title string")
    sinks.write_report(rows, f"{tmp_path}/r", ("id",), {"query": "q"})
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ['"1","a""b","q"', '"2","\'=1+1","q"']
    cited = sinks.bibtex(spark.createDataFrame([(1, "A & B", "Ann Müller", 2020), (2, "C", "Müller, Bo", 2020), (3, None, None, None)], "id int, title string, author string, year int")).collect()
    assert {r.id: r.key for r in cited} == {1: "Muller2020", 2: "Muller2020_2", 3: "anon"}
    tex = spark.createDataFrame([("50% \\ {x}_~",)], "t string").select(sinks.latex(F.col("t")).alias("t"))
    assert tex.first().t == r"50\% \textbackslash{} \{x\}\_\~{}"
    one = spark.createDataFrame([("c1", "a"), ("c2", "b")], "catalog string, path string")
    sinks.materialize_catalogue(one, f"{tmp_path}/cat")
    sinks.materialize_catalogue(spark.createDataFrame([("c1", "z")], "catalog string, path string"), f"{tmp_path}/cat")
    assert sorted((r.catalog, r.path) for r in spark.read.parquet(f"{tmp_path}/cat").collect()) == [("c1", "z"), ("c2", "b")]
    docs = spark.createDataFrame([("v", 1, [0.1]), ("w", 2, [0.2])], "volume_id string, id int, embedding array<double>")
    assert sinks.export_archive(docs, f"{tmp_path}/x", "v") == 1 and "embedding" not in spark.read.parquet(f"{tmp_path}/x").columns


def test_streams(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(5)), ("a", at(8)), ("a", at(11)), ("b", at(1))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    q = feeds.limited(stream, 2, 10).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.key, r.ts.second, r.admitted) for r in spark.table("admitted").collect())
    assert got == [("a", 0, True), ("a", 5, True), ("a", 8, False), ("a", 11, True), ("b", 1, True)]
    apply = feeds.upsert(f"{tmp_path}/table", ("key",), ("ts",))
    for _ in range(2):
        q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/c2-{_}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    last = spark.read.parquet(f"{tmp_path}/table/v0").collect()  # the same events again write no version
    assert sorted((r.key, r.ts.second) for r in last) == [("a", 11), ("b", 1)]


def test_short_passages_are_found(spark, tmp_path):
    import duckdb

    from lexigrove import catalog

    passages = ["alpha", "alpha beta", "alpha beta gam", "alpha beta gamma del", "lpha beta gamma delta eps", " beta gamma ", "--", "none of this"]
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["x alpha beta gamma delta epsilon y", "alpha beta", "Alpha Beta gamma", "a -- b", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["f11_passage_matches"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["f11_passage_matches"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 9


def test_citations_for_latex(spark):
    from lexigrove.sources import sinks

    rows = [(1, "A_b & {c}~^\\", "Müller-Lüdenscheidt, Ärna", 1999), (2, None, " Jane  Østby ", 1999), (3, "x", "n/a", None), (4, "x", "文", 1), (5, "y", "Østby", 1999), (6, "z", None, None)]
    got = {r.id: (r.key, r.entry) for r in sinks.bibtex(spark.createDataFrame(rows, "id int, title string, author string, year int")).collect()}
    assert {i: k for i, (k, _) in got.items()} == {1: "MullerLudenscheidt1999", 2: "Ostby1999", 3: "anon", 4: "item1", 5: "Ostby1999_2", 6: "anon_2"}
    assert r"title = {A\_b \& \{c\}\~{}\^{}\textbackslash{}}" in got[1][1]


def test_catalogues_come_and_go(spark, tmp_path):
    from lexigrove.sources import sinks

    entries = spark.createDataFrame([("a b/c", "x", 3), ("d", "y", 4), ("d", "z", 5)], "catalog string, path string, size bigint")
    sinks.materialize_catalogue(entries, f"{tmp_path}/all")
    assert {(r.catalog, r.files, r.size) for r in sinks.catalogues(spark, f"{tmp_path}/all").collect()} == {("a b/c", 1, 3), ("d", 2, 9)}
    assert sinks.drop_catalogue(spark, f"{tmp_path}/all", "a b/c") and not sinks.drop_catalogue(spark, f"{tmp_path}/all", "none")
    assert {r.catalog for r in sinks.catalogues(spark, f"{tmp_path}/all").collect()} == {"d"}
    sinks.write_catalogue(entries, f"{tmp_path}/one", "/root", "2024")
    head, back = sinks.read_catalogue(spark, f"{tmp_path}/one")
    assert head.first().files == 3 and sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
    entries.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/one/entries")
    with pytest.raises(ValueError):
        sinks.read_catalogue(spark, f"{tmp_path}/one")


def test_jobs_are_claimed_once_and_die_in_the_end(spark):
    from lexigrove.operators import records as K

    kinds = "id int, status string, priority int, due bigint, worker string, leased_until bigint, attempts int"
    jobs = spark.createDataFrame([(1, "queued", 1, 0, None, None, 0), (2, "queued", 9, 0, None, None, 4), (3, "queued", 9, 50, None, None, 0), (4, "taken", 5, 0, "w0", 5, 1), (5, "taken", 5, 0, "w0", 99, 1)], kinds)
    taken = K.claim(jobs, "w1", 10, 2, 60)
    assert {r.id: (r.status, r.worker, r.attempts) for r in taken.collect()} == {1: ("queued", None, 0), 2: ("taken", "w1", 5), 3: ("queued", None, 0), 4: ("taken", "w1", 2), 5: ("taken", "w0", 1)}
    results = spark.createDataFrame([(2, "w1", False), (4, "w1", False), (4, "w0", True), (5, "w0", True), (5, "w0", False)], "id int, worker string, ok boolean")
    told = K.settle(taken, results, 20)
    assert {r.id: (r.status, r.due, r.worker) for r in told.collect() if r.id in (2, 4, 5)} == {2: ("dead", 0, None), 4: ("queued", 140, None), 5: ("done", 0, None)}
    assert [r.id for r in K.dead_letters(told).collect()] == [2]
    assert {r.id: r.status for r in K.revive(told, [2], 30).collect()}[2] == "queued"
    queue = spark.createDataFrame([("a", "created", 1), ("a", "deleted", 2), ("b", "created", 1), ("b", "modified", 8), ("c", "deleted", 3)], "path string, event string, ts int")
    assert sorted(map(tuple, K.coalesced(queue).collect())) == [("b", "modified", 8, 2), ("c", "deleted", 3, 1)] and K.coalesced(queue, paused=True).count() == 0
    assert [r.path for r in K.due_for_dispatch(queue, 10).collect()] == ["c"]
    docs = spark.createDataFrame([(1, "failed", "x"), (2, "failed", "y"), (3, "done", None)], "id int, extraction string, error string")
    assert {r.id: (r.extraction, r.error) for r in K.retry_failed(docs, [1, 3]).collect()} == {1: ("pending", None), 2: ("failed", "y"), 3: ("done", None)}
    assert {r.id: (r.extraction, r.error) for r in K.retry_failed(docs, [1], skip=True).collect()}[1] == ("skipped", "x")


def test_results_are_kept_for_a_version(spark):
    from lexigrove.operators.cache import ResultCache

    cache, asked = ResultCache(spark, 2), []

    def run(n):
        def found():
            asked.append(n)
            return spark.range(n)

        return found

    for query, version in (("a", "1"), ("a", "1"), ("b", "1"), ("a", "1"), ("c", "1"), ("b", "1"), ("c", "2")):
        assert cache.get(query, "text", {"year": 1}, version, run(ord(query) - 94)).count() == ord(query) - 94
    assert asked == [3, 4, 5, 4, 5] and len(cache) == 1


def test_index_agrees_with_tokenising(spark, corpus, tmp_path):
    """Every kind of query over the index against the same query over plain rows, scores included; a changed source gets a new index."""
    from lexigrove.operators import postings

    index = postings.build(corpus, ("id",), FIELDS, f"{tmp_path}/index")
    for query in ("fox", "title:fox", "*", "NOT fox", '"quick the fox"', "quick w/1 brown", "quick pre/1 brown", "strasse", "f?x", "bro*", "qiuck~", "(red OR blue) fox", '"brown quick" w/1 fox', "fox NOT brown"):
        want = {r.id: round(r.score, 9) for r in compiler.search(corpus, query, FIELDS, ("id",)).collect()}
        assert {r.id: round(r.score, 9) for r in compiler.search(index, query, FIELDS, ("id",)).collect()} == want, query
    asked = spark.createDataFrame([(1, "fox"), (1, "quick"), (2, "strasse"), (3, "none")], "query_id int, term string")
    from lexigrove.plans.language import BOOSTS

    many = {(r.query_id, r.id): r.score for r in postings.search_many(index, asked, 10, BOOSTS).collect()}
    one = {(1, r.id): round(r.score, 6) for r in compiler.search(corpus, "fox OR quick", FIELDS, ("id",)).collect()}
    assert {k: v for k, v in many.items() if k[0] == 1} == one and {k[0] for k in many} == {1, 2}
    for n in (1, 2):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/source")
        source = spark.read.parquet(f"{tmp_path}/source")
        made = postings.opened(source, source.selectExpr("id", "concat('w', id) as body"), ("id",), {"body": "body"}, str(tmp_path))
        assert made.rows().count() == n


def test_few_runs_are_compared_with_a_passage():
    """Of the runs of unrelated texts of the same syllables few go to the comparison; all near ones do."""
    import random

    import pyarrow as pa

    from lexigrove.operators.passages import Passages, _found

    r = random.Random(5)
    syllables = ["he", "on", "th", "an", "re", "er", "le", "de", "in", "es", "ti", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    needs = [[word() for _ in range(36)] for _ in range(20)]
    docs = [" ".join([word() for _ in range(300)] + [w[:-1] + "x" if k % 3 == 0 else w for k, w in enumerate(needs[i])] + [word() for _ in range(300)]) for i in range(20)]
    block = Passages([" ".join(x) for x in needs], [" ".join(x) for x in needs], 0.82)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(docs), pa.array(docs)], ["doc", "text", "plain"])
    rows = [x for out in _found(iter([batch]), block, True) for x in out.to_pylist()]
    assert {(x["doc"], x["place"]) for x in rows if x["start"] == 300} >= {(i, i) for i in range(20)}
    assert len(rows) < 20 * 20 * 636 // 40


def test_groups_count_where_they_stand(monkeypatch):
    """A run with a passage's words in another order is not compared, nor one that has a group again and again; near ones are, however texts are cut."""
    import random

    import pyarrow as pa

    from lexigrove.operators import passages as P

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopé") for _ in range(r.randrange(5, 9)))
    needs = [[word() for _ in range(30)] for _ in range(8)]
    around = lambda own: " ".join([*(word() for _ in range(35)), *own, *(word() for _ in range(35))])
    near = [around([w[:-1] + "z" if k % 4 == 0 else w for k, w in enumerate(own)]) for own in needs]
    turned = [around(own[::-1]) for own in needs]
    again = [around([own[14]] * 30) for own in needs]
    docs = [*near, *turned, *again, "x" * 70_000 + " " + " ".join(needs[0]), "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs), pa.array(docs)], ["doc", "text", "plain"])
    plain = [*(" ".join(x) for x in needs), "", "ab", "q"]

    def found():
        return sorted(tuple(x.values()) for out in P._found(iter([batch]), P.Passages(plain, plain, 0.82), True) for x in out.to_pylist() if x["place"] < 8)

    rows = found()
    assert {(x[0], x[1]) for x in rows} == {*((i, i) for i in range(8)), (24, 0)}
    assert all((i, i, "fuzzy", 35) in {x[:4] for x in rows} for i in range(8))
    for name, value in (("TOGETHER", 50), ("DIRECT", 0), ("LOOKED_UP", 1)):
        monkeypatch.setattr(P, name, value)
        assert found() == rows
    none = P.Passages(["", "--"], ["", ""], 0.82)
    assert not [x for out in P._found(iter([batch]), none, True) for x in out.to_pylist() if x["method"] == "fuzzy"]


def test_exact_places_need_no_comparison(spark):
    from lexigrove.operators.passages import matched

    kinds = "item_id int, text string"
    items = spark.createDataFrame([(1, "the old castle stood there"), (2, "Hello, WORLD")], kinds)
    docs = spark.createDataFrame([(1, "xthe old castle stood therex"), (2, "hello world"), (3, "the old castle stands there")], "doc_id int, text string")
    assert [(r.item_id, r.doc_id, r.method, r.start) for r in matched(items, docs, fuzzy=False).collect()] == [(1, 1, "exact", 1)]


def test_hashes_that_are_alike_in_their_high_bits_meet_on_even_parts(spark):
    from collections import Counter

    h = [((i // 3) * 2654435761 * 97) ^ (1 << (i % 23)) for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(h)), "k bigint, h bigint")
    parts, n = browse._dealt_bits(rows)
    assert n == 3000
    assert sorted(j for own in parts for j in own) == list(range(64))
    alike = [max(Counter(x & sum(1 << j for j in own) for x in h).values()) for own in parts]
    assert max(alike) < 60 <= max(Counter(x >> 43 for x in h).values())
    want = sorted((a, b, (h[a] ^ h[b]).bit_count()) for a in range(300) for b in range(a + 1, 300) if (h[a] ^ h[b]).bit_count() <= 6 and h[a] != h[b])
    assert sorted((x.a, x.b, x.distance) for x in browse.hamming_pairs(rows.where("k < 300"), "k", "h", 6).collect()) == want


def test_top_terms_without_a_group_for_each_document(spark):
    """Scores against their definition, words that come again and null groups too; texts are read once and no document is a key."""
    import math
    from collections import Counter

    data = [("a", "Fox fox den"), ("a", "fox, elk"), ("b", "den den den owl"), (None, "owl elk elk"), ("b", ""), ("a", None), ("b", "owl late late late the the")]
    got = browse.top_terms(spark.createDataFrame(data, "g string, t string"), "g", "t", 2, words=5, stop=("the",))
    tf, df = Counter(), Counter()
    for g, t in data:
        own = [w for w in (t or "").lower().replace(",", "").split()[:5] if w != "the"]
        tf.update((g, w) for w in own)
        df.update(set(own))
    want = []
    for g in {g for g, _ in tf}:
        best = sorted((-round(n * math.log(len(data) / df[w]), 6), w) for (h, w), n in tf.items() if h == g)[:2]
        want += [(g, w, -s, k + 1) for k, (s, w) in enumerate(best)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and plan.count("regexp_extract_all") == 1
