"""Readers: folders of files, plain text and Markdown, HTML, mail, feeds, archives, clippings."""

from __future__ import annotations

import email
import email.policy
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = set("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
PAGE = "text string, headings array<string>, url string"


def files(spark: SparkSession, folder: str, hashed: bool = False, glob: str | None = None) -> DataFrame:
    """(path, size, modified, sha256 if asked for) of every file below folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (read.option("pathGlobFilter", glob) if glob else read).load(folder)
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return rows.select(*columns, *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def text_parts(raw: str) -> tuple[str, list[str], str | None, list[str]]:
    """(text, headings, url, tags) of plain text or Markdown with front matter."""
    url, tags, body = None, [], raw
    if m := re.match(r"﻿?---\r?\n(.*?)\r?\n---\r?\n?", raw, re.DOTALL):
        body = raw[m.end() :]
        for line in m[1].splitlines():
            key, _, value = line.partition(":")
            value = value.strip().strip("\"'")
            if key.strip().lower() in ("url", "source") and value.startswith(("http://", "https://")):
                url = value
            elif key.strip().lower() == "tags":
                tags = [t.strip().strip("\"'") for t in value.strip("[]").split(",") if t.strip()]
    headings = [m[2].strip().rstrip("#").strip() for m in re.finditer(r"^(#{1,6})[ \t]+(.+)$", body, re.MULTILINE)]
    return body, [h for h in headings if h], url, tags


def texts(spark: SparkSession, folder: str, glob: str = "*.{md,txt}") -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [text_parts(bytes(c).decode(errors="replace")) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], **{n: [g[i] for g in got] for i, n in enumerate(("text", "headings", "url", "tags"))}})

    return rows.mapInPandas(run, "path string, text string, headings array<string>, url string, tags array<string>")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.out: list[str] = []
        self.heading: list[str] | None = None
        self.headings: list[str] = []
        self.url: str | None = None

    @staticmethod
    def _hides(tag: str, attrs: dict) -> bool:
        if tag in SKIPPED or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        for part in (attrs.get("style") or "").split(";"):
            name, _, value = part.partition(":")
            if (name.strip().lower(), value.split("!")[0].strip().lower()) in (("display", "none"), ("visibility", "hidden"), ("content-visibility", "hidden")):
                return True
        return False

    @property
    def hidden(self) -> bool:
        return any(h for _, h in self.stack)

    def _say(self, text: str, title: bool = False) -> None:
        if not self.hidden:
            if not title:
                self.out.append(text)
            if self.heading is not None:
                self.heading.append(text)

    def handle_starttag(self, tag: str, attrs_: list) -> None:
        attrs = dict(attrs_)
        if tag in BLOCKS:
            self._say(" ")
        if tag == "link" and "canonical" in (attrs.get("rel") or "").lower().split():
            self._found(attrs.get("href"))
        if tag == "meta" and (attrs.get("property") or "").lower() == "og:url":
            self._found(attrs.get("content"))
        if tag == "img" and attrs.get("alt") and not self._hides(tag, attrs):
            self._say(f" {attrs['alt']} ")
        if tag not in VOID:
            self.stack.append((tag, self._hides(tag, attrs)))
            if re.fullmatch("h[1-6]|title", tag) and self.heading is None:
                self.heading = []

    def _found(self, url: str | None) -> None:
        if self.url is None and url and url.strip().startswith(("http://", "https://")):
            self.url = url.strip()

    def handle_endtag(self, tag: str) -> None:
        if tag in [t for t, _ in self.stack]:
            if re.fullmatch("h[1-6]|title", tag) and self.heading is not None:
                text = " ".join("".join(self.heading).split())
                self.headings += [text] * bool(text)
                self.heading = None
            while self.stack.pop()[0] != tag:
                pass
        if tag in BLOCKS:
            self._say(" ")

    def handle_data(self, data: str) -> None:
        self._say(data, any(t in ("head", "title") for t, _ in self.stack))


def html_parts(raw: str) -> tuple[str, list[str], str | None]:
    """(visible text, headings, canonical url): blocks are apart by a space, inline elements do not split words."""
    parser = _Visible()
    parser.feed(raw)
    parser.close()
    return " ".join("".join(parser.out).split()), parser.headings, parser.url


def decoded_html(data: bytes) -> str:
    """By byte-order mark, declared character set, UTF-8, or Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if m := re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", data[:8192], re.IGNORECASE):
        try:
            return data.decode(m[1].decode(), "replace")
        except LookupError:
            pass
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


#: Pages that a task holds parsed at once.
PAGES = 64


def html_text(rows: DataFrame, html: str, *keep: str) -> DataFrame:
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.list_(pa.string()), pa.string()
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                part = b.slice(i, PAGES)
                got = [html_parts(h or "") for h in part.column(len(keep)).to_pylist()]
                read = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *read], [*keep, "text", "headings", "canonical"])

    return rows.select(*keep, html).mapInArrow(run, f"{kinds}, text string, headings array<string>, canonical string")


def mail_parts(raw: bytes) -> dict:
    """subject, sender and text of a message; plain parts go before HTML ones, attached messages are read too."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    texts_, pages = [], []
    for part in message.walk():
        if part.get_content_maintype() == "text" and not part.get_filename():
            try:
                body = part.get_content()
            except (LookupError, ValueError):
                body = part.get_payload(decode=True).decode(errors="replace")
            (pages if part.get_content_subtype() == "html" else texts_).append(body)
    body = "\n".join(texts_) if any(t.strip() for t in texts_) else "\n".join(html_parts(p)[0] for p in pages)
    return {"subject": str(message["subject"] or ""), "sender": str(message["from"] or ""), "text": body.strip()}


def mailbox_messages(raw: bytes) -> list[bytes]:
    """The messages of an MBOX file."""
    parts = re.split(rb"(?m)^From .*\r?\n", raw)
    return [re.sub(rb"(?m)^>From ", b"From ", p) for p in parts if p.strip()]


def feed_entries(raw: str) -> list[dict]:
    """Entries of RSS, Atom or JSON feeds: title, author, year, url, text."""
    if raw.lstrip().startswith("{"):
        import json

        return [{"title": i.get("title", ""), "author": (i.get("author") or {}).get("name", ""), "year": (i.get("date_published") or "")[:4], "url": i.get("url", ""), "text": i.get("content_text") or html_parts(i.get("content_html") or "")[0]} for i in json.loads(raw).get("items", [])]
    root = ElementTree.fromstring(raw)
    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for entry in root.iter():
        if name(entry) in ("item", "entry"):
            get = lambda *names, e=entry: next(((x.text or (x.find("{*}name").text if x.find("{*}name") is not None else "") or x.get("href") or "") for x in e if name(x) in names), "")
            date = re.search(r"\b(\d{4})\b", get("pubDate", "published", "updated"))
            out.append({"title": get("title").strip(), "author": get("author", "creator").strip(), "year": date[1] if date else "", "url": get("link").strip(), "text": html_parts(get("content", "description", "summary", "encoded"))[0]})
    return out


def members(name: str, data: bytes, depth: int = 4, count: int = 10_000, size: int = 256 << 20) -> Iterator[tuple[str, int, bytes]]:
    """(path, occurrence, bytes) of the leaf members of nested ZIP, TAR and GZIP files, within the budgets."""
    left = [count, size]

    def walk(path: str, raw: bytes, level: int) -> Iterator[tuple[str, bytes]]:
        inner: Iterator[tuple[str, bytes]] | None = None
        if level < depth and zipfile.is_zipfile(io.BytesIO(raw)):
            z = zipfile.ZipFile(io.BytesIO(raw))
            inner = ((i.filename, z.open(i).read(left[1] + 1)) for i in z.infolist() if not i.is_dir())
        elif level < depth and (raw[:2] == b"\x1f\x8b" or raw[257:262] == b"ustar"):
            try:
                t = tarfile.open(fileobj=io.BytesIO(raw))
                inner = ((m.name, t.extractfile(m).read(left[1] + 1)) for m in t if m.isfile())
            except tarfile.ReadError:
                import gzip

                inner = iter([(path.rpartition("/")[2].removesuffix(".gz"), gzip.open(io.BytesIO(raw)).read(left[1] + 1))])
        if inner is None:
            yield path, raw
            return
        for member, body in inner:
            left[0] -= 1
            left[1] -= len(body)
            if left[0] < 0 or left[1] < 0:
                raise ValueError("the archive goes beyond its budget")
            yield from walk(f"{path}/{member}", body, level + 1)

    met: dict[str, int] = {}
    for path, body in walk(name, data, 0):
        yield path, met.setdefault(path, 0), body
        met[path] += 1


#: Words of reading devices' clipping files, by what they mark.
KINDS = (("bookmark", ("bookmark", "lesezeichen", "signet", "marcador")), ("note", ("note", "notiz", "nota")))


def clippings(raw: str) -> list[dict]:
    """Records of a clippings file: title, author, kind, page, location range, text."""
    out = []
    for record in raw.lstrip("﻿").split("=========="):
        lines = record.strip("\r\n").splitlines()
        if len(lines) < 2 or not lines[0].strip():
            continue
        title, meta, body = lines[0].strip().lstrip("﻿"), lines[1], "\n".join(lines[2:]).strip("\r\n")
        m = re.fullmatch(r"(.*?)\s*\(([^()]*)\)", title)
        low = meta.lower()
        kind = next((k for k, words in KINDS if any(w in low for w in words)), "highlight")
        item = {"title": m[1] if m else title, "author": m[2] if m else None, "kind": kind, "page": None, "start": None, "end": None, "text": body}
        for field in meta.split("|"):
            f, numbers = field.lower(), [int(x) for x in re.findall(r"\d+", field)]
            if numbers and any(w in f for w in ("page", "seite", "página")):
                item["page"] = numbers[0]
            elif numbers and any(w in f for w in ("location", "position", "pos.", "emplacement")):
                item["start"], item["end"] = numbers[0], numbers[1] if len(numbers) > 1 else None
        if body.strip() or kind == "bookmark":
            out.append(item)
    return out


def distinct_clippings(items: list[dict]) -> list[dict]:
    """Of clippings of one title and kind whose texts contain each other the longest, in order of the first."""
    kept: list[dict] = []
    for c in items:
        for i, k in enumerate(kept):
            if (k["title"], k["kind"]) == (c["title"], c["kind"]) and c["text"] and k["text"] and (c["text"] in k["text"] or k["text"] in c["text"]):
                if len(c["text"]) > len(k["text"]):
                    kept[i] = c
                break
        else:
            kept.append(c)
    return kept


# The parsers over rows of files. A file that cannot be read gives one row that says so in ``problem``; the others go on.


#: What is read of a file before it goes out.
SENT, SENT_BYTES = 1000, 16 << 20


def parsed(rows: DataFrame, columns: list[str], parse: Callable[..., Iterable[dict]], fields: str, *keep: str) -> DataFrame:
    """The columns of ``keep``, ``fields`` and ``problem``: a row for each record that ``parse`` finds in the ``columns`` of a row.

    Records go out as they are read, at most SENT of them or SENT_BYTES and one more at a time.
    """
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    arrow = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}

    def records(*given) -> Iterator[tuple[dict, str | None]]:
        try:
            for found in parse(*given):
                yield found, None
        except Exception as e:  # noqa: BLE001 whatever a damaged file does to its parser
            yield {}, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(len(keep) + i) for i in range(len(columns))]
            for r in range(batch.num_rows):  # a file at a time, as its members can be many times its size
                held, size = [], 0
                for found in records(*(c[r].as_py() for c in inputs)):
                    held.append(found)
                    size += sum(len(v) for v in found[0].values() if isinstance(v, (str, bytes)))
                    if len(held) >= SENT or size >= SENT_BYTES:
                        yield sent(batch, r, held)
                        held, size = [], 0
                if held:
                    yield sent(batch, r, held)

    def sent(batch: pa.RecordBatch, r: int, held: list[tuple[dict, str | None]]) -> pa.RecordBatch:
        own = [batch.column(i).take(pa.array([r] * len(held))) for i in range(len(keep))]
        read = [pa.array([f.get(n) for f, _ in held], arrow[k]) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*own, *read, pa.array([p for _, p in held], pa.string())], [*keep, *names, "problem"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.select(*keep, *(F.col(c).alias(f"_in{i}") for i, c in enumerate(columns))).mapInArrow(run, f"{kept}{fields}, problem string")


def mails(rows: DataFrame, content: str, *keep: str) -> DataFrame:
    """A row for each message of EML and MBOX files (binary)."""

    def parse(raw: bytes | None) -> list[dict]:
        raw = bytes(raw or b"")
        return [mail_parts(m) for m in (mailbox_messages(raw) if raw.startswith(b"From ") else [raw] if raw else [])]

    return parsed(rows, [content], parse, "subject string, sender string, text string", *keep)


def mailboxes(spark: SparkSession, folder: str, glob: str = "*.mbox") -> DataFrame:
    """(path, subject, sender, text, problem): a row for each message of the MBOX files below folder.

    A line that begins with ``From `` parts messages, so a file is read by as many tasks as it has splits, and no task
    holds more of it than a message. The files begin with such a line (``mails`` reads single messages). Bytes stay as
    they are; compressed files have one split.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\nFrom ")
    rows = read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("message"))

    def parse(raw: bytes) -> list[dict]:
        body = bytes(raw).partition(b"\n")[2]  # behind the rest of the line that parts them
        return [mail_parts(re.sub(rb"(?m)^>From ", b"From ", body))] if body.strip() else []

    return parsed(rows, ["message"], parse, "subject string, sender string, text string", "path")


def feeds(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each entry of RSS, Atom and JSON feeds."""
    return parsed(rows, [text], lambda t: feed_entries(t) if t else [], "title string, author string, year string, url string, text string", *keep)


def archive_members(rows: DataFrame, name: str, content: str, *keep: str, depth: int = 4, count: int = 10_000, size: int = 256 << 20) -> DataFrame:
    """A row for each leaf member of ZIP, TAR and GZIP files (binary); one beyond its budgets gives a problem and no member."""

    def parse(n: str | None, raw: bytes | None) -> Iterator[dict]:
        raw = bytes(raw or b"")
        for _ in members(n or "", raw, depth, count, size):  # an archive that breaks a budget gives no member, so all are unpacked once before the first goes out
            pass
        for path, k, body in members(n or "", raw, depth, count, size):
            yield {"member": path, "occurrence": k, "body": body}

    return parsed(rows, [name, content], parse, "member string, occurrence int, body binary", *keep)


def clipping_rows(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each record of clippings files, without those whose text another one of the file holds."""
    parse = lambda t: distinct_clippings(clippings(t or ""))
    return parsed(rows, [text], parse, "title string, author string, kind string, page int, start int, end int, text string", *keep)


def office_texts(rows: DataFrame, name: str, content: str, *keep: str) -> DataFrame:
    """The text of EPUB and PPTX files (binary)."""
    from lexigrove.operators.ingest import zipped_text

    return parsed(rows, [name, content], lambda n, raw: [{"text": zipped_text(n or "", bytes(raw))}] if raw else [], "text string", *keep)
