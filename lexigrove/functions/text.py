"""Text utilities: native columns where SQL functions suffice, vectorised Python where they do not."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import py_folded

WINDOW = 300


def csv_cell(text: Column) -> Column:
    """A quoted cell that no spreadsheet takes for a formula."""
    risky = F.ltrim(text).rlike(r"^[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.concat(F.lit('"'), F.when(risky, "'").otherwise(""), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Fixed values, needed for equal results: what an extension says of a document's type, and the words that speak for one.
BY_EXTENSION = {
    "email": "eml msg mbox",
    "ebook": "epub mobi azw3 fb2",
    "presentation": "pptx ppt odp key",
    "spreadsheet": "xlsx xls ods numbers",
    "image": "png jpg jpeg gif webp bmp svg tiff tif heic heif ico avif",
    "audio": "mp3 wav flac ogg opus m4a aac wma",
    "video": "mp4 mov mkv webm avi m4v",
    "code": "rs py js ts tsx jsx go java kt swift c cpp h hpp rb php lua sh bash zsh sql graphql svelte vue",
}
SIGNALS = {
    "invoice": "invoice|rechnung|faktura|bill to|due date|payment|total amount|subtotal|tax|vat|invoice number|rechnungsnummer|fällig",
    "contract": "agreement|contract|vertrag|vereinbarung|party|parties|whereas|hereby|obligations|termination|governing law|jurisdiction|shall|binding|effective date",
    "letter": "dear |sincerely|regards|yours|to whom|re:|subject:|sehr geehrte|mit freundlichen|hochachtungsvoll",
    "form": "please fill|check box|checkbox|signature:|date:|name:|address:|applicant|application form|formular|ausfüllen|unterschrift",
    "specification": "specification|requirements|scope|revision|version history|table of contents|appendix|spezifikation|anforderung|lastenheft|pflichtenheft",
    "report": "executive summary|conclusion|findings|methodology|results|analysis|recommendation|zusammenfassung|ergebnis|empfehlung",
    "article": "abstract|introduction|references|bibliography|doi:|issn|journal|published|peer-reviewed",
}


@dataclass(frozen=True)
class TypeRule:
    """A type, the signals it takes, when else it counts (SQL over low, size and pages), and what it turns to when."""

    kind: str
    need: int
    only: str = "true"
    turns: str | None = None
    when: str = "false"


#: In this order; the first that holds settles the type.
TYPE_RULES = (
    TypeRule("invoice", 3, turns="receipt", when="size < 500 or contains(low, 'receipt') or contains(low, 'quittung')"),
    TypeRule("contract", 4),
    TypeRule("letter", 2, turns="memo", when="size < 2000 or contains(low, 'memo')"),
    TypeRule("form", 2),
    TypeRule("specification", 3),
    TypeRule("report", 2, only="pages >= 5 or size > 10000"),
    TypeRule("article", 2),
)
SHORTEST, LONG, MANY_PAGES = 50, 5000, 3


def doctype_sql(count: str) -> str:
    """The type as one SQL expression over ext, low (the text in lower case), size (its bytes) and pages.

    count: how the dialect counts the words of a list that low contains, with {words} for a comma-joined list.
    """
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    cases = [f"when ext in ({quoted(names.split())}) then '{kind}'" for kind, names in BY_EXTENSION.items()] + [f"when size < {SHORTEST} then 'unknown'"]
    for r in TYPE_RULES:
        holds = f"({r.only}) and {count.format(words=quoted(SIGNALS[r.kind].split('|')))} >= {r.need}"
        cases += [f"when {holds} and ({r.when}) then '{r.turns}'"] if r.turns else []
        cases.append(f"when {holds} then '{r.kind}'")
    return f"case {' '.join(cases)} when pages >= {MANY_PAGES} or size > {LONG} then 'report' else 'unknown' end"


def doctypes(docs: DataFrame, ext: str, text: str, pages: str, *keep: str) -> DataFrame:
    """(keep, doctype): each document's type, by its extension or by how many signal words its text has."""
    seen = docs.select(*keep, F.lower(ext).alias("ext"), F.lower(text).alias("low"), F.octet_length(text).alias("size"), F.coalesce(pages, F.lit(0)).alias("pages"))
    return seen.select(*keep, F.expr(doctype_sql("size(filter(array({words}), w -> contains(low, w)))")).alias("doctype"))


def _digit_sum(word: Column, odd: int, even: int) -> Column:
    digits = F.transform(F.split(word, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), c.cast("int") * F.when(i % 2 == 0, odd).otherwise(even)).otherwise(0))
    return F.aggregate(digits, F.lit(0), lambda s, x: s + x)


def barcode_tag(word: Column) -> Column:
    """The tag of a word that is a barcode number; null for others."""
    ean = word.rlike("^[0-9]{13}$") & (_digit_sum(word, 1, 3) % 10 == 0)
    upc = word.rlike("^[0-9]{12}$") & (_digit_sum(word, 3, 1) % 10 == 0)
    tag = lambda kind: F.concat(F.lit(f"barcode:{kind}:"), word)
    return F.when(ean & word.rlike("^97[89]"), tag("isbn13")).when(ean, tag("ean13")).when(upc, tag("upca")).when(word.rlike("^[0-9]{4}-[0-9]{3}[0-9Xx]$"), tag("issn"))


def barcode_tags(text: Column, most: int = 32) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    likely = F.filter(words, lambda w: w.rlike(r"^[0-9-]{8,13}[0-9Xx]?$"))
    return F.slice(F.array_distinct(F.array_compact(F.transform(likely, barcode_tag))), 1, most)


#: Languages by the three-letter codes and names of detectors.
LANGUAGES = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru", "zho": "zh", "jpn": "ja"}


def language_code(label: Column) -> Column:
    """The two-letter code of a label like ``eng_Latn`` or ``de``."""
    head = F.lower(F.split(label, "[_-]")[0])
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(F.length(head) == 2, head).otherwise(known[head])


def exif_seconds(stamp: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` of exactly 19 characters, read as UTC."""
    right = stamp.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    iso = F.concat(F.replace(F.substring(stamp, 1, 10), F.lit(":"), F.lit("-")), F.substring(stamp, 11, 9))
    return F.when(right, F.unix_timestamp(F.try_to_timestamp(F.concat(iso, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))))


def occurrence_id(owner: Column, location: Column, digest: Column) -> Column:
    """Owner and location make a document; content counts only where there is no location."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(owner), part(location), F.when(F.length(location) == 0, part(digest)).otherwise("")), 256)


def next_due(kind: Column, number: Column, last: Column, now: int) -> Column:
    """Milliseconds of the next run: never for manual, number minutes after the last, or daily at number minutes of the UTC day."""
    day = F.lit(now // 86_400_000 * 86_400_000) + number * 60_000
    return F.when(kind == "interval", F.coalesce(last + number * 60_000, F.lit(now))).when(kind == "daily", F.when(last >= day, day + 86_400_000).otherwise(day))


def backoff(previous: Column, failed: Column, least: int = 60, most: int = 3600) -> Column:
    return F.when(failed == 0, least).otherwise(F.least(F.greatest(previous, F.lit(least)) * 2, F.lit(most)))


#: Stand for the tags of a mark while its text is escaped; of no use in texts, which lose them.
_ON, _OFF = "\ue000", "\ue001"


def snippet(text: Column, query: str, window: int = WINDOW) -> Column:
    """The window around the first of the query's words, a third of it before, escaped, with all words marked; null for blank texts."""
    text = F.translate(text, _ON + _OFF, "")
    terms = sorted({t for t in re.findall(r"\w+", query) if len(t) > 1}, key=lambda t: (-len(t), t))
    pattern = "(?iu)" + "|".join(re.escape(t) for t in terms) if terms else r"(?!)"
    size = F.length(text)
    first = F.length(F.split(text, pattern, 2)[0])
    around = F.greatest(first - window // 3, F.lit(0))
    around = F.when(around + window >= size, F.greatest(size - window, F.lit(0))).otherwise(around)
    begin = F.when(text.rlike(pattern), F.least(around, first)).otherwise(F.lit(0))
    piece = F.substr(text, begin + 1, F.lit(window))
    marked = html_escape(F.regexp_replace(piece, pattern, f"{_ON}$0{_OFF}"))
    marked = F.replace(F.replace(marked, F.lit(_ON), F.lit("<mark>")), F.lit(_OFF), F.lit("</mark>"))
    return F.when(text.rlike(r"\S"), F.concat(F.when(begin > 0, "…").otherwise(""), marked, F.when(begin + window < size, "…").otherwise("")))


def summary(text: Column, most: int = 300, sentences: int = 3, shortest: int = 50) -> Column:
    """The first sentences, until they have ``most`` bytes, cut at a word; null for texts that say too little."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    parts = F.slice(F.filter(parts, lambda x: F.length(x) > 0), 1, sentences)
    grown = F.aggregate(parts, F.lit(""), lambda out, x: F.when(F.octet_length(out) >= most, out).when(out == "", x).otherwise(F.concat_ws(" ", out, x)))
    # Words are taken while they and the space behind them fit; a single word that does not is cut by letters.
    none = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def take(state: Column, word: Column) -> Column:
        longer = F.when(state["out"] == "", word).otherwise(F.concat_ws(" ", state["out"], word))
        fits = state["open"] & (F.octet_length(longer) < most)
        return F.struct(F.when(fits, longer).otherwise(state["out"]).alias("out"), fits.alias("open"))

    whole = F.aggregate(F.split(grown, " "), none, take)["out"]
    letters = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.substr(grown, F.lit(1), k)) <= most))
    cut = F.when(F.octet_length(whole) > 0, whole).otherwise(F.substr(grown, F.lit(1), letters))
    out = F.when(F.octet_length(grown) <= most, grown).otherwise(F.concat(cut, F.lit("…")))
    return F.when((F.octet_length(text) >= shortest) & (F.octet_length(grown) >= 30), out)


# Python, a batch at a time.


def word_diff(a: str, b: str) -> dict:
    """Segments (op, text) over words and the white space between, and counts of words."""
    x, y = re.findall(r"\s+|\S+", a), re.findall(r"\s+|\S+", b)
    added = removed = 0
    words = lambda part: sum(not w.isspace() for w in part)
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least - head) if x[-1 - i] != y[-1 - i]), least - head)
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    segments = [("equal", "".join(x[:head]))] * bool(head)
    for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
        if op == "equal":
            segments.append(("equal", "".join(p[i:j])))
            continue
        if j > i:
            segments.append(("removed", "".join(p[i:j])))
            removed += words(p[i:j])
        if m > k:
            segments.append(("added", "".join(q[k:m])))
            added += words(q[k:m])
    segments += [("equal", "".join(x[len(x) - tail :]))] * bool(tail)
    return {"segments": segments, "added": added, "removed": removed, "ratio": (added + removed) / max(words(x) + words(y), 1)}


def change_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda s, t: pd.Series([word_diff(x or "", y or "")["ratio"] for x, y in zip(s, t, strict=True)]), "double")(a, b)


def plain(text: str) -> tuple[str, list[int]]:
    """Letters and digits, folded and in lower case, words a space apart, with the place of each character in text."""
    out, at, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
        elif c.isalnum():
            if gap:
                out.append(" ")
                at.append(i)
                gap = False
            for d in py_folded(c):
                out.append(d)
                at.append(i)
    return "".join(out), at


def merge_spans(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping or touching spans as one, with the best score."""
    out: list[tuple[int, int, float]] = []
    for a, b, s in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(s, out[-1][2]))
        else:
            out.append((a, b, s))
    return out


def occurrence_ranges(text: str, terms: list[str], whole_words: bool = False, most: int = 1000) -> list[tuple[int, int]]:
    """Where the terms stand, longest first, case ignored."""
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not terms:
        return []
    body = "|".join(map(re.escape, terms))
    found = re.finditer(rf"(?<!\w)(?:{body})(?!\w)" if whole_words else body, text, re.IGNORECASE)
    return [m.span() for _, m in zip(range(most), found, strict=False)]
