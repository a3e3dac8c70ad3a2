"""The analyzer: letters and digits, 40 bytes at most, lower case, Latin accents folded."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
LONGEST = 40
#: Letters that fold to two.
PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))


def _folds() -> tuple[str, str]:
    """Every accented letter of the Latin blocks whose first decomposed character is an ASCII letter."""
    single = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    kept = [(a, b) for a, b in single if b.isascii() and b.isalpha()] + [("ø", "o"), ("đ", "d"), ("ł", "l"), ("ı", "i"), ("ð", "d")]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


FROM, TO = _folds()


def folded(term: Column) -> Column:
    """Lower case with accents folded; other scripts stay."""
    out = F.lower(term)
    for a, b in PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, FROM, TO)


FOLD_SQL = "translate(" + "replace(" * len(PAIRS) + "lower({0})" + "".join(f", '{a}', '{b}')" for a, b in PAIRS) + f", '{FROM}', '{TO}')"


def tokens(text: Column) -> Column:
    """array<struct<t: term, p: position>>. Words that are too long leave their position empty."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    placed = F.transform(raw, lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    short = F.filter(placed, lambda x: F.octet_length(x["w"]) < LONGEST)
    plain = lambda w: F.octet_length(w) == F.length(w)  # noqa: E731  nothing to fold in ASCII
    return F.transform(short, lambda x: F.struct(F.when(plain(x["w"]), F.lower(x["w"])).otherwise(folded(x["w"])).alias("t"), x["p"].alias("p")))


_PY_WORD = re.compile(r"[^\W_]+")
_PY_FOLD = str.maketrans(FROM, TO)


def py_folded(text: str) -> str:
    out = text.lower()
    for a, b in PAIRS:
        out = out.replace(a, b)
    return out.translate(_PY_FOLD)


def py_words(text: str) -> list[str]:
    """The words of a text as they stand, long ones too."""
    return _PY_WORD.findall(text)


def py_tokens(text: str) -> list[tuple[int, str]]:
    """The analyzer on the driver, for query texts: (position, term)."""
    return [(i, py_folded(w)) for i, w in enumerate(py_words(text)) if len(w.encode()) < LONGEST]
