"""Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, id string, key string, kept boolean, bucket int, size int, k int"
CLASH = (1, "x", "y", True, 2, 3, 4)


def words(n: int, seed: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'aeiou'[r.randrange(5)]}" for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**9)}" if r.random() < share else w for w in text.split())


def documents() -> list[tuple]:
    base, passage = words(120, 1), words(60, 2)
    rows = [(0, base, "en", "a"), (1, None, "en", "b"), (2, "", None, None), (3, "short text", "de", "a"), (4, base, "en", "b")]
    rows += [(10 + i, edited(base, i, 0.03), "en", "a") for i in range(25)]
    rows += [(40 + i, edited(base, 100 + i, 0.12), "de", "b") for i in range(15)]
    rows += [(60 + i, f"{words(30, 200 + i, 5000)} {passage} {words(20 + i, 300 + i, 5000)}", "en", "c") for i in range(25)]
    rows += [(90, words(9000, 5), "en", "c"), (91, " \t\n ", "en", "c"), (92, "a\tb  c\n", "de", "c"), (93, "a b c ", "de", "c"), (94, "Grüße aus Köln, schöne Straße – ещё один 文本 ẞ", "de", None), (95, "x" * 300, "en", "a"), (96, "x" * 200, "en", "a")]
    rows += [(97, "same row again and again", "en", "a")] * 2
    rows += [(98, passage, "en", "a"), (99, passage.upper(), "en", "a")]
    return [(*r, None if r[1] is None else len(r[1]), *CLASH) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
