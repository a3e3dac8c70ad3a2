r"""License scans by diagonal voting.

Every rolling group of three words of every text is joined by its hash to the positions of a fixed table of template
word groups (a few hundred rows at most; broadcast). A hit's diagonal is its position in the text less that in the
template. Votes are summed by diagonal, neighbouring diagonals (inserted or missing words) are merged to spans, and a
span is verified when the template groups that it holds make at least ``share`` of the template. A diagonal that holds
all groups of a phrase is a place where its words stand consecutively.

Words are compared, not only their hashes. Very long texts are read whole. Rows of one id and one text count once and get equal results; null texts are
empty: no words, no labels, score 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.llm.base import same, text_or_empty

#: Phrases whose every place counts, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences of common licence notices, headers and deeds, with the labels that the method adds.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under a creative commons attribution license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "bsd",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib",
    "has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law": "cc0",
    "if you remix transform or build upon the material you must distribute your contributions under the same license as the original": "cc-by-sa",
    "you must give appropriate credit provide a link to the license and indicate if changes were made": "cc-by",
    "you may not use the material for commercial purposes": "cc-by-nc",
}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, base, need, place, h, v0, v1, v2), from constants only."""
    rows = []
    for base, table in ((True, phrases), (False, notices)):
        for text, label in table.items():
            w = text.split()
            rows += [(len(rows), text, label, base, len(w) - GRAM + 1, i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    values = ", ".join(f"('{t}', '{label}', {str(base).lower()}, {need}, {i}, '{a}', '{b}', '{c}')" for _, t, label, base, need, i, a, b, c in rows)
    table = spark.sql(f"select * from values {values} as t(template, label, base, need, place, v0, v1, v2)")
    return table.withColumn("h", F.xxhash64("v0", "v1", "v2"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, share: float = 0.6, reach: int = 2) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: (label, template, first, last, score)."""
    text = text_or_empty(text_col)
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    # A place goes on only if its word begins some template group.
    first = sorted({w for table in (phrases, notices) for t in table for w in t.split()[: 1 - GRAM]})
    places = words.select("id", "th", "w", F.posexplode("w").alias("pos", "w0")).where(F.lower("w0").isin(first) & (F.col("pos") + GRAM <= F.size("w")))
    grams = places.select("id", "th", "pos", "w0", *(F.get("w", F.col("pos") + k).alias(f"w{k}") for k in range(1, GRAM)))
    table = templates(docs.sparkSession, phrases, notices)
    alike = grams.join(F.broadcast(table), F.xxhash64(*(F.lower(f"w{k}") for k in range(GRAM))) == table["h"])
    for k in range(GRAM):
        alike = alike.where(_lower(F.col(f"w{k}")) == F.col(f"v{k}"))
    diagonals = (
        alike.groupBy("id", "th", "template", "label", "base", "need", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))
    )
    by = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) <= reach, F.lit(False)) & (F.size("places") < F.col("need")) & F.coalesce(F.size(F.lag("places").over(by)) < F.col("need"), F.lit(True))
    spans = (
        diagonals.withColumn("begins", (~near).cast("int"))
        .withColumn("span", F.sum("begins").over(by))
        .groupBy("id", "th", "template", "label", "base", "need", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("got"),
            F.min("diagonal").alias("lo"),
            F.max("diagonal").alias("hi"),
            F.max(F.size("places")).alias("best"),
        )
        .withColumn("score", F.size("got") / F.col("need"))
        .where(F.col("score") >= share)
        .withColumn("full", F.col("base") & (F.col("best") == F.col("need")))
    )
    first = F.greatest(F.col("lo") + F.array_min("got"), F.lit(0))
    last = F.col("hi") + F.array_max("got") + (GRAM - 1)
    found = spans.groupBy("id", "th").agg(
        F.count(F.when(F.col("full"), 1)).alias("n_base"),
        F.min(F.when(F.col("full"), F.col("lo"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("full"), F.col("lo"))).cast("bigint").alias("last_word"),
        F.collect_set(F.when(F.col("full"), F.col("label"))).alias("bl"),
        F.collect_set("label").alias("al"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("label", "template", first.alias("first"), last.alias("last"), "score"))).alias("spans"),
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words")).alias("r")
    joined = rows.join(found.alias("f"), same(F.col("r.id"), F.col("f.id")) & (F.col("r.th") == F.col("f.th")), "left")
    comma = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return joined.select(
        F.col("r.id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        comma("bl").alias("base_labels"),
        comma("al").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
