"""Complete search: every document that matches a query, with facets, sorted pages and cursors, and no cut by relevance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators import browse, sync
from lexigrove.operators.postings import TextIndex
from lexigrove.plans import compiler

#: Sort keys by name: what is compared, and whether it goes down. Unknown years come last both ways.
SORTS = {"filename": ("filename", False), "title": ("title", False), "location": ("parent_dir", False), "year": ("year", False), "year_desc": ("year", True)}


@dataclass
class Complete:
    """The matches of one query. keys name a document in the index and in docs, and break ties."""

    index: TextIndex
    docs: DataFrame
    query: str
    fields: dict[str, str]
    keys: tuple[str, ...]

    @cached_property
    def matches(self) -> DataFrame:
        """The matching rows of docs."""
        found = compiler.search(self.index, self.query, self.fields, self.keys).select(*(F.col(k).alias(f"_{k}") for k in self.keys))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        return self.docs.join(found, on, "left_semi")

    def facets(self, top: int = 25) -> DataFrame:
        return browse.search_facets(self.matches, top)

    def summary(self) -> DataFrame:
        """One row: documents, and those without a year, language or extension."""
        none = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == ""))
        return self.matches.agg(F.count(F.lit(1)).alias("documents"), none("year").alias("no_year"), none("language").alias("no_language"), none("ext").alias("no_extension"))

    def _key(self, sort: str) -> tuple[Column, bool]:
        if sort not in SORTS:
            raise ValueError(f"there is no sort {sort!r}")
        name, down = SORTS[sort]
        return (F.col(name) if name == "year" else F.lower(name)), down

    def page(self, sort: str, limit: int, after: tuple | None = None) -> DataFrame:
        """The next rows behind a cursor (sort key, then keys of the last row seen)."""
        if not 1 <= limit <= 1000:
            raise ValueError("a page has from 1 to 1000 rows")
        key, down = self._key(sort)
        rows = self.matches
        if after is not None:
            first, *ties = after
            beyond, same = F.lit(False), F.lit(True)
            for k, v in zip(self.keys, ties, strict=True):
                beyond, same = beyond | (same & (F.col(k) > F.lit(v))), same & (F.col(k) == F.lit(v))
            if first is None:  # unknown values are last
                rows = rows.where(key.isNull() & beyond)
            else:
                past = key < F.lit(first) if down else key > F.lit(first)
                rows = rows.where(F.coalesce(past | ((key == F.lit(first)) & beyond), F.lit(True)))
        return rows.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), *self.keys).limit(limit)

    def ranked(self, sort: str) -> DataFrame:
        """All matches with their place in the sort, from sums of ranges of it, however many share a value."""
        key, down = self._key(sort)
        rows = self.matches.withColumns({"_none": key.isNull(), "_key": -key if down else key, "_one": F.lit(1)})
        return sync.running(rows, ("_none", "_key", *self.keys), {"_before": "_one"}).withColumn("place", F.col("_before") + 1).drop("_none", "_key", "_one", "_before")
