"""Search filters (bound before any ranking) and browse filters, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS, MAX_TAG_BYTES = 32, 1024


def _every(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


@dataclass
class SearchFilters:
    """All that are set hold together. User text never acts as a pattern."""

    owner: str | None = None
    language: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    translated_to: str | None = None
    extensions: list[str] = field(default_factory=list)
    hash_prefix: str | None = None
    folder_prefix: str | None = None
    seconds_min: float | None = None
    seconds_max: float | None = None
    camera: str | None = None
    url: str | None = None
    tags: list[str] = field(default_factory=list)
    doc_ids: list[str] = field(default_factory=list)
    status: str | None = None
    mounted: list[str] | None = None
    either_slash: bool = False

    def validate(self) -> SearchFilters:
        if len(self.tags) > MAX_TAGS or any(not t or len(t.encode()) > MAX_TAG_BYTES for t in self.tags):
            raise ValueError(f"at most {MAX_TAGS} tags of 1 to {MAX_TAG_BYTES} bytes")
        if any(y is not None and not 1 <= y <= 9999 for y in (self.year_min, self.year_max)):
            raise ValueError("years go from 1 to 9999")
        if None not in (self.year_min, self.year_max) and self.year_min > self.year_max:
            raise ValueError("the first year is after the last")
        if any(s is not None and (not math.isfinite(s) or s < 0) for s in (self.seconds_min, self.seconds_max)):
            raise ValueError("durations are finite and not negative")
        if None not in (self.seconds_min, self.seconds_max) and self.seconds_min > self.seconds_max:
            raise ValueError("the least duration is over the greatest")
        return self

    def column(self) -> Column:
        self.validate()
        c, parts = F.col, []
        for name, value in (("owner_id", self.owner), ("language", self.language), ("doc_status", self.status)):
            if value is not None:
                parts.append(c(name) == value)
        for name, low, high in (("year", self.year_min, self.year_max), ("audio_seconds", self.seconds_min, self.seconds_max)):
            parts += [c(name) >= low] * (low is not None) + [c(name) <= high] * (high is not None)
        if self.translated_to is not None:
            parts.append((c("translated_lang") == self.translated_to) & c("translated").isNotNull())
        if self.extensions:
            parts.append(F.lower("ext").isin([e.lower() for e in self.extensions]))
        if self.hash_prefix:
            parts.append(c("source_hash").startswith(self.hash_prefix.lower()))
        if self.folder_prefix:
            prefixes = {self.folder_prefix}
            if self.either_slash and "\\" in self.folder_prefix:
                prefixes.add(self.folder_prefix.replace("\\", "/"))
            either = F.lit(False)
            for p in sorted(prefixes):
                either = either | c("parent_dir").startswith(p)
            parts.append(either)
        if self.camera:
            parts.append(c("camera").contains(self.camera))
        if self.url:
            parts.append(c("url").contains(self.url))
        parts += [F.array_contains("tags", t) for t in dict.fromkeys(self.tags)]
        if self.doc_ids:
            parts.append(c("id").isin(self.doc_ids))
        if self.mounted is not None:
            parts.append(c("volume_id").isNull() | c("volume_id").isin(self.mounted) if self.mounted else c("volume_id").isNull())
        return _every(parts)


def level() -> Column:
    """1: file system only, 2: embedded metadata, 3: text."""
    read = F.coalesce(F.get_json_object("metadata_json", "$.l2_extracted") == "true", F.lit(False))
    return F.when(F.length(F.coalesce("body", F.lit(""))) > 0, 3).when(read, 2).otherwise(1)


@dataclass
class DocumentFilter:
    """The browse filter; one row for each document (the chunk of index 0 or less)."""

    folder: str | None = None
    extensions: list[str] = field(default_factory=list)
    year_min: int | None = None
    year_max: int | None = None
    language: str | None = None
    l2_only: bool = False
    name: str | None = None
    ids: list[str] = field(default_factory=list)
    owner: str | None = None
    volumes: list[str] | None = None
    tags: list[str] = field(default_factory=list)

    def column(self) -> Column:
        same = SearchFilters(owner=self.owner, language=self.language, year_min=self.year_min, year_max=self.year_max, extensions=self.extensions, folder_prefix=self.folder, doc_ids=self.ids, mounted=self.volumes, tags=self.tags)
        parts = [F.col("chunk_index") <= 0, same.column()]
        if self.l2_only:
            parts.append(F.get_json_object("metadata_json", "$.l2_extracted") == "true")
        if self.name:
            parts.append(F.lower("filename").contains(self.name.lower()) | F.lower("title").contains(self.name.lower()))
        return _every(parts)


def glob_to_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_ " else c), i + 1
    return f"^{out}$"


def glob_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Kept if some include pattern (or none is given) and no exclude pattern matches."""
    any_of = lambda ps: _every([F.lit(True)]) & ~_every([~path.rlike(glob_to_regex(p)) for p in ps])
    return (any_of(include) if include else F.lit(True)) & (~any_of(exclude) if exclude else F.lit(True))
