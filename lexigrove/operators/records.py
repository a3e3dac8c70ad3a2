"""Counts and changes of the tables beside the documents: audit, jobs, queues, leaderboards, catalogues, reviews, tags.

Every function takes and gives DataFrames; columns are named by arguments where tables differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Audit.


def audit_counts(log: DataFrame, since: int, action: str = "action", key: str = "id") -> DataFrame:
    """(action, n, last) of the entries from ``since`` on."""
    return log.where(F.col(key) >= since).groupBy(F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"))


def audit_page(log: DataFrame, action: str | None, limit: int, offset: int = 0, kind: str = "action", ts: str = "ts", key: str = "id") -> DataFrame:
    """Entries, newest first."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("a page has from 1 to 1000 rows")
    rows = log if action is None else log.where(F.col(kind) == action)
    return rows.orderBy(F.desc(ts), F.desc(key)).offset(offset).limit(limit)


# Jobs and queues.


def status_counts(jobs: DataFrame, status: str, **more: Column) -> DataFrame:
    """(status, n, more): jobs by status, and how many of them meet each further condition."""
    return jobs.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in more.items()))


def queue_statistics(queue: DataFrame, **counts: Column) -> DataFrame:
    """One row: all entries, and those that meet each condition."""
    return queue.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def purge_queue(queue: DataFrame, before: object, ts: str = "ts") -> DataFrame:
    """What stays when entries older than ``before`` go. Entries without a time stay."""
    return queue.where(F.coalesce(F.col(ts) >= F.lit(before), F.lit(True)))


def claim(jobs: DataFrame, worker: str, now: int, most: int, lease: int, key: str = "id") -> DataFrame:
    """jobs after a worker has taken the ``most`` first that are due: queued ones, and taken ones whose lease has run out.

    jobs: (key, status, priority, due, worker, leased_until, attempts). The table that comes back replaces the one given,
    in one commit, so two workers never take one job. Only the keys taken are sent around, ``most`` of them.
    """
    open_ = (F.col("status") == "queued") | ((F.col("status") == "taken") & (F.col("leased_until") < now))
    taken = jobs.where(open_ & (F.col("due") <= now)).orderBy(F.desc("priority"), "due", key).limit(most).select(F.col(key).alias("_k"))
    mine = F.col("_k").isNotNull()
    marked = jobs.join(F.broadcast(taken), F.col(key) == F.col("_k"), "left")
    new = {"status": F.lit("taken"), "worker": F.lit(worker), "leased_until": F.lit(now + lease), "attempts": F.col("attempts") + 1}
    return marked.select(*(F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))


def settle(jobs: DataFrame, results: DataFrame, now: int, most_attempts: int = 5, least: int = 60, most: int = 3600, key: str = "id") -> DataFrame:
    """jobs after results (key, worker, ok): done where ok; else due again after a wait that doubles, and dead in the end.

    A result counts only while its worker still holds the job. Of several results of a job a good one counts.
    """
    told = results.groupBy(F.col(key).alias("_k"), F.col("worker").alias("_w")).agg(F.max("ok").alias("_ok"))
    marked = jobs.join(told, (F.col(key) == F.col("_k")) & (F.col("worker") == F.col("_w")) & (F.col("status") == "taken"), "left")
    wait = F.least(F.lit(least) * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(most)).cast("bigint")
    heard, failed = F.col("_ok").isNotNull(), F.col("_ok") == F.lit(False)
    dead = failed & (F.col("attempts") >= most_attempts)
    new = {
        "status": F.when(F.col("_ok"), "done").when(dead, "dead").when(failed, "queued").otherwise(F.col("status")),
        "due": F.when(failed & ~dead, now + wait).otherwise(F.col("due")),
        "worker": F.when(~heard, F.col("worker")),
        "leased_until": F.when(~heard, F.col("leased_until")),
    }
    return marked.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns))


def dead_letters(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'dead'")


def revive(jobs: DataFrame, keys: Sequence[object] | None, now: int, key: str = "id") -> DataFrame:
    """jobs with dead ones (all, or those named) queued anew."""
    back = (F.col("status") == "dead") & (F.lit(True) if keys is None else F.col(key).isin(list(keys)))
    new = {"status": F.when(back, "queued").otherwise(F.col("status")), "attempts": F.when(back, 0).otherwise(F.col("attempts")), "due": F.when(back, F.lit(now)).otherwise(F.col("due"))}
    return jobs.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns))


def coalesced(queue: DataFrame, paused: bool = False, path: str = "path", ts: str = "ts") -> DataFrame:
    """(path, event, ts, n): one entry for each path, with its last event, and how many it stands for; none while paused.

    A path that was made and deleted again before anyone looked has no entry.
    """
    last = queue.groupBy(path).agg(F.max_by("event", ts).alias("event"), F.min_by("event", ts).alias("first"), F.max(ts).alias("ts"), F.count(F.lit(1)).alias("n"))
    out = last.where(~((F.col("first") == "created") & (F.col("event") == "deleted"))).drop("first")
    return out.limit(0) if paused else out.select(path, "event", "ts", "n")


def due_for_dispatch(queue: DataFrame, now: int, quiet: int = 5, path: str = "path", ts: str = "ts") -> DataFrame:
    """The coalesced entries whose path has been quiet for so many seconds."""
    return coalesced(queue, path=path, ts=ts).where(F.col(ts) + quiet <= now)


def failed_extractions(log: DataFrame, reason: Column, bad: Column, key: str = "id") -> DataFrame:
    """(key, reason) of entries that failed."""
    return log.where(bad).select(key, reason.alias("reason"))


def retry_failed(docs: DataFrame, keys: Sequence[object], skip: bool = False, key: str = "id") -> DataFrame:
    """docs with failed ones pending again, or set to be skipped. docs: (key, extraction, error)."""
    named = (F.col("extraction") == "failed") & F.col(key).isin(list(keys))
    new = {"extraction": F.when(named, "skipped" if skip else "pending").otherwise(F.col("extraction")), "error": F.when(~named | F.lit(skip), F.col("error"))}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


# Leaderboards and fields.


def leaderboard(units: DataFrame, by: dict[str, str], ok: Column, error: str, seconds: str, memory: str, worst: float = 1.0) -> DataFrame:
    """For each group: units, good and failed ones, mean error of good ones and with failures as ``worst``, median seconds, peak memory."""
    good = F.when(ok, F.col(error))
    return units.groupBy(*(F.col(c).alias(n) for n, c in by.items())).agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.round(F.avg(good), 6).alias("mean_cer"),
        F.round(F.avg(F.when(ok, F.col(error)).otherwise(worst)), 6).alias("penalised_cer"),
        F.round(F.median(F.when(ok, F.col(seconds))), 6).alias("median_seconds"),
        F.max(memory).alias("peak"),
    )


def approved_values(reviews: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value, different, conflict): the least approved value of each label, and whether there are several."""
    return reviews.groupBy(F.col(label).alias("label")).agg(F.min(value).alias("value"), F.countDistinct(value).alias("different"), (F.countDistinct(value) > 1).alias("conflict"))


def field_evidence(docs: DataFrame, field: str, value: Column, text: str, before: int, *keep: str) -> DataFrame:
    """(keep, id, value, start, before): a field's value with a stable id, its first place in the text, and the characters up to ``before`` without page breaks."""
    tidy = F.trim(F.regexp_replace(value, r"\s+", " "))
    return docs.select(
        *keep, F.sha2(F.concat(F.lit(f"{field}:"), value), 256).alias("id"), tidy.alias("value"), (F.instr(text, value) - 1).alias("start"), F.length(F.replace(F.substring(text, 1, before), F.lit("\f"), F.lit(""))).alias("before")
    )


def entity_tags(entities: DataFrame, owner: str, least: float, most: int) -> DataFrame:
    """(owner, tags): the best-scored entities of each owner as prefix:text, each once. entities: (owner, prefix, txt, score)."""
    best = entities.where(F.col("score") >= least).groupBy(owner, "prefix", "txt").agg(F.max("score").alias("score"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("score"), "prefix", "txt"))).where(F.col("n") <= most)
    in_order = F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":", "prefix", "txt").alias("t"))))  # ``most`` at most
    return ranked.groupBy(owner).agg(F.transform(in_order, lambda x: x["t"]).alias("tags"))


def citations(answer: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """The sources an answer cites in brackets, as ([S1, S2] or [s3; S4]): those that are known, and those that are not."""
    groups = F.regexp_extract_all(answer, F.lit(r"(?i)\[(S\d+(?:\s*[,;]\s*S\d+)*)\]"), F.lit(1))
    ids = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(F.upper(g), r"\s*[,;]\s*"))))
    have = F.array(*(F.lit(k) for k in known)) if known else F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(ids, have)), F.array_sort(F.array_except(ids, have))


# Catalogues, names, occurrences.


def catalogue_totals(entries: DataFrame, catalogue: str, size: str) -> DataFrame:
    return entries.groupBy(F.col(catalogue).alias("catalogue")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("size"))


def named_counts(rows: DataFrame, name: str, part: str, within: str) -> DataFrame:
    """(author, n) of the rows whose ``within`` holds part, case ignored."""
    return rows.where(F.lower(within).contains(part.lower())).groupBy(F.col(name).alias("author")).agg(F.count(F.lit(1)).alias("n"))


def catalogue_duplicates(entries: DataFrame, key: str, *same: str) -> DataFrame:
    """(source, copy, copies): for each entry the first later one that equals it in ``same``, and how many later ones there are.

    A window over equal entries in the order of their key, so a name that very many entries share makes no pairs.
    """
    w = Window.partitionBy(*same).orderBy(key)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    known = entries
    for c in same:
        known = known.where(F.col(c).isNotNull())
    found = known.select(F.col(key).alias("source"), F.lead(key).over(w).alias("copy"), F.count(F.lit(1)).over(later).alias("copies"))
    return found.where("copy is not null")


def citation_keys(rows: DataFrame, base: Column, by: str, order: str) -> DataFrame:
    """rows with ``key``: base, and from the second of a group on its number."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_n", n).withColumn("key", F.concat(base, F.when(F.col("_n") > 1, F.concat(F.lit("_"), "_n")).otherwise(""))).drop("_n")


def occurrence_numbers(members: DataFrame, container: str, name: str, order: str) -> DataFrame:
    """members with ``occurrence``: which one of equal names in a container it is, from 1."""
    return members.withColumn("occurrence", F.row_number().over(Window.partitionBy(container, name).orderBy(order)))


def filename_hits(docs: DataFrame, part: str, limit: int, *order: str, weight: float = 0.4, name: str = "filename") -> DataFrame:
    """The first documents whose file name holds part as it is written, case ignored, all with one score."""
    return docs.where(F.lower(name).contains(part.lower())).orderBy(*order).limit(limit).withColumn("score", F.lit(weight))


def translated_snippets(docs: DataFrame, language: str, text: str, own: str, wanted: str, most: int = 400) -> DataFrame:
    """docs with ``snippet``: the start of text where it is in the wanted language, else of what is shown otherwise."""
    return docs.withColumn("snippet", F.when(F.col(language) == wanted, F.substring(text, 1, most)).otherwise(F.col(own)))


def hydrated(passages: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """The passages of exactly these keys (the columns of keys), blank ones left out."""
    return passages.join(keys.distinct(), keys.columns, "left_semi").where(F.trim(text) != "")


def at_location(docs: DataFrame, folder: str, digests: DataFrame, path: str = "parent_dir", digest: str = "source_hash") -> DataFrame:
    """Rows in a folder, and those elsewhere with a content of digests."""
    marked = docs.join(digests.select(F.col(digest).alias("_d"), F.lit(True).alias("_same")).distinct(), F.col(digest) == F.col("_d"), "left")
    return marked.where((F.col(path) == folder) | F.col("_same")).drop("_d", "_same")


def newer_vectors(rows: DataFrame, at: Column, watermark: int, key: str, limit: int) -> DataFrame:
    """The next rows by key whose vectors are newer than the watermark."""
    return rows.where(at > watermark).orderBy(key).limit(limit)


def representatives(chunks: DataFrame, key: str, place: str, text: str, tag: str) -> DataFrame:
    """(key, first_text, tags): each document's first row, and the union of its rows' tags (as many as there are different ones)."""
    return chunks.groupBy(key).agg(F.min_by(text, place).alias("first_text"), F.sort_array(F.collect_set(tag)).alias("tags"))


def tag_pairs(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """(a, b, n): how many documents have both tags, a before b."""
    lists = docs.select(F.sort_array(F.array_distinct(tags)).alias("ts"))
    pairs = lists.select(F.posexplode("ts").alias("i", "a"), "ts").select("a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def not_latin(text: Column) -> tuple[Column, Column, Column]:
    """(letters, letters of other scripts, whether a fourth or more of four letters or more are): for texts that need another analyzer."""
    letters, other = F.regexp_count(text, F.lit(r"\p{L}")).cast("bigint"), F.regexp_count(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")).cast("bigint")
    return letters, other, (letters >= 4) & (other * 4 >= letters)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and the last part of the path."""
    part = lambda p: F.regexp_extract(url, p, 1)
    return part("^([a-z]+)://"), part("^[a-z]+://([^/?#]*)"), part("^[a-z]+://[^/?#]*/?.*?([^/?#]*)(?:[?#].*)?$")


# Changes of documents.


def promoted(docs: DataFrame, better: DataFrame, key: str, columns: Sequence[str], level: str = "level") -> DataFrame:
    """docs with the columns of better where it has them; a level only rises. better: (key, columns, level)."""
    new = better.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_new_{c}") for c in (*columns, level)))
    met = docs.join(new, F.col(key) == F.col("_k"), "left")
    rises = F.greatest(F.col(level), F.coalesce(f"_new_{level}", F.lit(0)))
    return met.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else rises.alias(c) if c == level else F.col(c) for c in docs.columns))


def deleted(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return docs.join(gone.select(*keys), list(keys), "left_anti")


def moved(path: Column, old: str, new: str) -> Column:
    """The path with a folder's name changed; others stay."""
    return F.when((path == old) | path.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new), F.substr(path, F.lit(len(old.rstrip("/")) + 1)))).otherwise(path)


def annotations(log: DataFrame, wanted: Column, limit: int, ts: str = "ts", key: str = "id") -> DataFrame:
    """The newest annotations that are wanted."""
    return log.where(wanted).orderBy(F.desc(ts), F.desc(key)).limit(limit)


def unprocessed(docs: DataFrame, done: DataFrame, digest: str) -> DataFrame:
    """docs whose content is not among what was processed."""
    return docs.join(done.select(digest).distinct(), digest, "left_anti")
