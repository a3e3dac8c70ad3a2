"""Where known passages stand in documents: as they are, normalised, or as a run of words that differs a little.

Documents are read once for each block of passages, and nothing of them is shuffled. A passage is looked for where a
document has one of its anchors, that is a word of five letters or more, or two words that stand together (any word, in a
passage of less than eight). An anchor tells where the passage would begin; edits before it can have
moved that by as many letters as there may be edits at all, and every run of words that begins in between is compared.
So a run is found if it is near enough and one anchor of the passage is unchanged in it, wherever that is. Of what the
anchors give, stretches and then runs are left out that share too few groups of letters with the passage to be near,
counting only groups that stand no further from their place in the passage than edits can move them; that loses none.
Documents are searched many at a time. Exact and normalised places are looked for where all inner words of the passage
stand.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import folded

#: Letters of a word that is an anchor, and words of a passage in which all are.
LONG, FEW = 5, 8
#: Passages, and letters of passages, that are looked for in one reading of the documents.
MOST, LETTERS = 2000, 1 << 20
#: Groups of letters that are counted have four letters in passages of so many, else three.
LONGER = 64
#: Letters of documents that are searched together, groups that are looked up at once, and the longest table of groups that is not searched.
TOGETHER, LOOKED_UP, DIRECT = 1 << 20, 1 << 16, 1 << 23


def plain(text: Column) -> Column:
    """Letters and digits only, folded and in lower case, words a space apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


@dataclass
class Passages:
    """One block of passages, and their anchors."""

    need: list[str]
    plain: list[str]
    least: float

    def __post_init__(self):
        # A run that is near has at most L / least letters, and differs from the passage in at most this many.
        self.edits = [math.floor(len(p) / self.least * (1 - self.least) + 1e-9) for p in self.plain]
        self.words = [p.count(" ") + 1 for p in self.plain]
        self.own: list[list[tuple[str, int]]] = []  # a passage's anchors, with the letters before each
        for p in self.plain:
            words = p.split(" ")
            at, own = 0, []
            for w, after in zip(words, [*words[1:], None], strict=True):
                if w and (len(words) < FEW or len(w) >= LONG):
                    own.append((w, at))
                if after:
                    own.append((f"{w} {after}", at))
                at += len(w) + 1
            self.own.append(own)
        # What an exact or normalised place needs: the words inside the passage, each as it stands.
        self.inner = [frozenset(p.split(" ")[1:-1]) for p in self.plain]
        self.letters, self.most, self.wide = (np.array(x, np.int64) for x in ([len(p) for p in self.plain], self.edits, self.words))
        self.longest = int((self.letters + self.most).max(initial=0))  # letters of a near run
        self._index_anchors()
        self._index_groups()

    def _index_anchors(self) -> None:
        """By the number of a word, or of two, the passages that have it as an anchor, with the letters before it."""
        number = {w: k for k, w in enumerate(sorted({w for own in self.own for anchor, _ in own for w in anchor.split(" ")}))}
        self.vocabulary = pa.array(list(number), pa.string())
        kinds = [[number[w] for w in anchor.split(" ")] for own in self.own for anchor, _ in own]
        kinds = np.array([k[0] if len(k) == 1 else self._two(k[0], k[1]) for k in kinds], np.int64)
        order = np.argsort(kinds, kind="stable")
        self.anchor = kinds[order]
        self.anchor_of = np.repeat(np.arange(len(self.own)), [len(own) for own in self.own])[order]
        self.anchor_at = np.array([at for own in self.own for _, at in own], np.int64)[order]

    def _two(self, word, after):
        return len(self.vocabulary) * (1 + word) + after

    def _index_groups(self) -> None:
        """By size of groups: all codes; and for each passage what _shared and near need.

        Where a code stands in a passage is kept as bits, each for a 32nd of the passage.
        """
        self.size = np.where(self.letters >= LONGER, 4, 3)
        letters = np.unique(np.frombuffer("".join(self.plain).encode("utf-32-le", "surrogatepass"), np.uint32))
        self.kinds = min(len(letters), 32_749) + 1  # letters that share a number only make more groups equal; 0 is of letters that no passage has
        self.letter = np.zeros(int(letters.max(initial=0)) + 2, np.int64)
        self.letter[letters] = np.arange(len(letters)) % 32_749 + 1
        self.codes, self.direct, self.bits, self.stands, self.places, self.fewest = {}, {}, {}, {}, {}, {}
        for q in np.unique(self.size).tolist():
            own = np.flatnonzero((self.size == q) & (self.letters >= q)).tolist()
            coded = [self._coded(self.plain[i], q) for i in own]
            self.codes[q] = np.unique(np.concatenate([*coded, np.zeros(0, np.int64)]))
            if self.kinds**q <= DIRECT:
                self.direct[q] = np.full(self.kinds**q, len(self.codes[q]))
                self.direct[q][self.codes[q]] = np.arange(len(self.codes[q]))
            self.bits[q] = np.zeros(len(self.codes[q]) + 1, np.uint32)  # those of one passage at a time; the last is of groups that no passage has
            for i, c in zip(own, coded, strict=True):
                self.stands[i] = np.searchsorted(self.codes[q], c)
                number, back = np.unique(self.stands[i], return_inverse=True)
                bits = np.zeros(len(number), np.uint32)
                np.bitwise_or.at(bits, back, np.uint32(1) << (np.arange(len(c)) * 32 // len(c)).astype(np.uint32))
                most, longest = self.edits[i], len(self.plain[i]) + self.edits[i]
                # Stretches of runs that are tried one after the other: those of an anchor, parts of these, and each run.
                self.places[i] = number, bits, [(n, _within(n - 1 + longest, n - 1 + most, most, len(c))) for n in (2 * most + 1, most // 2 + 1, 1)]
                self.fewest[i] = self._need(i, np.arange(len(self.plain[i]), longest + 1)).min()

    def _coded(self, text: str, q: int) -> np.ndarray:
        """Each so many letters that stand together, as one number."""
        c = self.letter[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.letter) - 1)]
        n = max(len(c) - q + 1, 0)
        return functools.reduce(lambda code, j: code * self.kinds + c[j : j + n], range(q), np.zeros(n, np.int64))

    def groups(self, text: str) -> dict[int, np.ndarray]:
        """By size: the number of the group of letters at each place, and what a run may reach behind the text."""
        out = {}
        for q, codes in self.codes.items():
            code = self._coded(text, q)
            if q in self.direct:
                found = self.direct[q].take(code, mode="clip")
            else:
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                found = np.where(codes[at] == code, at, len(codes)) if len(codes) else at
            out[q] = np.append(found, np.full(3 * self.longest + q, len(codes)))
        return out

    def _need(self, i: int, longer: np.ndarray) -> np.ndarray:
        """An edit touches as many groups as a group has letters, so a near run shares all groups of the longer text but those."""
        return longer - self.size[i] + 1 - self.size[i] * np.floor(longer * (1 - self.least) + 1e-9)

    def anchored(self, kinds: np.ndarray, starts: np.ndarray, text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, from, to): the words at which a run of a passage may begin by one of its anchors.

        Of each word: kinds, its number in the vocabulary or -1; starts, its place; text, its document. heads: where the words of documents begin.
        """
        one = np.flatnonzero(kinds >= 0)
        two = one[(one + 1 < heads[text[one] + 1]) & (kinds[np.minimum(one + 1, len(kinds) - 1)] >= 0)]
        word = np.concatenate([one, two])
        kind = np.concatenate([kinds[one], self._two(kinds[two], kinds[two + 1])])
        i, j = np.searchsorted(self.anchor, kind), np.searchsorted(self.anchor, kind, side="right")
        of, word = _runs(i, j), np.repeat(word, j - i)
        item, row = self.anchor_of[of], text[word]
        begin = starts[word] - self.anchor_at[of]
        from_ = np.maximum(np.searchsorted(starts, begin - self.most[item]), heads[row])
        to = np.minimum(np.searchsorted(starts, begin + self.most[item], side="right"), heads[row + 1])
        some = np.flatnonzero(to > from_)
        item, from_, to = item[some], from_[some], to[some]
        if not len(item):
            return item, from_, to
        # Those of a passage that overlap are one; the ends of what came before, with the passage as the upper digit.
        order = np.lexsort((from_, item))
        item, from_, to = item[order], from_[order], to[order]
        upto = np.maximum.accumulate(item * (len(starts) + 1) + to)
        own = np.flatnonzero(np.r_[True, (item * (len(starts) + 1) + from_)[1:] >= upto[:-1]])
        ends = np.append(own[1:], len(item)) - 1
        return item[own], from_[own], upto[ends] - item[own] * (len(starts) + 1)

    def near(self, i: int, from_: np.ndarray, to: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, heads: np.ndarray, groups: dict[int, np.ndarray]) -> np.ndarray:
        """Those of the words between from_ and to at which a run of passage i begins that may be near.

        ends: where each word ends; groups: by size, the number of the group of letters at each place; the others as in anchored.
        """
        begin = starts[from_]
        if i in self.places:  # else it has no group
            number, bits, stretches = self.places[i]
            own = self.bits[int(self.size[i])]
            own[number] = bits
            n, right = stretches[0]
            parts = (starts[to - 1] - begin) // n + 1
            begin = np.repeat(begin, parts) + n * _runs(np.zeros(len(parts), np.int64), parts)
            to = np.repeat(to, parts)
            some = self._shared(i, begin, right, groups, None) >= self.fewest[i]
            begin, to = begin[some], to[some]
            from_, to = np.searchsorted(starts, begin), np.minimum(np.searchsorted(starts, begin + n), to)
        word, begin = _runs(from_, to), np.repeat(begin, to - from_)
        run = ends[np.minimum(word + self.words[i], heads[text[word] + 1]) - 1] - starts[word]
        some = np.abs(run - len(self.plain[i])) <= self.edits[i]
        word, run, begin = word[some], run[some], begin[some]
        if i not in self.places:
            return word
        for n, right in stretches[1:]:
            tile = begin + (starts[word] - begin) // n * n
            first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else tile
            shared = self._shared(i, tile[first], right, groups, run if n == 1 else None)
            some = shared >= (self._need(i, np.maximum(run, len(self.plain[i]))) if n == 1 else self.fewest[i])
            some = np.repeat(some, np.diff(first, append=len(word)))
            word, run, begin = word[some], run[some], begin[some]
        word = word[self._standing(i, starts[word], run, groups)]
        own[number] = 0
        return word

    def _standing(self, i: int, from_: np.ndarray, run: np.ndarray, groups: dict[int, np.ndarray]) -> np.ndarray:
        """Of runs from from_, whether enough groups of passage i, each once, stand in them where edits can have moved them."""
        right, q, longest = np.zeros(len(from_), bool), int(self.size[i]), len(self.plain[i]) + self.edits[i]
        own = np.lib.stride_tricks.sliding_window_view(groups[q], longest)
        at, far, kinds, stands = np.arange(longest), 2 * longest, len(self.bits[q]), self.stands[i]
        for k in range(0, len(from_), step := max(LOOKED_UP // longest, 1)):
            each = run[k : k + step, None]
            longer = np.maximum(each, len(self.plain[i]))
            most = np.floor(longer * (1 - self.least) + 1e-9).astype(np.int64)
            group = own[from_[k : k + step]]
            pair, x = np.nonzero((self.bits[q].take(group, mode="clip") != 0) & (at <= each - q))
            place = np.append(np.sort((pair * kinds + group[pair, x]) * far + x), np.iinfo(np.int64).max)
            want = (np.arange(len(each))[:, None] * kinds + stands) * far + np.arange(len(stands))
            least = want - np.minimum(most, np.arange(len(stands)))
            found = place[np.searchsorted(place, least)] <= want + most
            right[k : k + step] = found.sum(axis=1) >= self._need(i, longer)[:, 0]
        return right

    def _shared(self, i: int, from_: np.ndarray, right: np.ndarray, groups: dict[int, np.ndarray], wide: np.ndarray | None) -> np.ndarray:
        """At how many places behind each from_, before wide, a group of passage i stands that has one of the bits that are right there."""
        bits, out = self.bits[int(self.size[i])], np.zeros(len(from_), np.int64)
        own = np.lib.stride_tricks.sliding_window_view(groups[int(self.size[i])], len(right))
        for k in range(0, len(from_), step := max(LOOKED_UP // len(right), 1)):
            shared = (bits.take(own[from_[k : k + step]], mode="clip") & right) != 0
            if wide is not None:
                shared &= np.arange(len(right)) < wide[k : k + step, None]
            out[k : k + step] = np.add.reduce(shared.view(np.uint8), axis=1, dtype=np.uint32)
        return out


def _within(width: int, behind: int, before: int, n: int) -> np.ndarray:
    """For each of so many places the bits of the n places of a passage that are at most so far behind or before it."""
    at = np.arange(width)
    low, high = (np.clip(x, 0, n - 1) * 32 // n for x in (at - behind, at + before))
    bits = (np.uint64(2) << high.astype(np.uint64)) - (np.uint64(1) << low.astype(np.uint64))
    return np.where(at - behind < n, bits, 0).astype(np.uint32)


def _runs(from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """All numbers from each from_ to each to, without it."""
    n = to - from_
    return np.arange(n.sum()) + np.repeat(from_ - (np.cumsum(n) - n), n)


def _found(batches: Iterator[pa.RecordBatch], block: Passages, fuzzy: bool) -> Iterator[pa.RecordBatch]:
    """(row, item, method, start, run) of exact and normalised places, and of runs that may be near."""
    for batch in batches:
        letters = np.cumsum(pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)) // TOGETHER
        for own in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(letters)) + 1) if batch.num_rows else []:
            part = batch.slice(own[0], len(own))
            texts, lows = part.column(1).to_pylist(), part.column(2).to_pylist()
            rows, done = [], set()
            for row, (text, low) in enumerate(zip(texts, lows, strict=True)):
                held = set(low.split(" "))
                for i, inner in enumerate(block.inner):
                    if inner <= held:
                        at = text.find(block.need[i])
                        if at >= 0:
                            rows.append((row, i, "exact", at, None))
                            done.add((row, i))
                            continue
                        at = low.find(block.plain[i]) if fuzzy and block.plain[i] else -1
                        if at >= 0:
                            rows.append((row, i, "normalized", low.count(" ", 0, at), None))
                            done.add((row, i))
            yield _as_batch(part, rows, block)
            for rows in _near(part.column(2), lows, block, done) if fuzzy else ():
                yield _as_batch(part, rows, block)


def _near(column: pa.Array, lows: list[str], block: Passages, done: set[tuple[int, int]]) -> Iterator[list[tuple]]:
    """Runs that may be near, of texts that are searched as one, a letter between two of them."""
    lists = pc.split_pattern(column, " ")
    words = lists.flatten().dictionary_encode()
    number = words.indices.to_numpy()
    kinds = pc.fill_null(pc.index_in(words.dictionary, block.vocabulary), -1).to_numpy().astype(np.int64).take(number)
    ends = np.cumsum(pc.utf8_length(words.dictionary).to_numpy().astype(np.int64).take(number) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    heads = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    text = np.repeat(np.arange(len(lows)), np.diff(heads))
    item, from_, to = block.anchored(kinds, starts, text, heads)
    if not len(item):
        return
    groups = block.groups("\n".join(lows))
    rows, cuts = [], np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = int(item[i])
        for word in block.near(own, from_[i:j], to[i:j], starts, ends, text, heads, groups).tolist():
            row = int(text[word])
            if (row, own) not in done:
                begin, stop = starts[word] - starts[heads[row]], ends[min(word + block.words[own], heads[row + 1]) - 1] - starts[heads[row]]
                rows.append((row, own, "fuzzy", word - int(heads[row]), lows[row][begin:stop]))
        if len(rows) > 50_000:
            yield rows
            rows = []
    yield rows


def _as_batch(batch: pa.RecordBatch, rows: list[tuple], block: Passages) -> pa.RecordBatch:
    row, item, method, start, run = zip(*rows, strict=True) if rows else ((),) * 5
    need = [block.plain[i] if r is not None else None for i, r in zip(item, run, strict=True)]
    cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int32()), pa.array(method, pa.string()), pa.array(start, pa.int64()), pa.array(run, pa.string()), pa.array(need, pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc", "place", "method", "start", "run", "need"])


def _blocks(items: DataFrame) -> Iterator[list]:
    """The passages in blocks, as the driver reads them."""
    block, letters = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) == MOST or letters + len(r.need) > LETTERS):
            yield block
            block, letters = [], 0
        block.append(r)
        letters += len(r.need)
    yield block


def matched(passages: DataFrame, docs: DataFrame, least: float = 0.82, item: str = "item_id", doc: str = "doc_id", text: str = "text", fuzzy: bool = True) -> DataFrame:
    """(item, doc, method, score, start): the best method of each pair that has one.

    ``exact`` and ``normalized`` score 1. ``fuzzy`` has the best score of all runs of as many words as the passage has: 1
    less the edit distance, by the letters of the longer one, among those with an unchanged anchor. start is the character of an exact match, else the word; of
    equal runs the first. Passages are the queries and are read in blocks of bounded size, one reading of docs each.
    Without ``fuzzy``, exact places alone are looked for.
    """
    items = passages.select(F.col(item).alias("item"), F.trim(F.col(text)).alias("need")).where("need <> ''").withColumn("plain", plain(F.col("need")))
    have = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).where("text is not null").withColumn("plain", plain(F.col("text")))
    kinds = f"doc {have.schema['doc'].dataType.simpleString()}, place int, method string, start bigint, run string, need string"
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if have.rdd.getNumPartitions() < cores:  # few files or row groups would leave most cores idle
        have = have.repartition(cores)
    out = None
    for rows in _blocks(items):
        block = Passages([r.need for r in rows], [r.plain for r in rows], least)
        found = have.mapInArrow(lambda x: _found(x, block, fuzzy), kinds)  # noqa: B023 - each block has a plan of its own
        longest = F.greatest(F.length("run"), F.length("need"))
        most = F.floor(longest * F.lit(1 - least) + F.lit(1e-9)).cast("int")
        found = found.withColumn("most", most).withColumn("away", F.expr("if(method = 'fuzzy', levenshtein(run, need, most), 0)"))
        # Runs that are not near have no score; they go when all is grouped, since a condition here would compare each run twice.
        score = F.when(F.col("method") != "fuzzy", F.lit(1.0)).when(F.col("away") >= 0, F.round(1 - F.col("away") / longest, 6))
        found = found.withColumn("score", score)
        names = passages.sparkSession.createDataFrame([(k, r.item) for k, r in enumerate(rows)], f"place int, item {items.schema['item'].dataType.simpleString()}")  # a block at most
        found = found.join(names, "place").select("item", "doc", "method", "score", "start")
        out = found if out is None else out.unionByName(found)
    rank = F.when(F.col("method") == "exact", 2).when(F.col("method") == "normalized", 1).otherwise(0)
    best = out.groupBy("item", "doc").agg(F.max_by(F.struct("method", "score", "start"), F.struct(rank, "score", -F.col("start"))).alias("b"))
    return best.where("b.score is not null").select(F.col("item").alias(item), F.col("doc").alias(doc), "b.method", "b.score", "b.start")
