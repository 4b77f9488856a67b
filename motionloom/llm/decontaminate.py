"""Operator 6: benchmark decontamination by BM25 retrieval with block-max WAND.

The inverted index holds the test items: for each term the items in order of
their number, with BM25 impacts that are divided by the item's own score. So a
passage with all terms of an item scores 1 for it, and one threshold serves
all items. An item that can be verified with a lower score, as by a question
that weighs less than its answer, has its impacts raised by as much. Items stand in blocks; each list has its greatest impact, and its
greatest impact in each block.

Every document is cut into overlapping passages of twice the longest item's
length and room for text between its parts, and each passage is a query. Passages whose list maxima can't reach
the threshold are done; so are blocks whose block maxima can't. In the blocks
that remain the cursors of the lists go item by item, skipping to the pivot.
All items at or above the threshold are retrieved, and a retrieved item counts
if both its question and its answer are verified by their word shingles.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_of, utf8_chunks

_WORD = re.compile(r"\w+")
_RESULT = "n_passages long, n_retrieved long, contaminated boolean, item_ids array<long>, best_overlap double"


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's own BM25 score that a passage must reach, or less where less can be verified.
    threshold: float = 0.5
    #: Items in a block of the index.
    block: int = 4
    shingle: int = 5
    #: Least share of a question's or an answer's shingles in the passage.
    overlap: float = 0.8
    #: Words between question and answer that fit a passage wherever it begins.
    between: int = 32
    #: Items and bytes of one index, which the README gives the measured memory of; a larger benchmark is done in parts.
    index_items: int = 20_000
    index_bytes: int = 8_000_000


@dataclass(frozen=True)
class Statistics:
    """Of a whole benchmark: items with words, their mean and greatest number of words, and the items that have a term."""

    n: int
    mean: float
    longest: int
    frequency: dict[str, int]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words, n: int) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else set(zip(*(words[i:] for i in range(n)), strict=False))


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; one sentence is all question."""
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def statistics(texts: list[str]) -> Statistics:
    frequency: dict[str, int] = {}
    lengths = []
    for words in map(words_of, texts):
        for w in set(words):
            frequency[w] = frequency.get(w, 0) + 1
        if words:
            lengths.append(len(words))
    return Statistics(len(lengths), sum(lengths) / len(lengths) if lengths else 1.0, max(lengths, default=0), frequency)


class Index:
    """An index of items (number, text); ``whole`` are the statistics of the benchmark that they are a part of."""

    def __init__(self, items: list[tuple[int, str]], s: Settings, whole: Statistics | None = None):
        self.s = s
        items = sorted((i, t) for i, t in items if t is not None and words_of(t))
        whole = whole or statistics([t for _, t in items])
        self.names = [i for i, _ in items]
        #: Words from one passage to the next; a passage has two such steps.
        self.step = max(1, whole.longest + s.between)
        n = len(items)
        self.term: dict[str, int] = {}
        number = lambda text: array("i", [self.term.setdefault(w, len(self.term)) for w in words_of(text)])
        #: Terms of each item's question and answer.
        self.parts = [tuple(map(number, question_and_answer(t))) for _, t in items]
        lists: list[list[tuple[int, int]]] = [[] for _ in self.term]
        sizes = []
        for i, (question, answer) in enumerate(self.parts):
            count: dict[int, int] = {}
            for w in (*question, *answer):
                count[w] = count.get(w, 0) + 1
            for w, tf in count.items():
                lists[w].append((i, tf))
            sizes.append(len(question) + len(answer))
        own, impacts = [0.0] * n, []
        for w, postings in zip(self.term, lists, strict=True):
            df = whole.frequency[w]
            idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
            row = [idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * sizes[i] / whole.mean)) for i, tf in postings]
            for (i, _), x in zip(postings, row, strict=True):
                own[i] += x
            impacts.append(row)
        weight: list[dict[int, float]] = [{} for _ in range(n)]
        for w, (postings, row) in enumerate(zip(lists, impacts, strict=True)):
            for (i, _), x in zip(postings, row, strict=True):
                weight[i][w] = x / own[i]
        #: What an item's impacts are raised by, so that whatever can be verified reaches the threshold.
        self.raised = [max(1.0, s.threshold / self._least(i, weight[i])) for i in range(n)]
        #: Postings by term: item numbers and impacts.
        self.at = [array("i", [i for i, _ in postings]) for postings in lists]
        self.impact = [array("d", [x / own[i] * self.raised[i] for (i, _), x in zip(postings, row, strict=True)]) for postings, row in zip(lists, impacts, strict=True)]
        self.top = np.array([max(x) for x in self.impact])
        self.blocks = max(1, -(-n // s.block))
        entries = []
        for t, (at, impact) in enumerate(zip(self.at, self.impact, strict=True)):
            most: dict[int, float] = {}
            for i, x in zip(at, impact, strict=True):
                most[i // s.block] = max(most.get(i // s.block, 0.0), x)
            entries += [(t, b, x) for b, x in sorted(most.items())]
        self.entry_start = np.searchsorted([t for t, _, _ in entries], np.arange(len(lists) + 1))
        self.entry_block = np.array([b for _, b, _ in entries], np.int64)
        self.entry_most = np.array([x for *_, x in entries])

    def _least(self, item: int, weight: dict[int, float]) -> float:
        """A lower bound of the score of any passage in which the item is verified.

        A word is away only if all shingles with it are, so the lost shingles'
        shares of their words' weights are at least the weight of the words lost.
        """
        parts = [shingles(p, self.s.shingle) for p in self.parts[item]]
        total = sum(weight[w] for w in {w for part in parts for sh in part for w in sh})
        for part in parts:
            held: dict[int, int] = {}
            for sh in part:
                for w in set(sh):
                    held[w] = held.get(w, 0) + 1
            lost = len(part) - int(np.ceil(self.s.overlap * len(part) - 1e-9))
            total -= sum(sorted((sum(weight[w] / held[w] for w in set(sh)) for sh in part), reverse=True)[:lost])
        return max(total, 1e-6)

    def in_block(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Document-at-a-time WAND over one block: the items that reach the threshold."""
        need, end = self.s.threshold, (block + 1) * self.s.block
        cursors = []  # [item, place, term, greatest impact within the block]
        for t in terms:
            at = self.at[t]
            p = bisect_left(at, block * self.s.block)
            if p < len(at) and at[p] < end:
                q = bisect_left(at, end)
                cursors.append([at[p], p, t, max(self.impact[t][p:q])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= need - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(self.impact[c[2]][c[1]] for c in cursors if c[0] == pivot)
                if score >= need - 1e-9:
                    found.append((pivot, score))
                pivot += 1
            left = []
            for c in cursors:
                if c[0] < pivot:
                    at = self.at[c[2]]
                    c[1] = bisect_left(at, pivot, c[1])
                    if c[1] == len(at) or at[c[1]] >= end:
                        continue
                    c[0] = at[c[1]]
                left.append(c)
            cursors = left
        return found

    def candidates(self, ids: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(passage, item) pairs at or above the threshold. ids: terms (-1: none); place: the passage of each."""
        known = ids >= 0
        n_terms = len(self.at)
        pairs = np.unique(place[known] * n_terms + ids[known])
        passage, term = pairs // n_terms, pairs % n_terms
        if not len(pairs):
            return []
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        reach = np.add.reduceat(self.top[term], starts) >= self.s.threshold - 1e-9
        size = np.diff(np.concatenate([starts, [len(pairs)]]))
        open_ = np.repeat(reach, size)
        p, t = passage[open_], term[open_]
        if not len(p):
            return []
        local = np.repeat(np.arange(int(reach.sum())), size[reach])
        n = self.entry_start[t + 1] - self.entry_start[t]
        take = np.repeat(self.entry_start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(local, n) * self.blocks + self.entry_block[take]
        bound = np.bincount(cell, weights=self.entry_most[take], minlength=int(reach.sum()) * self.blocks)
        out = []
        first, wide = starts[reach], size[reach]
        for c in np.flatnonzero(bound >= self.s.threshold - 1e-9).tolist():
            k, block = divmod(c, self.blocks)
            a = first[k]
            terms = term[a : a + wide[k]].tolist()
            out += [(int(passage[a]), i) for i, _ in self.in_block(terms, block)]
        return out

    def verify(self, ids: list[int], item: int) -> float | None:
        """The share of the item's shingles in a passage of terms if its question and its answer are both verified, else None."""
        seen: dict[int, set[tuple]] = {}
        there = every = 0
        for part in self.parts[item]:
            wanted = shingles(part, self.s.shingle)
            if not wanted:
                continue
            k = len(next(iter(wanted)))  # a part with fewer words than a shingle is one shingle
            if k not in seen:
                seen[k] = shingles(ids, k)
            both = len(wanted & seen[k])
            if both < self.s.overlap * len(wanted) - 1e-9:
                return None
            there, every = there + both, every + len(wanted)
        return there / every


def _search(batches, index: Index):
    step = index.step
    for batch in batches:
        for a, b in utf8_chunks(batch.column(1)):
            texts = [words_of(t) for t in batch.column(1)[a:b].to_pylist()]
            size = np.array([len(w) for w in texts])
            count = np.maximum(1, -(-size // step))  # the last window may be short
            base = np.concatenate([[0], np.cumsum(count)])
            begin = np.concatenate([[0], np.cumsum(size)])
            found: list[dict[int, float]] = [{} for _ in texts]
            retrieved: list[set[int]] = [set() for _ in texts]
            if index.names:
                ids = np.fromiter((index.term.get(w, -1) for words in texts for w in words), np.int64, begin[-1])
                place = np.concatenate([base[d] + np.arange(n) // step for d, n in enumerate(size)]) if texts else np.empty(0, np.int64)
                # A window is this step and the next one, so a word is in its own step's window and the one before.
                again = np.concatenate([np.arange(n) // step > 0 for n in size])
                pairs = index.candidates(np.concatenate([ids, ids[again]]), np.concatenate([place, place[again] - 1]))
                for passage, item in pairs:
                    d = int(np.searchsorted(base, passage, side="right")) - 1
                    retrieved[d].add(item)
                    first = begin[d] + (passage - base[d]) * step
                    share = index.verify(ids[first : min(first + 2 * step, begin[d + 1])].tolist(), item)
                    if share is not None:
                        found[d][item] = max(found[d].get(item, 0.0), share)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[a:b],
                    pa.array(np.where(size > 0, count, 0), pa.int64()),
                    pa.array([len(r) for r in retrieved], pa.int64()),
                    pa.array([bool(f) for f in found]),
                    pa.array([sorted(index.names[i] for i in f) for f in found], pa.list_(pa.int64())),
                    pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
                ],
                names=["id", "n_passages", "n_retrieved", "contaminated", "item_ids", "best_overlap"],
            )


def _term_batches(batches):
    """Rows (part, text) as (part, term, words): one for each different word of an item; words: the item's length, in its first row only."""
    for batch in batches:
        for part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            terms = sorted(set(words))
            sizes = [len(words)] + [None] * (len(terms) - 1) if terms else []
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(terms), pa.int32()), pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], names=["part", "term", "words"])


def indexes(benchmark: DataFrame, s: Settings, item_col: str = "item_id", text_col: str = "text"):
    """Yields the index, in as many parts as its bounds ask for, one after the other; each part holds whole items.

    All parts score by the statistics of the whole benchmark, of which the
    driver holds those of one part's terms at a time.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // s.index_items), -(-size // s.index_bytes))
    if parts == 1:
        yield Index([tuple(r) for r in items.collect()], s)
        return
    items = materialize(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")), "items")
    terms = materialize(items.select("part", "text").mapInArrow(_term_batches, "part int, term string, words long"), "terms")
    total, words, longest = terms.agg(F.count("words"), F.sum("words"), F.max("words")).first()
    counts = materialize(terms.groupBy("term").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")), "term_counts")
    for k in range(parts):
        frequency = {r["term"]: r["n"] for r in counts.filter(F.array_contains("parts", k)).select("term", "n").toLocalIterator()}
        yield Index([tuple(r) for r in items.filter(F.col("part") == k).select("item", "text").collect()], s, Statistics(total, words / total if total else 1.0, longest or 0, frequency))


def find_leaks(df: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns: the id column, n_passages, n_retrieved, contaminated, item_ids, best_overlap. One row for each row.

    An item is verified in a passage if of its question's (all but the last
    sentence) distinct five-word shingles at least ``overlap`` are there, and
    of its answer's (the last sentence) too, whatever stands between. Up to
    ``between`` words there fit a passage in any place. A part with fewer
    words than a shingle must be there as a whole; an item of one sentence is
    all question. best_overlap: the greatest share of a verified item's
    shingles. Defined results: a null or empty text has no passages and is
    clean; an empty benchmark leaves all clean; whatever a passage verifies is
    retrieved; items without words are never found; repeated rows give
    repeated results; null ids stay null. Only the named columns are read.

    Documents aren't shuffled. A benchmark beyond the index bounds is searched
    part by part, with the same scores and results: the parts' results are
    written, and summed by id and text.
    """
    s = settings or Settings()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def searched(rows: DataFrame, index: Index) -> DataFrame:
        return rows.mapInArrow(lambda it: _search(it, index), f"id {rows.schema['id'].dataType.simpleString()}, {_RESULT}")

    parts = indexes(benchmark, s, item_col, item_text_col)
    first, second = next(parts), next(parts, None)
    if second is None:
        return searched(rows, first).withColumnRenamed("id", id_col)
    keyed = rows.select(F.struct("id", F.xxhash64("text").alias("key")).alias("id"), "text")
    every = materialize(searched(keyed, first).withColumn("first", F.lit(1)), "leaks")
    while second is not None:
        every = every.unionByName(materialize(searched(keyed, second).withColumn("first", F.lit(0)), "leaks"))
        second = next(parts, None)
    summed = every.groupBy("id").agg(
        F.max("n_passages").alias("n_passages"), F.sum(F.col("n_retrieved")).alias("n_retrieved"), F.max("contaminated").alias("contaminated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("best_overlap").alias("best_overlap"), F.sum("first").alias("copies"),
    )
    each = (F.col("n_retrieved") / F.col("copies")).cast("long").alias("n_retrieved")
    out = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id.id").alias(id_col), "n_passages", each, "contaminated", "item_ids", "best_overlap")


def drop_leaks(df: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows without a verified item, with all their columns.

    With one index the verdict is reached within the row's own batch. Of a
    benchmark in parts, each part's leaking texts are written by their hash,
    and their rows are left out by a join.
    """
    parts = indexes(benchmark, settings or Settings())
    first, second = next(parts), next(parts, None)
    if second is None:
        return df.filter(~_leak_udf(first)(text_of(f"`{text_col}`")))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.xxhash64(text_of(f"`{text_col}`")).alias("k1"), F.xxhash64(F.lit(1), text_of(f"`{text_col}`")).alias("k2"))
    text, found, index = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), [], first
    while index is not None:
        found.append(materialize(keyed.filter(_leak_udf(index)(text)).select("k1", "k2").distinct(), "leaks"))
        index, second = second, next(parts, None)
    leaks = reduce(DataFrame.unionByName, found).distinct()
    return keyed.join(leaks.hint("merge"), ["k1", "k2"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def _leak_udf(index: Index):
    @F.pandas_udf("boolean")
    def leaks(text):
        import pandas as pd

        column = pa.array(text, pa.string())
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["id", "text"])
        return pd.Series([x for out in _search([batch], index) for x in out.column(3).to_pylist()], dtype="bool")

    return leaks
