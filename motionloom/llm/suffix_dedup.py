"""Operator 3: removal of long repeated byte strings, by a logarithmic family of suffix arrays.

A suffix of a text is looked at only over its first ``length`` bytes, its
window. Two equal windows have the same anchor: the leftmost of their 32-byte
grams with the least hash. So all windows with one anchor gram meet in one
place, whatever texts they come from, and no window has to be sent anywhere
alone:

1. One pass over the texts finds the anchors: about one in 84 bytes. For each:
   a hash of its gram, its place, the run of windows that have it, and a hash
   of the bytes under that run (its snippet). Where a text goes on repeating
   itself, equal snippets that follow one another are one entry with a count.
2. Anchors whose gram occurs once are done. Equal snippets are summed up to one
   with a weight.
3. The snippets are cut from the texts and go, sorted by gram, through an index
   family. A new batch of snippets gets a suffix array; it is scanned against
   the existing levels for windows that both have; then it becomes a level, and
   levels of equal size merge, so that their sizes grow geometrically. Levels
   of a gram that is over are dropped.
4. A gram with more than ``reach`` windows is divided first, so that no task
   gets more: its windows are told apart by the offset of the gram in them, in
   halves, quarters and so on of the possible offsets. The windows of one part
   all hold the same stretch around the gram, whose bytes then take the gram's
   place. Equal windows have equal offsets and stretches, so they stay
   together, and at the last division only equal windows do.
5. The repeated windows go back to their texts as intervals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted_join, discard, materialize, text_of, utf8_chunks

GRAM = 32
#: Stands for a null id inside.
NO_ID = -(1 << 63)
#: Window starts in one part of a text; a place within a part fits 20 bits.
PART = 1 << 20
_ANCHOR = "gram long, snippet long, id long, text_hash long, first int, last int, at int, end int, copies int"
_WINDOWS = "gram long, snippet long, n long, windows array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class Settings:
    length: int = 200
    #: Windows of one gram that go to one task undivided.
    reach: int = 1 << 19
    #: Bytes of a batch of the index family.
    batch: int = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on (one for each place that has them)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n, factor = 1, 0xD6E8FEB86659FD93
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor & 0xFFFFFFFFFFFFFFFF
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _same_as_next(data: np.ndarray, gram: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """For each anchor but the last: whether the next one has the same snippet. The windows of neighbours adjoin."""
    width = last - first
    like = (gram[1:] == gram[:-1]) & (width[1:] == width[:-1]) & (np.diff(place - first) == 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], like, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        step, start = int(width[a]) + 1, int(first[a])
        differ = data[start : last[b - 1] + length] != data[start + step : last[b] + length]
        before = np.concatenate([[0], np.cumsum(differ)])
        like[a:b] = before[last[a:b] + length - start] == before[first[a:b] - start]
    return like


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: gram hash, place, first and last window start, last start of the equal ones that follow, their number."""
    n, found = len(data), []
    for base in range(0, n - length + 1, PART):
        h = gram_hashes(data[base : base + PART + length - 1])
        low = np.uint64(PART * 2 - 1)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        at = (least & low).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(at)]]) - 1
        gram, place = h[at[first]].view(np.int64), at[first]
        same = _same_as_next(data[base : base + PART + length - 1], gram, place, first, last, length)
        new = np.flatnonzero(np.concatenate([[True], ~same]))
        copies = np.diff(np.concatenate([new, [len(gram)]]))
        found.append((gram[new], place[new] + base, first[new] + base, last[new] + base, last[new + copies - 1] + base, copies))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(6))


def _anchor_batches(batches, s: Settings):
    from xxhash import xxh64_intdigest

    for batch in batches:
        for a, b in utf8_chunks(batch.column(2)):
            ids, hashes, texts = (c[a:b].to_pylist() for c in batch.columns)
            out = []
            for i, h, text in zip(ids, hashes, texts, strict=True):
                data = text.encode("utf-8")
                if len(data) < s.length:
                    continue
                gram, place, first, last, end, copies = anchors(np.frombuffer(data, np.uint8), s.length)
                at = place - first
                snippet = [xxh64_intdigest(data[f : l + s.length], p) for p, f, l in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
                n = len(gram)
                out.append((gram, np.array(snippet, np.uint64).view(np.int64), np.full(n, i, np.int64), np.full(n, h, np.int64), *(x.astype(np.int32) for x in (first, last, at, end, copies))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[x.split(" ")[0] for x in _ANCHOR.split(", ")])


class SuffixArray:
    """The windows of a batch of snippets in lexicographic order.

    Ranks of 8 bytes are doubled to 16, 32 and so on, and the last step takes
    two overlapping ranks, so equal windows, and only they, get equal ranks.
    """

    def __init__(self, snippets: list[bytes], length: int, weights: list[int] | None = None):
        self.length = length
        self.text = np.frombuffer(b"".join(snippets) + bytes(8), np.uint8)
        sizes = np.fromiter(map(len, snippets), np.int64, len(snippets))
        begin = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        #: For each window: the snippet, and its start in the snippet.
        self.owner = np.repeat(np.arange(len(snippets)), windows)
        self.offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = begin[self.owner] + self.offset
        wide = self.text.astype(np.uint64)
        rank = np.zeros(len(wide) - 8, np.uint64)
        for k in range(8):
            rank = rank << np.uint64(8) | wide[k : len(rank) + k]
        size = 8
        while 2 * size <= length:
            rank = self._next(rank, size)
            size *= 2
        if size < length:
            rank = self._next(rank, length - size)
        self.rank = rank[self.start]
        self.order = np.argsort(self.rank, kind="stable")
        ranked = self.rank[self.order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        #: Windows that occur twice or more in this batch.
        self.repeated = np.zeros(len(self.rank), bool)
        weight = np.asarray([1] * len(snippets) if weights is None else weights, float)[self.owner[self.order]]
        self.repeated[self.order] = np.bincount(group, weight)[group] > 1 if len(ranked) else False
        #: One window of each different content, in order.
        self.distinct = self.order[new]

    @staticmethod
    def _next(rank: np.ndarray, step: int) -> np.ndarray:
        _, rank = np.unique(rank, return_inverse=True)
        rank = rank.astype(np.uint64)
        return rank[:-step] << np.uint64(32) | rank[step:]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """The bytes of the given windows."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)
        return np.ascontiguousarray(view[self.start[windows]]).view(f"S{self.length}").reshape(-1)


class IndexFamily:
    """Levels of sorted windows. Of equal windows a level has one; all others are known to repeat."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Scan a batch's sorted windows against all levels, add it as a level, and return the names on both sides of a match."""
        found = []
        for _, level, owners in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            same = level[at] == keys
            found += [owners[at[same]], names[same]]
        self.levels.append((0, keys, names))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, x), (_, b, y) = self.levels[-2:]
            at = np.searchsorted(a, b)
            new = a[np.minimum(at, len(a) - 1)] != b
            at, b, y = at[new], b[new], y[new]
            mine = at + np.arange(len(b))  # where the second level's windows go
            other = np.ones(len(a) + len(b), bool)
            other[mine] = False
            key, name = np.empty(len(other), a.dtype), np.empty(len(other), x.dtype)
            key[mine], key[other], name[mine], name[other] = b, a, y, x
            self.levels[-2:] = [(size + 1, key, name)]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _intervals(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeated_windows(stream, length: int, batch: int):
    """stream: (gram, snippet name, weight, bytes), sorted by gram. Yields (gram, name, weight, flags of its windows).

    A window repeats if it occurs twice, or once in a snippet that does. A
    gram that ends within its batch needs no level. One that goes on stays
    open: its windows of each batch meet the levels of its earlier batches.
    """
    family, held, open_gram = None, [], None

    def run(rows: list, goes_on: bool):
        nonlocal family, held, open_gram
        array = SuffixArray([r[3] for r in rows], length, [r[2] for r in rows])
        counts = np.bincount(array.owner, minlength=len(rows))
        flags = np.split(array.repeated, np.cumsum(counts)[:-1])
        edges = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]]
        for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
            gram, stays = rows[a][0], goes_on and b == len(rows)
            if gram != open_gram and not stays:
                yield from ((*rows[i][:3], flags[i]) for i in range(a, b))
                continue
            if gram != open_gram:
                family, held, open_gram = IndexFamily(length), [], gram
            owner = array.owner[array.distinct]
            windows = array.distinct[(owner >= a) & (owner < b)]
            number = len(held) + array.owner[windows] - a
            held += [(*rows[i][1:3], flags[i]) for i in range(a, b)]
            for name in family.add(array.keys(windows), number << np.int64(32) | array.offset[windows]).tolist():
                held[name >> 32][2][name & 0xFFFFFFFF] = True
            if not stays:
                yield from ((gram, *h) for h in held)
                family, held, open_gram = None, [], None

    rows, size = [], 0
    for row in stream:
        if rows and size >= batch:
            yield from run(rows, rows[-1][0] == row[0])
            rows, size = [], 0
        rows.append(row)
        size += len(row[3])
    if rows:
        yield from run(rows, False)


_CUT = "gram long, snippet long, n long, at int, data binary"
_CUT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _in_parts(rows, kinds, names, size_of, limit: int = 1 << 22):
    """Record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _snippet_batches(batches, s: Settings):
    """Rows (text, wanted array<struct<gram, snippet, n, at, first, last>>) to cut snippets."""

    def rows():
        for batch in batches:
            wanted = batch.column(1)
            start = wanted.offsets.to_numpy()
            columns = [wanted.values.field(k).to_numpy() for k in range(6)]
            for i, (a, b) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
                data = batch.column(0)[i].as_py().encode("utf-8")
                for gram, snippet, n, at, first, last in zip(*(c[a:b].tolist() for c in columns), strict=True):
                    yield gram, snippet, n, at, data[first : last + s.length]

    return _in_parts(rows(), _CUT_KINDS, [x.split(" ")[0] for x in _CUT.split(", ")], lambda r: len(r[4]) + 60)


def _family_batches(batches, s: Settings):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    def stream():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

    rows = ((gram, name, n, _intervals(flags)) for gram, name, n, flags in repeated_windows(stream(), s.length, s.batch) if flags.any())
    return _in_parts(rows, kinds, ["gram", "snippet", "n", "windows"], lambda r: 100 + 100 * len(r[3]))


_PIECE = "part long, piece long, gram long, snippet long, n long, base int, at int, data binary"


def divided(data: bytes, at: int, depth: int, length: int):
    """A snippet's pieces by the gram's offset in their windows, in 2**depth ranges.

    Yields (number of the range, bytes that all windows of that range hold, first window, the gram's place in the piece, piece).
    """
    offsets, cells = length - GRAM + 1, 1 << depth
    most, least = at, at - (len(data) - length)
    for cell in range(least * cells // offsets, most * cells // offsets + 1):
        lo, hi = -(-offsets * cell // cells), -(-offsets * (cell + 1) // cells) - 1
        a, b = max(lo, least), min(hi, most)
        if a <= b:
            yield cell, data[at - lo : at + length - hi], at - b, b, data[at - b : at - a + length]


def _divide_batches(batches, s: Settings, depth: int):
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())

    def rows():
        for batch in batches:
            for gram, snippet, n, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell, core, base, place, piece in divided(data, at, depth, s.length):
                    part = xxh64_intdigest(core, depth << 16 | cell)
                    yield signed(part), signed(xxh64_intdigest(piece, place)), gram, snippet, n, base, place, piece

    return _in_parts(rows(), kinds, [x.split(" ")[0] for x in _PIECE.split(", ")], lambda r: len(r[7]) + 80)


def _by_size(cut: DataFrame, s: Settings, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """The snippets of grams within ``reach``, and those of the others.

    A gram beyond it has thousands of snippets, so the few such grams are
    joined once for each salt of the snippets.
    """
    sizes = cut.groupBy("gram").agg(F.sum(F.octet_length("data") - (s.length - 1)).alias("size")).filter(F.col("size") > s.reach)
    over = materialize(sizes.select("gram", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), "over")
    if over.isEmpty():
        return cut, cut.limit(0)
    salted = cut.withColumn("salt", F.pmod("snippet", F.lit(salts)).cast("int"))
    return tuple(salted.join(over.hint("merge"), ["gram", "salt"], how).drop("salt") for how in ("left_anti", "left_semi"))


def find_windows(cut: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows (gram, snippet, n, windows): the repeated windows of the snippets (gram, snippet, n, at, data).

    A snippet can have several rows. Snippets must differ in (gram, snippet).
    """
    s = settings or Settings()
    ready, members, depth = [], [], 0
    small, large = _by_size(cut, s)
    ready.append(small)
    while not large.isEmpty():  # after eight divisions a part has equal windows only, which are one row
        depth += 1
        grown = depth
        pieces = materialize(large.select("gram", "snippet", "n", "at", "data").mapInArrow(lambda it, d=grown: _divide_batches(it, s, d), _PIECE), "pieces")
        members.append(pieces.select("part", "piece", "gram", "snippet", "n", "base"))
        one = pieces.groupBy("part", "piece").agg(F.sum("n").alias("n"), F.first("at").alias("at"), F.first("data").alias("data"))
        small, large = _by_size(materialize(one.select(F.col("part").alias("gram"), F.col("piece").alias("snippet"), "n", "at", "data"), "parts"), s)
        ready.append(small)
    columns = ["gram", "snippet", "n", "data"]
    sorted_ = reduce(DataFrame.unionByName, [x.select(columns) for x in ready]).repartition("gram").sortWithinPartitions("gram", "snippet")
    windows = materialize(sorted_.mapInArrow(lambda it: _family_batches(it, s), _WINDOWS), "windows")
    for k, inner in enumerate(reversed(members)):
        found = windows.select(F.col("gram").alias("part"), F.col("snippet").alias("piece"), F.col("n").alias("weight"), "windows")
        up = counted_join(inner, found, ["part", "piece"], "weight")
        shifted = F.expr("transform(windows, w -> named_struct('first', w.first + base, 'last', w.last + base))").alias("windows")
        windows = materialize(windows.unionByName(up.select("gram", "snippet", "n", shifted)), f"windows{k}")
    return windows


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = F.col(id_col).cast("long")
    return df.select(own.alias("own_id"), F.coalesce(own, F.lit(NO_ID)).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def find_repeats(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repeated windows, and the texts that have any candidate.

    First: id, text_hash, windows array<struct<first,last>> (starts of
    repeated windows, as runs of bytes places; not sorted, one row for each
    (id, text_hash)). Second: id, text_hash, text of at least those.
    """
    s = settings or Settings()
    rows = _source(df, id_col, text_col)
    marks = materialize(rows.select("id", "text_hash", "text").mapInArrow(lambda it: _anchor_batches(it, s), _ANCHOR), "anchors")
    shared = marks.groupBy("gram").agg(F.count("*").alias("rows"), F.sum("copies").alias("n")).filter("n > 1").select("gram", "rows")
    shared = materialize(shared, "grams")
    found = materialize(counted_join(marks, shared, ["gram"], "rows").drop("rows"), "candidates")
    discard(marks, shared)
    # One place of each different snippet; how often it occurs.
    place = F.struct("id", "text_hash", "first", "last", "at")
    kinds = found.groupBy("gram", "snippet").agg(F.sum("copies").alias("n"), F.min(place).alias("place"))
    one = F.struct("gram", "snippet", "n", "place.at", "place.first", "place.last")
    wanted = kinds.groupBy("place.id", "place.text_hash").agg(F.collect_list(one).alias("wanted"))
    some = found.select("id", "text_hash").distinct()
    texts = rows.select("id", "text_hash", "text").join(some, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    texts = materialize(texts, "texts")
    cut = texts.join(wanted, ["id", "text_hash"]).select("text", "wanted")
    cut = materialize(cut.mapInArrow(lambda it: _snippet_batches(it, s), _CUT), "cut")
    windows = find_windows(cut, s)
    discard(cut)
    named = windows.withColumnRenamed("n", "weight")
    every = counted_join(found.select("gram", "snippet", "id", "text_hash", "first", "end", "copies"), named, ["gram", "snippet"], "weight")
    own = F.expr("transform(windows, w -> named_struct('first', w.first + first, 'last', w.last + first))")
    every = every.select("id", "text_hash", F.when(F.col("copies") > 1, F.array(F.struct("first", F.col("end").alias("last")))).otherwise(own).alias("windows"))
    # As a set: rows alike in id and text bring the same intervals.
    out = every.groupBy("id", "text_hash").agg(F.flatten(F.collect_set("windows")).alias("windows"))
    out = materialize(out, "repeats")
    discard(found, windows)
    return out, texts


def spans_of(windows: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((w["first"], w["last"] + length) for w in windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_parts(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    cuts = [0, *(x for span in spans for x in span), len(data)]
    return [data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def report(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, n_bytes, n_removed, n_spans, kept_sha256. One row for each row of the table.

    A byte is removed if a string of ``length`` bytes that covers it starts
    anywhere else too, in any text or in its own, overlaps counted. Defined
    results: a null text counts as empty; texts shorter than ``length`` lose
    nothing; repeated rows count as repeats of each other; null ids are read
    as one id; an empty table gives no rows. Ids are read as long. Only the
    two named columns are read. Of texts without repeats only digests move.
    """
    s = settings or Settings()
    repeats, texts = find_repeats(df, s, id_col, text_col)

    def cut(batches):
        import hashlib

        for batch in batches:
            out = []
            for text, windows in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8")
                spans = spans_of(windows, s.length)
                out.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept_parts(data, spans))).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id", "text_hash", "n_removed", "n_spans", "kept_sha256"])

    changed = texts.join(repeats, ["id", "text_hash"]).select("id", "text_hash", "text", "windows")
    changed = changed.mapInArrow(cut, "id long, text_hash long, n_removed long, n_spans long, kept_sha256 string")
    rows = _source(df, id_col, text_col).select("own_id", "id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = rows.join(changed, ["id", "text_hash"], "left")
    return out.select(F.col("own_id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the repeated bytes taken out of the text column.

    A character of which any byte goes is taken out whole, so each remaining
    part is valid text. A null text stays null; other columns may have any name.
    """
    s = settings or Settings()
    repeats, _ = find_repeats(df, s, id_col, text_col)

    @F.pandas_udf("string")
    def cut(text, windows):
        import pandas as pd

        return pd.Series([t if w is None or t is None else "".join(p.decode("utf-8", "ignore") for p in kept_parts(t.encode("utf-8"), spans_of(w, s.length))) for t, w in zip(text, windows, strict=True)], dtype="object")

    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"))
    joined = keyed.join(repeats, ["id", "text_hash"], "left")
    text = F.col("row").getField(text_col)
    new = F.when(F.col("windows").isNull(), text).otherwise(cut(text.cast("string"), F.col("windows")))
    return joined.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))
