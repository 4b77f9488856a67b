"""Operator 10: near-duplicate documents by b-bit MinHash, links confirmed on full sets.

1. One pass over the texts makes each document's set of word shingles, its
   minima under 160 hash functions, 40 band keys of 4 minima each, and a packed
   signature of the low 2 bits of each minimum. Documents with the same words
   in the same order become one node before anything else.
2. In each band bucket a star joins all nodes to one centre. A pair's
   similarity is estimated from the signatures by bit counts, corrected for
   chance agreement; pairs that may reach the threshold are confirmed on their
   full shingle sets. Links give components. A second star, with another
   centre, follows for buckets that still hold several components.
3. The nodes of buckets that then still hold several components are compared
   across components by their rare shingles. Two sets that reach the threshold
   share one of the rarest fifth of either, so only nodes that share such a
   shingle, one that at most ``rare`` nodes have, make a pair: their number
   grows with the nodes, not with the square of a bucket. What they share and
   what is left bounds their intersection; the pairs that can reach the
   threshold are confirmed on their full sets.
4. What is left are nodes with too few rare shingles, that is close copies of
   something frequent. A pair of them without a rare shingle in common shares
   frequent ones at most, which rules most pairs out by size alone. In a bucket
   only those outside its largest component are compared with the others, in
   blocks of bounded size: first by estimate, which gives the nodes that may
   have a link there, then those nodes' full shingle sets, inverted once for
   each block. A block gives only links that join components.

A pair within one component needs no test, so no link that could join two
components is left out. With 40 bands of 4 a pair at similarity 0.8 shares no
bucket with probability 7e-10; the estimate's cut lies more than 5 standard
deviations below the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import counted_join, discard, materialize, text_of, utf8_chunks

BITS = 2
_PRINT = "id long, r1 long, r2 long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>"


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    #: Link if 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 40
    rows: int = 4
    #: Pairs with a lower estimate aren't confirmed.
    cut: float = 0.6
    #: Nodes of one bucket in a block.
    block: int = 1024
    #: Members that meet one copy of a centre's text.
    fan: int = 512
    #: Nodes that may share a shingle that counts as rare.
    rare: int = 32
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def words_of(text: str) -> list[bytes]:
    """Runs of other than space and 0x09-0x0D, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct n-word shingles; of fewer words the whole sequence; none without words."""
    if not words:
        return set()
    if len(words) < n:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Sketcher:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.a = rng.integers(1, 1 << 63, s.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, s.hashes, dtype=np.uint64)
        self.join = rng.integers(1, 1 << 63, s.shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.fold = rng.integers(1, 1 << 63, s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(1, 1 << 63, s.bands, dtype=np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A 64-bit hash of each distinct shingle."""
        from xxhash import xxh64_intdigest

        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        if len(words) < self.s.shingle:
            x = (h * self.join[: len(h)]).sum(keepdims=True) if len(h) else h
        else:
            n = len(h) - self.s.shingle + 1
            x = h[:n] * self.join[0]
            for i in range(1, self.s.shingle):
                x = x + h[i : n + i] * self.join[i]
        return _mix(np.unique(x))

    def minima(self, x: np.ndarray) -> np.ndarray:
        low = np.full(self.s.hashes, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 256):
            np.minimum(low, (x[i : i + 256, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def sketch(self, words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of shingles, band keys, packed signature."""
        x = self.hashes(words)
        low = self.minima(x)
        keys = _mix((low.reshape(self.s.bands, self.s.rows) * self.fold).sum(axis=1) + self.band)
        bits = (low >> np.uint64(30)) & np.uint64((1 << BITS) - 1)
        per = 64 // BITS
        sig = (bits.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
        return len(x), keys.view(np.int64), sig.view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def identity(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the word sequence, as two signed longs."""
    from xxhash import xxh128_digest

    a, b = np.frombuffer(xxh128_digest(b" ".join(words)), np.int64)
    return int(a), int(b)


def _sketches(batches, s: Settings):
    maker, width = Sketcher(s), s.hashes * BITS // 64
    for batch in batches:
        for a, b in utf8_chunks(batch.column(3)):
            n, h1, h2, bands, sigs, some = [], [], [], [], [], []
            for text in batch.column(3)[a:b].to_pylist():
                words = words_of(text)
                i, j = identity(words)
                h1.append(i)
                h2.append(j)
                some.append(bool(words))
                if words:
                    count, keys, sig = maker.sketch(words)
                    bands.append(keys)
                    sigs.append(sig)
                else:
                    count = 0
                n.append(count)
            here = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(here * w), pa.array(np.concatenate(v) if v else np.empty(0, np.int64))) for v, w in ((bands, s.bands), (sigs, width))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *lists], names=[x.split(" ")[0] for x in _PRINT.split(", ")])


def estimate(a: str, b: str, s: Settings) -> Column:
    """Similarity from two packed signatures: the share of equal minima, less what chance makes equal."""
    words = s.hashes * BITS // 64
    mask = 0x5555555555555555
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {mask}L)" for i in range(words))
    chance = 1 / (1 << BITS)
    return (1 - F.expr(differ) / s.hashes - chance) / (1 - chance)


def _with_minimum(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) with the minimum m of a's neighbours, and the table of minima. Nodes with a large share of the edges are joined apart."""
    low = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")), "low")
    return counted_join(edges, low, ["a"], "degree"), low


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as (node, component), by alternating large and small stars.

    component: the smallest node. Each step is a shuffle by node with a partial
    minimum; nothing is gathered on the driver but a count and a checksum.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known, low = _with_minimum(both)
        large = known.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "large")
        discard(low, edges)
        # A node already in a star keeps its edge to the minimum; its other neighbours get that minimum.
        known, low = _with_minimum(large)
        small = known.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.filter("a <> b").distinct(), "edges")
        discard(low, large)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _confirm_batches(batches, s: Settings):
    """Rows sorted by centre and salt, the centre's own text first; yields the confirmed pairs."""
    here, centre = None, set()
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, b in utf8_chunks(batch.column(4)):
            for key, salt, kind, node, text in zip(*(c[a:b].to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    here, centre = (key, salt), shingle_set(words_of(text), s.shingle)
                elif here == (key, salt):
                    own = shingle_set(words_of(text), s.shingle)
                    both = len(centre & own)
                    if 100 * both >= s.percent * (len(centre) + len(own) - both):
                        out.append((node, key))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. b is the centre of many a.

    texts: node, text. A centre with many members is salted, and its text goes
    along once for each salt.
    """
    pairs = materialize(pairs, "likely")
    fan = materialize(pairs.groupBy("b").agg(F.count("*").alias("members")), "fan")
    salts = F.ceil(F.col("members") / s.fan).cast("int")
    salted = counted_join(pairs, fan, ["b"], "members").select(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("a").alias("node"))
    own = fan.select(F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("node"))
    rows = salted.unionByName(own).join(texts.hint("merge"), "node").select("centre", "salt", "kind", "node", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind")
    links = materialize(rows.mapInArrow(lambda it: _confirm_batches(it, s), "a long, b long"), "links")
    discard(pairs, fan)
    return links


def _groups(batches, widths: int):
    """Groups of rows with the same first three columns, from sorted batches, as (key, lists of column slices)."""
    key, held = None, []
    for batch in batches:
        first = [batch.column(k).to_numpy() for k in range(3)]
        if not len(first[0]):
            continue
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in first], axis=0)) + 1
        for a, b in zip([0, *edge], [*edge, len(first[0])], strict=True):
            now = tuple(int(c[a]) for c in first)
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append([batch.column(k)[a:b] for k in range(3, 3 + widths)])
    if held:
        yield key, held


def _near_batches(batches, s: Settings):
    """The nodes of each group (key, i, j) that may reach the threshold with a node of another component there.

    Rows with side 0 are compared with those of side 1. A pair shares no more
    than the frequent shingles that both have.
    """
    width, mask = s.hashes * BITS // 64, np.uint64(0x5555555555555555)
    chance = 1 / (1 << BITS)
    for (key, i, j), rows in _groups(batches, 6):
        node, comp, n, often, side = (np.concatenate([r[k].to_numpy() for r in rows]) for k in range(5))
        sig = np.concatenate([r[5].flatten().to_numpy() for r in rows]).view(np.uint64).reshape(-1, width)
        near = np.zeros(len(node), bool)
        others = side == 1
        for x in np.flatnonzero(side == 0):
            ys = np.flatnonzero(others & (comp != comp[x]) & ((100 + s.percent) * np.minimum(often, often[x]) >= s.percent * (n + n[x])) & (100 * np.minimum(n, n[x]) >= s.percent * np.maximum(n, n[x])))
            if len(ys):
                d = sig[ys] ^ sig[x]
                differ = np.bitwise_count((d | (d >> np.uint64(1))) & mask).sum(axis=1)
                ys = ys[(1 - differ / s.hashes - chance) / (1 - chance) >= s.cut]
                near[ys] = True
                near[x] |= len(ys) > 0
        _, at = np.unique(node, return_index=True)  # a node can stand on both sides
        both = np.isin(node[at], node[near])
        at = at[both]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, t)) for v, t in ((key, np.int64), (i, np.int32), (j, np.int32))] + [pa.array(node[at]), pa.array(comp[at])], names=["key", "i", "j", "node", "component"])


def _across_batches(batches, s: Settings):
    """Links between different components of each group (key, i, j), from the full shingle sets of its texts.

    A group's shingles are inverted once; a node's intersections with all
    others are then one count over its lists. Components that a link joins are
    one from there on, so a group of m nodes gives fewer than m links.
    """
    maker = Sketcher(s)
    for _, rows in _groups(batches, 3):
        node, comp = (np.concatenate([r[k].to_numpy() for r in rows]) for k in range(2))
        comp = comp.copy()
        sets = [maker.hashes(words_of(t)) for r in rows for t in r[2].to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), size)
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(term, kind="stable")
        owners, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
        begin = np.concatenate([[0], np.cumsum(size)])
        names, share = np.unique(comp, return_counts=True)
        out = []
        for x in np.flatnonzero(comp != names[share.argmax()]).tolist():
            mine = term[begin[x] : begin[x + 1]]
            length = start[mine + 1] - start[mine]
            take = np.repeat(start[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(owners[take], minlength=len(sets))
            hit = (100 * both >= s.percent * (size + size[x] - both)) & (comp != comp[x])
            while hit.any():
                y = int(hit.argmax())
                out.append((max(node[x], node[y]), min(node[x], node[y])))
                comp[comp == comp[y]] = comp[x]
                hit &= comp != comp[x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in out], pa.int64()), pa.array([int(b) for _, b in out], pa.int64())], names=["a", "b"])


def _token_batches(batches, s: Settings):
    """Rows (node, text, n) as (token, node, n): a hash of each distinct shingle."""
    maker = Sketcher(s)
    for batch in batches:
        for a, b in utf8_chunks(batch.column(1), 1 << 18):
            sets = [maker.hashes(words_of(t)) for t in batch.column(1)[a:b].to_pylist()]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *(pa.array(np.repeat(batch.column(k)[a:b].to_numpy(), sizes)) for k in (0, 2))], names=["token", "node", "n"])


def rare_prefixes(tokens: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """From rows (token, node, n) and counts (token, df) above one: node, n, prefix array<long>, passed, edge, often, complete.

    A node's shingles stand in one global order, the rarest first. The prefix
    are those among its first n - need + 1 that two to ``rare`` nodes have;
    passed: how many of its shingles come up to the prefix's end, unique ones
    included; edge: the place in the order up to which all of them do; often:
    its shingles that more than ``rare`` nodes have. A node whose first n -
    need + 1 shingles are all its own can't have a partner and is left out;
    complete tells that all partners share a shingle of the prefix.
    """
    met = counted_join(tokens, counts, ["token"], "df")
    listed = met.groupBy("node", "n").agg(F.count_if(F.col("df") > s.rare).alias("often"), F.count("*").alias("held"), F.array_sort(F.collect_list(F.when(F.col("df") <= s.rare, F.struct("df", "token")))).alias("some"))
    first = F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1
    own = F.col("n") - F.col("held")
    listed = listed.withColumns({"first": first, "own": own}).filter("own < first")
    listed = listed.withColumn("taken", F.slice("some", F.lit(1), F.greatest(F.lit(0), F.col("first") - F.col("own")).cast("int")))
    complete = F.size("taken") == F.col("first") - F.col("own")
    edge = F.when(complete, F.element_at("taken", -1)).otherwise(F.struct(F.lit(s.rare).cast("long").alias("df"), F.lit((1 << 63) - 1).alias("token")))
    return listed.select("node", "n", F.transform("taken", lambda t: t["token"]).alias("prefix"), (F.col("own") + F.size("taken")).alias("passed"), edge.alias("edge"), "often", complete.alias("complete"))


def rare_pairs(prefixes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle, and whether they may reach the threshold. prefixes: with component."""
    one = prefixes.select(F.explode("prefix").alias("token"), F.struct("node", "component", "n", "passed", "edge").alias("x"))
    two = one.select("token", F.col("x").alias("y"))
    fits = F.expr(f"x.node > y.node AND x.component <> y.component AND 100 * least(x.n, y.n) >= {s.percent} * greatest(x.n, y.n)")
    met = one.join(two.hint("merge"), "token").filter(fits)
    # Shared shingles up to the lower edge are all counted; beyond it there is only what is left of that node.
    left = F.expr("if(x.edge <= y.edge, x.n - x.passed, y.n - y.passed)")
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), left.alias("left"), F.expr("x.n + y.n").alias("n"))
    met = met.groupBy("a", "b", "left", "n").agg(F.count("*").alias("shared"))
    return met.select("a", "b", F.expr(f"{100 + s.percent} * (shared + left) >= {s.percent} * n").alias("likely"))


def _row_key(columns: list[Column]) -> list[Column]:
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(1), *columns).alias("r2")]


def _classes(rows: DataFrame, s: Settings, null_ids: bool) -> tuple[DataFrame, DataFrame]:
    """rows: id, r1, r2, text; r1 and r2 tell rows apart that differ at all.

    Returns a print of each row (without the signatures), and for the word
    sequences of rows that take part: h1, h2, n_rows, component.
    """
    prints = materialize(rows.mapInArrow(lambda it: _sketches(it, s), _PRINT), "prints")
    some = prints.filter("n_shingles > 0" if null_ids else "n_shingles > 0 AND id IS NOT NULL")
    nodes = some.groupBy("h1", "h2").agg(F.min(F.struct("r1", "r2")).alias("place"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n_rows", "n", "bands", "sig", "place.r1", "place.r2"), "nodes")
    links = _links(nodes, prints, rows, s)
    if not null_ids:
        links = links.unionByName(_shared_ids(some, nodes))
    found = components(links)
    labelled = nodes.join(found.hint("merge"), "node", "left").select("h1", "h2", "n_rows", F.coalesce("component", "node").alias("component"))
    return prints.drop("bands", "sig"), materialize(labelled, "classes")


def _shared_ids(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the word sequences of rows that share an id."""
    own = materialize(some.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("n_rows")).filter("lo <> hi").select("id", "n_rows"), "shared_ids")
    if own.isEmpty():
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    used = materialize(counted_join(some.select("id", "h1", "h2"), own, ["id"], "n_rows").select("id", "h1", "h2").distinct(), "used_ids")
    named = materialize(used.join(nodes.select("h1", "h2", "node").hint("merge"), ["h1", "h2"]).select("id", "node"), "named")
    least = materialize(named.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("n")), "least")
    return counted_join(named, least, ["id"], "n").select(F.col("node").alias("a"), "b")


def group_near_duplicates(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, n_shingles, component_id, kept. One row for each row of the table.

    component_id: the smallest id reachable over links, itself included; kept:
    the id is its component's. Defined results: a document without words (or
    with a null text) has 0 shingles, is linked with nothing and kept; texts
    with the same words are linked at any length; rows that share an id are
    one document; a null id is left out of all links (component_id null, kept
    false); an empty table gives no rows. Ids are read as long. Only the two
    named columns are read.
    """
    s = settings or Settings()
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", *_row_key([F.col("id"), F.col("text")]), "text")
    prints, classes = _classes(rows, s, null_ids=False)
    prints = prints.select("id", "n_shingles", "h1", "h2")
    linked = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    each = materialize(counted_join(prints.filter(linked), classes, ["h1", "h2"], "n_rows").select("id", "n_shingles", "component"), "each")
    least = materialize(each.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n_rows")), "least")
    out = counted_join(each, least, ["component"], "n_rows").select("id", "n_shingles", "component_id")
    alone = prints.filter(~linked).select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _star(now: DataFrame, info: DataFrame, texts: DataFrame, mask: int, s: Settings) -> DataFrame:
    """Links of the members of each bucket that holds several components with one centre."""
    centre = now.groupBy("key").agg(F.min(F.expr(f"node ^ {mask}L")).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    centre = materialize(centre.filter("lo < hi").select("key", F.expr(f"m ^ {mask}L").alias("b"), "members"), "centres")
    pairs = materialize(counted_join(now.select("key", "node"), centre, ["key"], "members").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    fan = pairs.groupBy("b").agg(F.count("*").alias("members")).join(info.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")).hint("merge"), "b")
    fan = materialize(fan, "fan")
    close = pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")).hint("merge"), "a")
    close = counted_join(close, fan, ["b"], "members").filter(f"100 * least(n_a, n_b) >= {s.percent} * greatest(n_a, n_b)")
    links = _confirm(close.filter(estimate("sig_a", "sig_b", s) >= s.cut).select("a", "b"), texts, s)
    discard(centre, pairs, fan)
    return links


def _links(nodes: DataFrame, prints: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) of nodes that join all that hang together."""
    entries = nodes.select("node", F.explode("bands").alias("key"))
    keys = materialize(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "keys")
    shared = materialize(counted_join(entries, keys, ["key"], "members").select("key", "node"), "buckets")
    info = materialize(nodes.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "n", "sig", "r1", "r2"), "met")
    if not prints.groupBy("r1", "r2").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["r1", "r2"])
    texts = materialize(rows.select("r1", "r2", "text").join(info.select("r1", "r2", "node").hint("merge"), ["r1", "r2"]).select("node", "text"), "texts")
    links = None
    for mask in (0, 0x2545F4914F6CDD1D):
        now = shared.withColumn("component", F.col("node")) if links is None else now
        found = _star(now, info, texts, mask, s)
        # Of the links so far a star of each component is enough.
        part = materialize(components(found if links is None else links.unionByName(found)), "components")
        links = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
        now = materialize(shared.join(part.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "now")
    open_ = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("key", "members")
    now = materialize(counted_join(now, materialize(open_, "open"), ["key"], "members").select("key", "node", "component"), "now")
    loose = materialize(now.select("node", "component").distinct().join(info.select("node", "n").hint("merge"), "node"), "loose")
    tokens = loose.select("node", "n").join(texts.hint("merge"), "node").select("node", "text", "n")
    tokens = materialize(tokens.mapInArrow(lambda it: _token_batches(it, s), "token long, node long, n long"), "tokens")
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "frequency")
    prefixes = materialize(rare_prefixes(tokens, counts, s).join(loose.select("node", "component").hint("merge"), "node"), "prefixes")
    discard(tokens, counts, keys, shared)
    met = materialize(rare_pairs(prefixes, s), "rare_pairs")
    by_rare = _confirm(met.filter("likely").select("a", "b"), texts, s)
    close = prefixes.filter("NOT complete").select("node", "often").join(info.select("node", "n", "sig").hint("merge"), "node")
    by_size = _across(now, materialize(close, "close"), texts, s)
    discard(prefixes, met, info, texts, loose, now)
    return links.unionByName(by_rare).unionByName(by_size)


def _across(now: DataFrame, close: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links that join components among the close nodes of each bucket. now: key, node, component; close: node, often, n, sig."""
    members = materialize(now.join(close.select("node").hint("merge"), "node", "left_semi"), "close_members")
    shares = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = shares.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("most")).filter("members > most.n")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / s.block)).cast("int")
    buckets = buckets.select("key", "members", F.col("most.component").alias("largest"), blocks(F.col("members")).alias("parts"), blocks(F.col("members") - F.col("most.n")).alias("apart"))
    cells = counted_join(members, materialize(buckets, "blocks"), ["key"], "members")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = cells.filter("component <> largest").select("key", own("apart").alias("i"), F.explode(numbers("parts")).alias("j"), "node", "component", F.lit(0).alias("side"))
    right = cells.select("key", F.explode(numbers("apart")).alias("i"), own("parts").alias("j"), "node", "component", F.lit(1).alias("side"))
    grouped = left.unionByName(right).join(close.hint("merge"), "node").select("key", "i", "j", "node", "component", "n", "often", "side", "sig")
    grouped = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = materialize(grouped.mapInArrow(lambda it: _near_batches(it, s), "key long, i int, j int, node long, component long"), "near")
    full = near.join(texts.hint("merge"), "node").select("key", "i", "j", "node", "component", "text")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialize(full.mapInArrow(lambda it: _across_batches(it, s), "a long, b long").distinct(), "across")
    discard(members, close, near)
    return links


def drop_near_duplicates(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns, and every row without words.

    Rows are judged by their texts, not by their ids: rows that share an id,
    or have none, are apart unless their texts are linked. Of a group the row
    with the smallest id stays (null ids last), then the one with the least
    hash of all its columns; of rows alike in every column one stays. An empty
    table gives no rows; other columns may have any name.
    """
    s = settings or Settings()
    # A map has no hash of its own.
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *_row_key(hashed))
    rows = keyed.select(F.col("row").getField(id_col).cast("long").alias("id"), "r1", "r2", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).alias("text"))
    prints, classes = _classes(rows, s, null_ids=True)
    each = counted_join(prints.filter("n_shingles > 0").select("id", "r1", "r2", "h1", "h2"), classes, ["h1", "h2"], "n_rows")
    first = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")).alias("w")).select("w.r1", "w.r2", F.lit(True).alias("once"))
    bare = prints.filter("n_shingles = 0").select("r1", "r2", F.lit(False).alias("once")).distinct()
    counts = prints.groupBy("r1", "r2").agg(F.count("*").alias("n_rows"))
    kept = materialize(first.unionByName(bare).join(counts.hint("merge"), ["r1", "r2"]), "kept")
    out = lambda rows: rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
    found = counted_join(keyed, kept, ["r1", "r2"], "n_rows")
    if kept.filter("once AND n_rows > 1").isEmpty():
        return out(found)
    many = found.filter("once AND n_rows > 1").dropDuplicates(["r1", "r2"])
    return out(found.filter("NOT (once AND n_rows > 1)")).unionByName(out(many))
