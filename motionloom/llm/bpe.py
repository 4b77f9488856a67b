"""Operator 1: BPE encoding by prefix-sharing trie traversal, and decoding.

Words that were not met before go into a trie of their byte symbols. A
depth-first walk carries, for each prefix, the last token of the prefix's
encoding. That state follows from the states of shorter prefixes: the last
token of a prefix is the one vocabulary entry that ends there and may follow
the last token of what remains before it. So the encoding of a shared prefix
is found once, and a word's ids are read off by stepping back through the
states on its path. Two tokens may stand side by side if no merge across
their border comes before the merges that made them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordvocab
from .shared import text_of, utf8_chunks

_END = "</w>"


class TrieEncoder:
    """Encodes distinct words of one vocabulary."""

    def __init__(self, vocab: wordvocab.WordVocab):
        ids = vocab.ids
        order = {t: i for i, t in enumerate(sorted({ids[a] for a in ids} - {ids[a + b] for a, b in vocab.merges}))}
        base = len(order)
        self.join: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = dict(order)
        for rank, (a, b) in enumerate(vocab.merges):
            new = ids[a + b]
            if new in self.halves or new in order:
                raise ValueError("two merges give the same token; the walk needs one merge for each token")
            self.halves[new], self.made[new] = (ids[a], ids[b]), base + rank
            self.join[ids[a], ids[b]] = base + rank
        self.never = base + len(vocab.merges)
        reachable = {t for t in order}
        for new, (a, b) in self.halves.items():  # in the order of the merges
            if a in reachable and b in reachable and self._beside(a, b, self.made[new]):
                reachable.add(new)
        self.inner = {s: t for s, t in ids.items() if t in reachable and not s.endswith(_END)}
        self.final = {s[: -len(_END)]: t for s, t in ids.items() if t in reachable and s.endswith(_END) and s != _END}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.symbols = vocab.symbols
        self.pairs: dict[int, bool] = {}

    def _beside(self, a: int, b: int, before: int) -> bool:
        """Whether a and b stay apart, looking at merges made earlier than ``before``.

        It undoes the later of the two border tokens step by step; at each step
        the two tokens on the border existed together until the undone merge.
        """
        made, halves, join = self.made, self.halves, self.join
        while True:
            if join.get((a, b), self.never) < before:
                return False
            if made[a] > made[b]:
                later_left = True
            elif b in halves:
                later_left = False
            elif a in halves:
                later_left = True
            else:
                return True
            if later_left:
                if a not in halves:
                    return True
                before, a = made[a], halves[a][1]
            else:
                before, b = made[b] + 1, halves[b][0]  # of equal merges the left one comes first

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._beside(a, b, self.never)
        return known

    def _last(self, prefix: str, tokens: dict[str, int], state: list[int], begin: list[int]) -> tuple[int, int]:
        """The last token of the prefix's encoding and where it starts.

        Exactly one start fits, so the order of trial is free: first the starts
        of the tokens in the encoding of the prefix before, then all others.
        """
        n = len(prefix)
        pairs = self.pairs
        start = n - 1
        while True:
            token = tokens.get(prefix[start:])
            if token is not None:
                if not start:
                    return token, 0
                key = state[start] << 32 | token
                if pairs[key] if key in pairs else self.fits(state[start], token):
                    return token, start
            if not start:
                break
            start = begin[start]
        for start in range(max(0, n - self.longest), n):
            token = tokens.get(prefix[start:])
            if token is not None and (not start or self.fits(state[start], token)):
                return token, start
        raise ValueError(f"the vocabulary has no symbol for {prefix[-1:]!r}")

    def __call__(self, words: list[str]) -> list[list[int]]:
        """The ids of each of the distinct words."""
        root: dict = {}
        for at, word in enumerate(words):
            node, s = root, self.symbols(word)
            for symbol in s[:-1]:
                node = node.setdefault(symbol, {})
            node[s[-1] + _END] = at
        out: list[list[int]] = [[]] * len(words)
        #: By prefix length on the current path: last token, and its start.
        state, begin = [0] * 2, [0] * 2
        stack: list[tuple[dict, str]] = [(root, "")]
        while stack:
            node, prefix = stack.pop()
            n = len(prefix)
            if n:
                while len(state) <= n:
                    state.append(0)
                    begin.append(0)
                state[n], begin[n] = self._last(prefix, self.inner, state, begin)
            for symbol, child in node.items():
                if len(symbol) == 1:
                    stack.append((child, prefix + symbol))
                    continue
                token, at = self._last(prefix + symbol[0], self.final, state, begin)
                ids = [token]
                while at:
                    ids.append(state[at])
                    at = begin[at]
                ids.reverse()
                out[child] = ids
        return out


@functools.lru_cache(maxsize=2)
def _table(path: str) -> wordvocab.WordTable:
    vocab = wordvocab.load(path)
    return wordvocab.WordTable(vocab, TrieEncoder(vocab))


def encode_batches(batches, path: str, table=_table):
    """Arrow batches of (id, text) to batches of (id, ids)."""
    words = table(path)
    pool = pa.default_memory_pool()
    for batch in batches:
        pool.release_unused()  # what earlier batches took, also those of other tasks in this worker
        for a, b in utf8_chunks(batch.column(1), 2 << 20):
            ids, offsets = words.encode(batch.column(1)[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["id", "ids"])


def _decode_batches(batches, path: str):
    tokens = wordvocab.load(path).tokens
    for batch in batches:
        column = batch.column(1)
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        for a in range(0, len(column), 256):
            b = min(a + 256, len(column))
            texts = [" ".join(tokens[values[offsets[i] : offsets[i + 1]]].tolist()) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(texts, pa.string())], names=["id", "decoded"])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, ``ids`` array<int>.

    The ids are those of the tokenizers library for this file without added
    start and end tokens; the string of a special token in a text becomes that
    token. Defined results: a null or empty text, or one of white space only,
    gives an empty array; repeated rows give repeated results; an empty table
    gives no rows; a null id stays null. Only the two named columns are read,
    so further columns, whatever their names, change nothing.
    No shuffle: each batch is encoded where it is read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: encode_batches(it, path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: the id column, ``decoded``: the tokens joined as the library does without a decoder.

    Null or empty arrays give an empty text. Ids must be of the vocabulary.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda it: _decode_batches(it, path), f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, ``ids``, ``decoded``; both ways in one pass over the rows."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def both(batches):
        for batch in encode_batches(batches, path):
            if batch.num_rows:
                texts = [x.column(1) for x in _decode_batches([batch], path)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(texts)], names=["id", "ids", "decoded"])

    return rows.mapInArrow(both, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
