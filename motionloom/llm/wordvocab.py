"""A word-level BPE vocabulary file and the cutting of texts into its words.

The file is a ``tokenizers`` JSON file whose model is BPE with an end-of-word
suffix over byte symbols. Its path is a parameter; nothing of it is stored here.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _class(kinds: str, below: int = 0x300) -> str:
    found = [c for c in range(below) if unicodedata.category(chr(c))[0] in kinds]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_LETTERS, _DIGITS = _class("L"), _class("N")
_SPACES = r"\t-\r \x85\xa0"
#: The vocabulary's split pattern for characters below U+0300, for Python's ``re``.
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
#: White space for str.split() but not for the pattern.
_CONTROL = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(f"[^{_SPACES}]+")
#: Characters that composition or per-character lower case may treat specially.
_SPECIAL = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x300) if max(chr(c).lower()) >= "\u0300") + "\u0300-\U0010ffff]")
#: Texts that Arrow's lower case and split can't stand in for, as a pattern for Arrow.
_ODD = "|".join(p.pattern for p in (_CONTROL, _SPECIAL))


class WordVocab:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} isn't a BPE file with the end-of-word suffix </w>")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._marks = {s[:2] for s in self.special}
        self._odd = "|".join([_ODD, *map(re.escape, sorted(self._marks))])
        self.tokens = np.array([self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))], dtype=object)
        self._bytes = {i: s for i, s in enumerate(byte_symbols())}

    def symbols(self, word: str) -> str:
        """The word as one character for each byte of its UTF-8 form."""
        if word.isascii() and word.isalnum():
            return word  # these bytes stand for themselves
        return word.encode("utf-8").decode("latin-1").translate(self._bytes)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and _SPECIAL.search(text):
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = text.lower()
        return _CHUNK.findall(text) if _CONTROL.search(text) else text.split()

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space, or further.

        A special token's string in the text gives a chunk of its own, with a
        space before it, which no other chunk has.
        """
        if self._cut is None or not any(m in text for m in self._marks):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self._cut.split(text)):
            if i % 2:
                out.append(" " + part)
            elif part:
                out += self._plain(part)
        return out

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different chunks of all texts, the number of the chunk at each place, and each text's first place and the end.

        Texts with none but common characters are lower-cased and cut as one
        Arrow array; it may give empty chunks, which have no words.
        """
        odd = pc.match_substring_regex(texts, self._odd)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts) if len(rows) else texts))
        if len(rows):
            apart = pa.array([self.chunks(texts[i].as_py()) for i in rows.tolist()], lists.type)
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            lists = pa.concat_arrays([lists, apart]).take(pa.array(order))
        kinds = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy().astype(np.int64)
        return kinds.dictionary.to_pylist(), kinds.indices.to_numpy(), ends - ends[0]

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk; a word's own words are itself."""
        if chunk.isalpha() and (chunk.isascii() or not _SPECIAL.search(chunk)):
            return [chunk]  # a run of letters
        if not chunk.isascii() and _SPECIAL.search(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return _FAST.findall(chunk)


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after another, and the offsets at ``ends``."""
    length = length[at]
    done = np.zeros(len(at) + 1, np.int64)
    np.cumsum(length, out=done[1:])
    shift = start[at]
    shift -= done[:-1].astype(np.int32)
    take = np.repeat(shift, length)
    take += np.arange(done[-1], dtype=np.int32)
    return flat[take], done[ends]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordVocab:
    return WordVocab(path)


class WordTable:
    """Ids of the words met so far, and the encoding of texts through it.

    ``encode_new(words)`` gives the ids of words that aren't in the table. With
    more than ``most`` words in it, the table keeps the half that most batches
    had before it takes in the next batch, so its memory is bounded; a word
    that was let go is encoded again when it comes back.
    """

    def __init__(self, vocab: WordVocab, encode_new, most: int = 400_000):
        self.vocab, self.encode_new, self.most = vocab, encode_new, most
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int32)
        self.length = np.empty(0, np.int32)
        self.hits = np.empty(0, np.int32)
        self._add([" " + s for s in vocab.special], np.array([*vocab.special.values()], np.int32), np.ones(len(vocab.special), np.int64))

    def _add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(length) - length).astype(np.int32)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int32)])

    def _learn(self, words: list[str]) -> None:
        on = gc.isenabled()
        gc.disable()  # a trie of many small nodes has no cycles to look for
        try:
            ids = self.encode_new(words)
        finally:
            if on:
                gc.enable()
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(words, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(length.sum())), length)

    def _trim(self) -> None:
        """Keep the special tokens and the half of the table with most hits, newer words first; hits count half from then on."""
        fixed = len(self.vocab.special)
        kept = np.sort(np.argsort(self.hits[fixed:], kind="stable")[-(self.most // 2) :]) + fixed
        kept = np.concatenate([np.arange(fixed), kept])
        words = list(self.index)
        ids, ends = _gather(self.flat, self.start, self.length, kept, np.arange(len(kept) + 1))
        self.index = dict(zip(map(words.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.flat, self.start, self.length, self.hits = ids, ends[:-1].astype(np.int32), self.length[kept], self.hits[kept] >> 1

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of each text in it."""
        if len(self.index) > self.most + len(self.vocab.special):
            self._trim()
        kinds, place, ends = self.vocab.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        at = np.fromiter(map(self.index.get, kinds, itertools.repeat(-1)), np.int32, len(kinds))
        new = at < 0
        if not new.any():
            self.hits[at] += 1
            return _gather(self.flat, self.start, self.length, at[place], ends)
        # Chunks that aren't words of the table: they are cut, and only their words are kept.
        cut = self.vocab.words
        parts = [[c] if c.isascii() and c.isalpha() else cut(c) for c in map(kinds.__getitem__, np.flatnonzero(new).tolist())]
        flat = [*itertools.chain.from_iterable(parts)]
        self._learn(sorted(set(flat).difference(self.index)))
        count = np.ones(len(kinds), np.int64)
        count[new] = np.fromiter(map(len, parts), np.int64, len(parts))
        own = np.repeat(new, count)
        entries = np.empty(len(own), np.int32)
        entries[~own] = at[~new]
        entries[own] = np.fromiter(map(self.index.__getitem__, flat), np.int32, len(flat))
        self.hits[entries] += 1
        ids, offsets = _gather(self.flat, self.start, self.length, entries, np.concatenate([[0], np.cumsum(count)]))
        return _gather(ids, offsets[:-1].astype(np.int32), np.diff(offsets).astype(np.int32), place, ends)
