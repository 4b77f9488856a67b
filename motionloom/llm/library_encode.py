"""Encoding of whole texts with the tokenizers library, each distinct word once."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordvocab
from .bpe import encode_batches


def _encode_words(vocab: wordvocab.WordVocab, words: list[str]) -> list[list[int]]:
    """Each word's ids, from the library's model; the words are already normalised and cut."""
    tokenize, symbols = vocab.library.model.tokenize, vocab.symbols
    return [[t.id for t in tokenize(w if w.isascii() and w.isalnum() else symbols(w))] for w in words]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> wordvocab.WordTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    vocab = wordvocab.load(path)
    return wordvocab.WordTable(vocab, lambda words: _encode_words(vocab, words), most=400_000)


def with_end(path: str, end: int | None):
    """A function from (doc_id, text) rows to (doc_id, ids) rows, with ``end`` after each document's ids."""

    def batches(it):
        for batch in encode_batches(it, path, _table):
            column = batch.column(1)
            if end is not None:
                offsets = column.offsets.to_numpy()
                values = np.insert(column.values.to_numpy(), offsets[1:], end)
                column = pa.ListArray.from_arrays(pa.array(offsets + np.arange(len(offsets), dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])

    def encode(df: DataFrame) -> DataFrame:
        return df.mapInArrow(batches, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")

    return encode
