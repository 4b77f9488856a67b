"""From raw documents to token ids: each stage works on what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.llm import bpe, decontaminate, langid, minhash, suffix_dedup
from motionloom.llm.queries import WORD_BPE, table
from motionloom.llm.shared import new_folder, scratch

#: Documents whose best language has a lower calibrated score are rejected, and those without letters.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. The model learns from this stage's own documents."""
    return langid.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over five-word shingles, that with the smallest id.

    Documents are judged by their texts: one without an id, or with the id of
    an unlike text, stays. Documents without words all stay; an empty table
    gives no rows.
    """
    return minhash.drop_near_duplicates(docs, minhash.Settings(shingle=5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that 200-byte repeats cover; n_chars follows the text.

    Documents that share an id or have none are texts of their own. A null text
    stays null; an empty table gives no rows.
    """
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. A null text is clean; ids aren't looked at; an empty table gives no rows."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded: the BPE ids of each document's text, and the text they stand for."""
    return bpe.encode_decode(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding", encoding),
]

#: The language stage trains a classifier, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again. What a stage needs in between is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{k + 1}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
