import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motionloom.llm import bpe, library_encode, shared, token_files, wordvocab

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello World! it's 2024", "", "   ", None, "<|endoftext|>mid<|startoftext|> <|ENDOFTEXT|>", "ñandú ΣΑΣ Σας İstanbul ȺȾ", "a\x1cb\x1fc \x85 \xa0 d",
    "e\u0301 漢字😀 ﬁ ²½ ªʰ", "'s't're </w> a</w>b w></", "ab" * 3000, "same text", "same text", "x" * 200,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(n):
    rng = random.Random(4)
    for _ in range(n):
        yield "".join(rng.choice("aabcdeehtinosr'  \n\t.,!?<|>/w012é ñßÄİΣσς\u0301\x85\x1c漢😀") for _ in range(rng.randint(0, 50)))
        yield "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(15))


@pytest.mark.parametrize("table", [bpe._table, library_encode._table])
def test_ids_equal_the_librarys(library, table):
    texts = [t or "" for t in TEXTS] + list(noise(1500))
    ids, ends = table(PATH).encode(texts)
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert ids[ends[i] : ends[i + 1]].tolist() == want.ids, repr(text)


def test_small_table_lets_words_go(library):
    vocab = wordvocab.load(PATH)
    small = wordvocab.WordTable(vocab, bpe.TrieEncoder(vocab), most=20)
    letters = "abcdefghijklmno"
    for i in range(12):
        text = " ".join(f"q{letters[i]}{x}, always <|endoftext|> w{i}x" for x in letters)
        ids, _ = small.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.index) < 60
        assert {"always", " <|endoftext|>", " <|startoftext|>"} <= set(small.index)


def test_encode_and_decode(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "id": F.lit(None)})
    rows = {r["doc_id"]: r for r in bpe.encode_decode(df, PATH).collect()}
    two = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for i, text in enumerate(TEXTS):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want
        assert rows[i]["decoded"] == two[i] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("width", [8, 16])
def test_shard_random_access(width):
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), rng.integers(0, 200, 3000), [2**32 - 1, 2**31, 0]]).astype(np.uint32)
    starts = np.array([0, 0, 10, 5000, len(ids)])
    shard = token_files.Shard(token_files.encode_shard(ids, starts, width))
    assert (shard.tokens() == ids).all()
    assert [shard.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    assert shard.token(len(ids) - 3) == 2**32 - 1
    for a, b in ((0, 0), (5, 6), (511, 513), (63, 5999), (4096, 4097)):
        assert (shard.tokens(a, b) == ids[a:b]).all()
    assert [len(shard.document(i)) for i in range(4)] == [0, 10, 4990, len(ids) - 5000]
    empty = token_files.Shard(token_files.encode_shard(np.empty(0, np.uint32), np.zeros(1), width))
    assert empty.n_tokens == 0 and len(empty.tokens()) == 0
    with pytest.raises(ValueError):
        token_files.Shard(b"x" * 64)
    with pytest.raises(IndexError):
        shard.token(len(ids))


@pytest.mark.parametrize("size", [4_000_000, 40])
def test_token_files_round_trip(spark, library, size):
    rows = list(enumerate(TEXTS)) + [(3, "same id, other text"), (-5, "first"), (7, TEXTS[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = token_files.write_and_read(df, library_encode.with_end(PATH, 1), read=token_files.read_digests, shard_tokens=size).collect()
    whole = token_files.write_and_read(df, library_encode.with_end(PATH, 1), shard_tokens=size).collect()
    assert sorted((r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in whole) == sorted((r["start"], r["ids_crc32"]) for r in got)
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    want = sorted((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]])
    assert sorted((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    folder = shared.new_folder(spark, "places")
    token_files.write_tokens(df, folder, library_encode.with_end(PATH, 1), shard_tokens=size)
    order = [i for r in sorted(whole, key=lambda r: r["start"]) for i in r["ids"]]
    assert [token_files.token_at(spark, folder, k) for k in (0, len(order) // 2, len(order) - 1)] == [order[0], order[len(order) // 2], order[-1]]
    with pytest.raises(IndexError):
        token_files.token_at(spark, folder, len(order))
    assert token_files.write_and_read(df.limit(0), library_encode.with_end(PATH, 1)).count() == 0


def test_query_digests(spark, library, tmp_path):
    from motionloom.llm import queries

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op1_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
