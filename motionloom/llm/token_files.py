"""Operator 8: token ids in files of directly addressable codes.

A shard file holds the ids of consecutive documents. Each id is split into
chunks of ``width`` bits, the lowest first. Level 0 has the first chunk of
every id; a bitmap says which ids go on, and only those have a chunk on level
1, and so on. A rank directory over each bitmap gives the number of set bits
before every 512th bit, so the place of a token's next chunk is one directory
entry plus the bits of one block: any token can be read without decoding the
ones before it.

Layout of a shard, all little-endian:

    8 bytes    magic b"DACTOK01"
    6 uint64   0, tokens, documents, levels, width, 0
    tokens' document starts: (documents + 1) uint64, counted from the shard's first token
    for each level: uint64 count; count bytes of chunks (width 8) or uint16 (width 16);
        bitmap of ceil(count / 64) uint64; directory of ceil(count / 512) + 1 uint64

Numbers of bytes are padded to a multiple of 8. The folder's ``manifest`` table
names the files and each one's first token's place in the corpus. A file's name
holds the attempt that wrote it, so nothing is ever renamed or written twice:
the manifest, which Spark commits, has the files of the attempts that counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder

MAGIC = b"DACTOK01"
BLOCK = 512
_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode_shard(ids: np.ndarray, starts: np.ndarray, width: int = 8) -> bytes:
    """The bytes of a shard. ids: unsigned 32-bit; starts: a document's first token, and the end."""
    kind = {8: np.uint8, 16: np.uint16}[width]
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, rest = (rest & np.uint32((1 << width) - 1)).astype(kind), rest >> np.uint32(width)
        more = rest != 0
        bits = np.packbits(more, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % 8), np.uint64)
        ones = np.bitwise_count(words).astype(np.uint64)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 64)) if len(ones) else ones
        rank = np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint64)
        levels.append(np.uint64(len(chunk)).tobytes() + _padded(chunk.tobytes()) + words.tobytes() + rank.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    head = np.array([0, len(ids), len(starts) - 1, len(levels), width, 0], np.uint64)
    return b"".join([MAGIC, head.tobytes(), np.asarray(starts, np.uint64).tobytes(), *levels])


class Shard:
    """Reads a shard's bytes (or a memory map of them)."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        head = np.frombuffer(data, np.uint64, 6, 8)
        self.n_tokens, self.n_docs, n_levels, self.width = (int(x) for x in head[1:5])
        self.starts = np.frombuffer(data, np.uint64, self.n_docs + 1, 56).astype(np.int64)
        at, size = 56 + 8 * (self.n_docs + 1), self.width // 8
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, np.uint64, 1, at)[0])
            chunks = np.frombuffer(data, {1: np.uint8, 2: np.uint16}[size], n, at + 8)
            at += 8 + (n * size + 7) // 8 * 8
            words = np.frombuffer(data, np.uint64, (n + 63) // 64, at)
            at += 8 * len(words)
            rank = np.frombuffer(data, np.uint64, (n + BLOCK - 1) // BLOCK + 1, at)
            at += 8 * len(rank)
            self.levels.append((chunks, words, rank))

    def token(self, i: int) -> int:
        """One id, by its number in the shard; touches one place on each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, words, rank in self.levels:
            value |= int(chunks[i]) << shift
            word = int(words[i >> 6])
            if not word >> (i & 63) & 1:
                break
            first = i // BLOCK * (BLOCK // 64)
            before = int(rank[i // BLOCK]) + sum(int(w).bit_count() for w in words[first : i >> 6])
            i = before + (word & ((1 << (i & 63)) - 1)).bit_count()
            shift += self.width
        return value

    def tokens(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The ids from a to b (all by default), by rank on each level."""
        b = self.n_tokens if b is None else b
        out = np.zeros(b - a, np.uint32)
        where, shift = None, 0
        for chunks, words, rank in self.levels:
            if b <= a:
                break
            part = chunks[a:b].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= part
                where = np.arange(len(out))
            else:
                out[where] |= part
            first = a >> 6
            bits = np.unpackbits(words[first : (b + 63) >> 6].view(np.uint8), bitorder="little")[a - 64 * first : b - 64 * first].astype(bool)
            block = a // BLOCK
            ahead = words[block * (BLOCK // 64) : first]
            before = int(rank[block]) + int(np.bitwise_count(ahead).sum())
            if a & 63:
                before += (int(words[first]) & ((1 << (a & 63)) - 1)).bit_count()
            where, shift = where[bits], shift + self.width
            a, b = before, before + len(where)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


#: Names that Spark and pyarrow have for one kind of store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def _open(path: str):
    """The store and the path in it. Python tasks write the files, so the store has to be one that pyarrow knows."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if mark and scheme == "dbfs":
        return fs.LocalFileSystem(), f"/dbfs/{rest.lstrip('/')}"
    if path.startswith("dbfs:/"):
        return fs.LocalFileSystem(), f"/dbfs/{path[6:].lstrip('/')}"
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else path)


def _write_partition(batches, folder: str, width: int, shard_tokens: int):
    """Write this partition's rows, in their order, as shards of about so many tokens."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    keys, parts, lengths, held, seq = [], [], [], 0, 0

    def shard():
        nonlocal keys, parts, lengths, held, seq
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        data = encode_shard(np.concatenate(parts), starts, width)
        table = pa.table({"doc_id": pa.concat_arrays(keys)})
        name = f"{part:06d}-{seq:06d}-{attempt}"
        for end, write in ((".dac", lambda f: f.write(data)), (".ids", lambda f: pa.ipc.new_stream(f, table.schema).write_table(table))):
            with store.open_output_stream(f"{root}/{name}{end}") as f:
                write(f)
        row = (part, seq, f"{folder}/{name}", len(starts) - 1, int(starts[-1]))
        keys, parts, lengths, held, seq = [], [], [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    for batch in batches:
        column = batch.column(1)
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy()
        a = 0
        while a < len(column):
            b = min(len(column), max(a + 1, int(np.searchsorted(offsets, offsets[a] + shard_tokens - held, side="right")) - 1))
            keys.append(batch.column(0)[a:b])
            parts.append(values[offsets[a] : offsets[b]].astype(np.uint32))
            lengths.append(np.diff(offsets[a : b + 1]))
            held += int(offsets[b] - offsets[a])
            a = b
            if held >= shard_tokens:
                yield shard()
    if keys:
        yield shard()


def write_tokens(df: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", width: int = 8, shard_tokens: int = 4_000_000) -> None:
    """Write the ids of all documents in ascending order of the id column to a new folder, with its manifest.

    ``encode`` maps (id, text) rows to (id, ids array<int>) batch by batch. The
    rows are dealt out by range of (id, text hash), so that a repeated id
    can't fill one task; each task sorts its range, encodes it and writes its
    shards. Manifest columns: part, seq, path, n_docs, n_tokens, start (tokens
    of all shards before); one row for each shard. Null ids come first. Rows
    alike in id and text may stand in any order. An empty table gives an empty
    manifest.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    encode(rows).mapInArrow(lambda it: _write_partition(it, folder, width, shard_tokens), _MANIFEST).write.parquet(f"{folder}/written")
    written = df.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/written")
    # Within a part, and over the parts, of which there are as many as tasks that wrote.
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(before(F.lit(0)).orderBy("part")), F.lit(0)))
    starts = written.withColumn("own", F.coalesce(F.sum("n_tokens").over(before("part").orderBy("seq")), F.lit(0))).join(parts.select("part", "ahead"), "part")
    starts.select(*written.columns, (F.col("ahead") + F.col("own")).alias("start")).write.parquet(f"{folder}/manifest")


def _read_shards(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, root = _open(path)
            with store.open_input_file(f"{root}.dac") as f:
                shard = Shard(f.read())
            with store.open_input_stream(f"{root}.ids") as f:
                keys = pa.ipc.open_stream(f).read_all().column(0).combine_chunks()
            for a in range(0, shard.n_docs, 2000):
                b = min(a + 2000, shard.n_docs)
                ids = shard.tokens(int(shard.starts[a]), int(shard.starts[b]))
                cut = (shard.starts[a : b + 1] - shard.starts[a]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(shard.starts[a:b] + start), pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int64)))], names=["doc_id", "start", "ids"])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard of a folder; ``start`` finds the shard of any token of the corpus."""
    return spark.read.schema(f"{_MANIFEST}, start long").parquet(f"{folder}/manifest")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards' paths and starts, dealt to as many tasks as there are shards, or 10 000."""
    shards = read_manifest(spark, folder).select("path", "start")
    return shards.repartition(max(1, min(10_000, shards.count())), "path")


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Columns doc_id, start (tokens of all documents before), ids array<long>, read from a folder's files."""
    return _shards(spark, folder).mapInArrow(_read_shards, f"doc_id {id_type}, start long, ids array<long>")


def token_at(spark: SparkSession, folder: str, place: int) -> int:
    """One id by its place in the corpus: one manifest row, then one place on each level of its shard."""
    found = read_manifest(spark, folder).filter((F.col("start") <= place) & (F.col("start") + F.col("n_tokens") > place)).select("path", "start").first()
    if found is None:
        raise IndexError(place)
    store, root = _open(found["path"])
    with store.open_input_file(f"{root}.dac") as f:
        return Shard(f.read()).token(place - found["start"])


def _crc(batches):
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        values = batch.column(2).values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of what read_tokens reads; the ids themselves stay in the reading task."""
    return _shards(spark, folder).mapInArrow(lambda it: _crc(_read_shards(it)), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, encode: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, read=read_tokens, **options) -> DataFrame:
    """Write all documents to a new shared folder and read them back from the files, as read_tokens or read_digests does."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    write_tokens(df, folder, encode, id_col, text_col, **options)
    return read(spark, folder, df.schema[id_col].dataType.simpleString())
