"""Helpers that several corpus operators use: the shared work folder and column handling."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open ``scratch``: what has been written within it.
_open_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from ``spark.checkpoint.dir``. Only a local session without
    that setting (tests) gets a temporary folder; a cluster session without
    it is an error, since executors could not see a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="motionloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/motionloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage in a way that survives lost executors. The shuffle
    files of the writing query are dropped as soon as it has ended.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for made in _open_scratch:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, when whatever was made of them has been written.

    Only tables that are no part of a returned DataFrame may go. A lost
    executor doesn't bring them back into use: what is left reads later tables.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch():
    """Deletes the tables that operators wrote within it. Save their results before it ends."""
    made: list[DataFrame] = []
    _open_scratch.append(made)
    try:
        yield
    finally:
        _open_scratch.remove(made)
        discard(*made)


def clean(spark: SparkSession) -> None:
    """Delete everything that this application's operators have written to the shared folder.

    DataFrames that the operators returned can't be read afterwards, so call it
    when their results are saved.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def counted_join(big: DataFrame, side: DataFrame, keys: list[str], count: str, share: int = 1 << 13, least: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``side``, where column ``count`` of side says how many rows of big have the key at most.

    Side rows that stand for more than one in ``share`` of the counted rows,
    and for more than ``least``, are sent to every task, so that a frequent key
    isn't dealt to one: there are fewer than ``share`` of them at any size. The
    others are merge-joined. Both tables are read twice; pass written ones.
    Without frequent keys it is a merge join.
    """
    total, most = side.agg(F.coalesce(F.sum(F.col(count).cast("double")), F.lit(0.0)), F.coalesce(F.max(count), F.lit(0))).first()
    if most * share <= total or most <= least:
        return big.join(side.hint("merge"), keys)
    often = (F.col(count) * share > total) & (F.col(count) > least)
    heavy = side.filter(often)
    rest = big.join(F.broadcast(heavy.select(*keys).distinct()), keys, "left_anti")
    return big.join(F.broadcast(heavy), keys).unionByName(rest.join(side.filter(~often).hint("merge"), keys))


def text_of(column: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_chunks(column, limit: int = 1 << 20):
    """Split an Arrow string array into runs of rows that hold about ``limit`` bytes.

    Yields (first row, end row). A row larger than the limit is a run of its own.
    """
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
