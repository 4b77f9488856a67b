"""The track record: Parquet with the run's figures in the file footer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.schema import CLIPS, TRACK_RECORD

KEYS = {"fps": float, "width": int, "height": int, "total_frames": int, "meters_per_pixel": float}
_FRAME_KEY = "clip"


def _footer(path: str) -> dict[str, str]:
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.Directory:
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        if not files:
            raise ValueError(f"{path} has no Parquet files")
        root = files[0]
    try:
        return {k.decode(): v.decode() for k, v in (pq.read_schema(root, filesystem=store).metadata or {}).items()}
    except OSError as e:
        raise ValueError(f"{path} can't be read as a track record: {e}") from e


def _figures(spark: SparkSession, path: str) -> dict:
    kept = spark.read.parquet(path).schema["frame"].metadata.get(_FRAME_KEY)
    raw = kept or _footer(path)
    if "fps" not in raw:
        raise ValueError(f"{path} lacks the run's figures")
    try:
        return {k: kind(raw[k]) for k, kind in KEYS.items()}
    except (KeyError, ValueError) as e:
        raise ValueError(f"{path} has malformed figures: {e}") from e


def read_tracks(spark: SparkSession, path: str, clip_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Observations and the one-row clip table of a record. row_id follows the order of rows in the file."""
    meta = _figures(spark, path)
    clips = spark.createDataFrame([(clip_id, meta["width"], meta["height"], meta["fps"], meta["total_frames"], meta["meters_per_pixel"])], CLIPS)
    rows = spark.read.schema(TRACK_RECORD).parquet(path)
    position = F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("n"))
    rows = rows.select("*", position.alias("_at")).withColumns({"clip_id": F.lit(clip_id).cast("long"), "row_id": F.col("_at.n")}).drop("_at")
    return rows.select("clip_id", "row_id", *TRACK_RECORD.names), clips


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Only the score column is read."""
    return spark.read.schema(TRACK_RECORD).parquet(path).select("score")


def write_tracks(obs: DataFrame, path: str, fps: float, width: int, height: int, total_frames: int, meters_per_pixel: float, mode: str = "errorifexists") -> None:
    """Write a record as a folder of Parquet files; the figures go with the frame column and come back with read_tracks."""
    if not (fps > 0 and width > 0 and height > 0 and math.isfinite(fps) and meters_per_pixel > 0):
        raise ValueError("fps, width, height and scale must be positive")
    meta = {k: str(v) for k, v in zip(KEYS, (fps, width, height, total_frames, meters_per_pixel), strict=True)}
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACK_RECORD]
    obs.select(*cols).withMetadata("frame", {_FRAME_KEY: meta}).write.mode(mode).parquet(path)


def write_single_record(obs: DataFrame, path: str, figures: dict, row_group: int = 10_000) -> None:
    """One local Parquet file with the figures in its footer, rows in frame order, streamed partition by partition."""
    import pyarrow as pa
    from pyarrow import parquet as pq

    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in TRACK_RECORD], metadata={k: str(figures[k]) for k in KEYS})
    with pq.ParquetWriter(path, schema) as out:
        held: list[dict] = []
        for row in obs.orderBy("frame", "row_id").select(*TRACK_RECORD.names).toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict())
            if len(held) >= row_group:
                out.write_table(pa.Table.from_pylist(held, schema))
                held = []
        if held:
            out.write_table(pa.Table.from_pylist(held, schema))


def first_rows(obs: DataFrame) -> DataFrame:
    """Adds track_row, the first row_id of the track, which orders vehicles within a timestep."""
    return obs.withColumn("track_row", F.min("row_id").over(Window.partitionBy("clip_id", "track_id")))
