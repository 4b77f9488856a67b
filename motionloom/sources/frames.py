"""Video frames as a Spark data source; the decoder is supplied by the caller."""

from __future__ import annotations

import importlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motionloom.operators.cadence import accepted
from motionloom.operators.filters import window_bounds

SCHEMA = "path string, frame long, ts double, width int, height int, pixels binary"


def load_class(name: str):
    """A class by "module:Class"."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class CvVideo:
    """A decoder on OpenCV, if that is installed; frames are blue-green-red."""

    def __init__(self, path: str):
        import cv2

        self.cv2, self.capture = cv2, cv2.VideoCapture(path)
        if not self.capture.isOpened():
            raise ValueError(f"{path} can't be opened as a video")
        self.fps = self.capture.get(cv2.CAP_PROP_FPS)
        self.width, self.height, self.total_frames = (int(self.capture.get(k)) for k in (cv2.CAP_PROP_FRAME_WIDTH, cv2.CAP_PROP_FRAME_HEIGHT, cv2.CAP_PROP_FRAME_COUNT))
        self.next = 0

    def read(self, frame: int) -> bytes | None:
        if frame != self.next:
            self.capture.set(self.cv2.CAP_PROP_POS_FRAMES, frame)
        good, pixels = self.capture.read()
        self.next = frame + 1
        return pixels.tobytes() if good else None


class ArrayVideo:
    """A decoder of .npz files with ``frames`` (uint8, [n, height, width, depth]) and ``fps``; for tests and small clips."""

    def __init__(self, path: str):
        held = np.load(path)
        self.frames, self.fps = held["frames"], float(held["fps"])
        self.total_frames, self.height, self.width = self.frames.shape[:3]

    def read(self, frame: int) -> bytes | None:
        return self.frames[frame].tobytes() if frame < len(self.frames) else None


class NoDetector:
    """Stands where no detector is given: it says so."""

    def __init__(self, **settings):
        raise ValueError("a detector class has to be given as module:Class")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FrameReader(DataSourceReader):
    """Splits the window into frame ranges; frames off the cadence grid are never decoded."""

    def __init__(self, options: dict):
        self.o = options
        self.path = options["path"]

    def _open(self):
        return load_class(self.o["decoder"])(self.path)

    def partitions(self):
        video = self._open()
        seconds = lambda k: float(self.o[k]) if self.o.get(k) else None
        first, last = window_bounds(video.fps, video.total_frames, seconds("startseconds"), seconds("endseconds"))
        last = video.total_frames - 1 if last is None else last
        size = int(self.o.get("framesperpartition", 1000))
        return [_Range(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]

    def read(self, partition):
        video = self._open()
        seconds = lambda k: float(self.o[k]) if self.o.get(k) else None
        first, last = window_bounds(video.fps, video.total_frames, seconds("startseconds"), seconds("endseconds"))
        rate = float(self.o.get("processfps") or 0)
        frames = range(first, partition.last + 1)  # the grid starts with the window, so each range counts from there
        keep = accepted((f / video.fps for f in frames), 1 / rate, video.fps) if rate else (True for _ in frames)
        for f, on in zip(frames, keep, strict=False):
            if on and f >= partition.first:
                if self.o.get("pixels") == "false":
                    yield self.path, f, f / video.fps, video.width, video.height, None
                    continue
                pixels = video.read(f)
                if pixels is None:
                    return
                yield self.path, f, f / video.fps, video.width, video.height, pixels


class VideoDataSource(DataSource):
    """format("video") with options decoder ("module:Class"), startSeconds, endSeconds, processFps, framesPerPartition, pixels (false: numbers only).

    The decoder class takes the path and has fps, width, height, total_frames
    and read(frame) -> bytes or None.
    """

    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})


def read_video(spark: SparkSession, path: str, decoder: str, **options) -> DataFrame:
    spark.dataSource.register(VideoDataSource)
    return spark.read.format("video").options(decoder=decoder, **options).load(path)


def frame_index(spark: SparkSession, path: str, decoder: str, **options) -> DataFrame:
    """path, frame, ts of the frames that read_video would give; none is decoded."""
    return read_video(spark, path, decoder, pixels="false", **options).select("path", "frame", "ts")


def probe(spark: SparkSession, path: str, decoder: str, clip_id: int = 0, scale: float = 1.0) -> DataFrame:
    """The one-row clip table of a video."""
    v = load_class(decoder)(path)
    return spark.createDataFrame([(clip_id, v.width, v.height, float(v.fps), v.total_frames, scale)], "clip_id long, width int, height int, fps double, total_frames long, scale double")


def read_images(spark: SparkSession, folder: str, fps: float, pattern: str = "*.png") -> DataFrame:
    """A folder of numbered images as frames, with their encoded bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    frame = F.expr("try_cast(regexp_extract(path, '([0-9]+)[.][^.]*$', 1) AS BIGINT)")
    return files.select("path", frame.alias("frame"), F.col("content").alias("pixels")).filter("frame IS NOT NULL").withColumn("ts", F.col("frame") / fps)
