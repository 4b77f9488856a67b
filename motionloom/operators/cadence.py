"""Thinning to a fixed cadence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Grid:
    """Accepts the first timestamp, then the first one at or near each multiple of the interval after it."""

    def __init__(self, interval: float, fps: float):
        if interval <= 0 or fps <= 0:
            raise ValueError("interval and fps must be positive")
        self.interval, self.slack = interval, 0.5 / fps
        self.reset()

    def reset(self) -> None:
        self.due: float | None = None

    def accepts(self, t: float) -> bool:
        if self.due is None:
            self.due = t
        if t < self.due - self.slack:
            return False
        limit = t + self.slack
        while self.due <= limit:
            self.due += self.interval
        return True


def accepted(timestamps: Iterable[float], interval: float, fps: float) -> Iterator[bool]:
    grid = Grid(interval, fps)
    return (grid.accepts(t) for t in timestamps)


def timesteps(df: DataFrame, interval: float, fps: float) -> DataFrame:
    """The accepted (clip_id, frame, ts) of a table's distinct timesteps.

    The grid's sums are made one by one, since their rounding decides ties. A
    clip's distinct timesteps meet in one task: three numbers for each frame
    of one clip.
    """
    Grid(interval, fps)
    steps = df.select("clip_id", "frame", "ts").distinct()

    def fold(frame):
        frame = frame.sort_values(["ts", "frame"])
        return frame[list(accepted(frame["ts"], interval, fps))]

    return steps.groupBy("clip_id").applyInPandas(fold, steps.schema)


def decimate(df: DataFrame, interval: float, fps: float) -> DataFrame:
    """The rows of accepted timesteps; interval 0 keeps all."""
    if interval == 0:
        return df
    return df.join(timesteps(df, interval, fps).select("clip_id", "frame"), ["clip_id", "frame"], "left_semi")


def count_accepted(df: DataFrame, interval: float, fps: float) -> DataFrame:
    return timesteps(df, interval, fps).groupBy("clip_id").agg(F.count("*").alias("n_timesteps"))
