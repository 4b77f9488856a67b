"""Predicates and quarantine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class numbers and names of the two supported detector families. Fixed values.
AERIAL_CLASSES = {3: "car", 4: "car", 5: "truck", 8: "bus", 9: "motorcycle"}
STREET_CLASSES = {"car": "car", "motorcycle": "motorcycle", "bus": "bus", "truck": "truck"}


def by_score(df: DataFrame, least: float) -> DataFrame:
    if not 0 <= least <= 1:
        raise ValueError("the score threshold must lie in [0, 1]")
    return df.filter(F.col("score") >= least)


def map_classes(df: DataFrame, classes: Mapping, column: str = "label") -> DataFrame:
    """Adds vehicle_class; rows with another label go."""
    table = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    return df.withColumn("vehicle_class", F.try_element_at(table, F.col(column))).filter("vehicle_class IS NOT NULL")


def window_bounds(fps: float, total: int, start_seconds: float | None, end_seconds: float | None) -> tuple[int, int | None]:
    """First and last frame (inclusive) of a time window: start rounded half to even, end cut off, clamped to the clip."""
    start = round((start_seconds or 0.0) * fps)
    end = None if end_seconds is None else int(end_seconds * fps)
    if start < 0:
        raise ValueError("the window starts before the clip")
    if total > 0:
        if start >= total:
            raise ValueError("the window starts after the clip's end")
        end = total - 1 if end is None else min(end, total - 1)
    if end is not None and end < start:
        raise ValueError("the window ends before it starts")
    return start, end


def in_window(df: DataFrame, fps: float, total: int, start_seconds: float | None, end_seconds: float | None) -> DataFrame:
    start, end = window_bounds(fps, total, start_seconds, end_seconds)
    return df.filter(F.col("frame").between(start, end) if end is not None else F.col("frame") >= start)


def with_detection(df: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracker rows (clip_id, frame, det_ind, track_id, ...) with the class and score of their detection; rows that are only predicted go."""
    return df.join(detections.select("clip_id", "frame", "det_ind", "vehicle_class", "score"), ["clip_id", "frame", "det_ind"])


def observation_faults() -> Column:
    """What is wrong with an observation, as an array of names; empty if nothing."""
    rules = {
        "size": (F.col("w") > 0) & (F.col("h") > 0), "score": F.col("score").between(0, 1), "track": F.col("track_id") >= 0,
        "class": F.col("vehicle_class").isin("car", "motorcycle", "bus", "truck"), "finite": F.col("cx").isNotNull() & F.col("cy").isNotNull() & ~F.isnan("cx") & ~F.isnan("cy"),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid observations, and the others with their faults."""
    marked = df.withColumn("faults", observation_faults())
    return marked.filter(F.size("faults") == 0).drop("faults"), marked.filter(F.size("faults") > 0)


def supported(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows whose group has at least so many."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n"), keys, "left_semi")
