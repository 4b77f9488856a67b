"""What to draw on each video frame, as rows. Painting and encoding are left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions import drawing
from motionloom.functions import geometry as G
from motionloom.operators.project import bumpers, with_transform


def frame_of(ts, fps: float):
    """The video frame of a time, half to even, through single precision as in trajectory files."""
    return F.rint(ts.cast("float").cast("double") * fps).cast("long")


def states_on_frames(states: DataFrame, fps: float) -> DataFrame:
    """States with the frame that their time falls on; several timesteps may share one."""
    return states.withColumn("frame", frame_of(F.col("ts"), fps))


def render_window(states: DataFrame, tail_seconds: float = 0.5) -> DataFrame:
    """By clip: the time span that has states, and a tail."""
    return states.groupBy("clip_id").agg(F.min("ts").alias("start_ts"), (F.max("ts") + tail_seconds).alias("end_ts"))


def trails(states: DataFrame, n: int = 0) -> DataFrame:
    """Adds trail: the last n centres of the vehicle up to this row, rounded (0: all since its first)."""
    order = Window.partitionBy("clip_id", "vehicle_id").orderBy("frame", "row_id").rowsBetween(Window.unboundedPreceding if n == 0 else 1 - n, Window.currentRow)
    point = F.struct(F.rint("x").cast("long").alias("x"), F.rint("y").cast("long").alias("y"))
    return states.withColumn("trail", F.collect_list(point).over(order))


def to_raw_pixels(states: DataFrame, transforms: DataFrame | None, scale: float) -> DataFrame:
    """Adds px, py: the centre in pixels of the raw video frame, through the inverse transform, half to even."""
    df = states if transforms is None else with_transform(states, transforms)
    t = G.identity() if transforms is None else F.col("t")
    x, y = G.apply(G.inverse(t), F.col("x") / scale, F.col("y") / scale)
    return df.withColumns({"px": F.rint(x).cast("long"), "py": F.rint(y).cast("long")}).drop("t")


def collapse_violations(violations: DataFrame, fps: float, checks: list[str] | None = None) -> DataFrame:
    """One mark for each (clip_id, frame, vehicle): its sorted checks joined, and the centre of the last row read."""
    df = violations if checks is None else violations.filter(F.col("check").isin([c.strip() for c in checks if c.strip()]))
    df = df.withColumn("frame", F.rint(F.col("timestamp_s") * fps).cast("long"))
    return df.groupBy("clip_id", "frame", "vehicle_id").agg(
        F.array_join(F.array_sort(F.collect_set("check")), " / ").alias("label"),
        F.max_by("centroid_x", "row_id").alias("centroid_x"), F.max_by("centroid_y", "row_id").alias("centroid_y"),
    )


def draw_list(states: DataFrame, transforms: DataFrame | None, marks: DataFrame | None, fps: float, scale: float, trail: int = 0) -> DataFrame:
    """By frame and vehicle: raw pixel, bumper line, colour, label, trail, and the violation mark if there is one."""
    df = trails(bumpers(states_on_frames(states, fps)), trail)
    df = to_raw_pixels(df, transforms, scale).withColumns({"colour": drawing.colour(F.col("vehicle_id")), "label": drawing.label(F.col("vehicle_id"), F.col("speed"))})
    if marks is None:
        return df.withColumn("mark", F.lit(None).cast("string"))
    return df.join(marks.select("clip_id", "frame", "vehicle_id", F.col("label").alias("mark")), ["clip_id", "frame", "vehicle_id"], "left")


def mosaic_bounds(anchors: DataFrame, width: float, height: float) -> DataFrame:
    """The canvas that holds all anchor images in the global frame (anchors: clip_id, frame, pose)."""
    corners = G.map_polygon(F.col("pose"), G.rectangle(F.lit(width), F.lit(height)))
    v = anchors.select("clip_id", F.explode(corners).alias("v"))
    return v.groupBy("clip_id").agg(F.floor(F.min("v.x")).alias("x0"), F.floor(F.min("v.y")).alias("y0"), F.ceil(F.max("v.x")).alias("x1"), F.ceil(F.max("v.y")).alias("y1"))
