"""Trajectories painted over video frames, one image for each frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.functions import geometry as G
from motionloom.operators import overlay
from motionloom.operators.project import with_transform
from motionloom.sources import frames as video
from motionloom.sources import images

#: Blue, green, red of a violation's circle, and its radius in pixels. Fixed values.
RED, RADIUS = (0, 0, 255), 16


def line(canvas: np.ndarray, a, b, colour, thick: int) -> None:
    """A line of square dots; what lies outside the canvas is left out."""
    n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
    x, y = np.rint(np.linspace(a[0], b[0], n)).astype(int), np.rint(np.linspace(a[1], b[1], n)).astype(int)
    d = np.arange(thick) - thick // 2
    x, y = (x[:, None, None] + d[None, :, None] + 0 * d).ravel(), (y[:, None, None] + 0 * d[None, :, None] + d).ravel()
    good = (x >= 0) & (y >= 0) & (x < canvas.shape[1]) & (y < canvas.shape[0])
    canvas[y[good], x[good]] = colour


def circle(canvas: np.ndarray, at, radius: int, colour, thick: int = 0) -> None:
    """A ring of the thickness, or a disc."""
    d = np.arange(-radius - 1, radius + 2)
    far = np.hypot(d[None, :], d[:, None])
    y, x = np.nonzero(far <= radius if not thick else np.abs(far - radius) <= thick / 2)
    x, y = x - radius - 1 + at[0], y - radius - 1 + at[1]
    good = (x >= 0) & (y >= 0) & (x < canvas.shape[1]) & (y < canvas.shape[0])
    canvas[y[good], x[good]] = colour


def _raw(x, y, back):
    moved = G.apply(back, x, y)
    return F.struct(F.rint(moved[0]).cast("long").alias("x"), F.rint(moved[1]).cast("long").alias("y"))


def drawn_vehicles(states: DataFrame, transforms: DataFrame | None, fps: float, scale: float, trail: int) -> DataFrame:
    """clip_id, frame and shapes of a vehicle in raw pixels: bumpers, colour, label, and the trail through the frame's inverse pose."""
    pixels = states.withColumns({c: F.col(c) / scale for c in ("x", "y", "length", "width")})
    df = overlay.draw_list(pixels, None, None, fps, 1.0, trail)
    df = df.withColumn("t", G.identity()) if transforms is None else with_transform(df, transforms)
    back = G.inverse(F.col("t"))
    ends = {n: _raw(F.col(f"{n}_x"), F.col(f"{n}_y"), back) for n in ("front", "rear")}
    path = F.transform("trail", lambda p: _raw(p["x"].cast("double"), p["y"].cast("double"), back))
    return df.select("clip_id", "frame", F.struct(ends["front"].alias("front"), ends["rear"].alias("rear"), "colour", "label", path.alias("trail")).alias("shape"))


def drawn_marks(marks: DataFrame, transforms: DataFrame | None) -> DataFrame:
    """clip_id, frame and place of each violation mark in raw pixels."""
    df = marks.withColumn("t", G.identity()) if transforms is None else with_transform(marks, transforms)
    return df.select("clip_id", "frame", F.struct(_raw(F.col("centroid_x"), F.col("centroid_y"), G.inverse(F.col("t"))).alias("at"), "label").alias("mark"))


def paint(canvas: np.ndarray, shapes: list, marks: list) -> None:
    """Bumpers, lines and trails, then violations on top. Labels need a font, so they stay in the rows."""
    for s in shapes:
        colour = tuple(s["colour"][k] for k in "bgr")
        front, rear = ((s[n]["x"], s[n]["y"]) for n in ("front", "rear"))
        line(canvas, rear, front, colour, 2)
        circle(canvas, front, 5, colour)
        circle(canvas, rear, 5, colour, 2)
        path = [(p["x"], p["y"]) for p in s["trail"]]
        for a, b in zip(path, path[1:], strict=False):
            line(canvas, a, b, colour, 3)
    for m in marks:
        circle(canvas, (m["at"]["x"], m["at"]["y"]), RADIUS, RED, 2)


def render(spark: SparkSession, path: str, decoder: str, states: DataFrame, folder: str, scale: float, transforms: DataFrame | None = None, marks: DataFrame | None = None, trail: int = 0, tail_seconds: float = 0.5) -> int:
    """Paint the frames of the time span that has states to <folder>/frame_<number>.png; the number of frames.

    Frames are decoded and painted by range. The shapes of one frame meet in one
    row; ``trail`` bounds their size, 0 is the whole path.
    """
    source = video.load_class(decoder)(path)
    span = overlay.render_window(states, tail_seconds).agg(F.min("start_ts"), F.max("end_ts")).first()
    if span[0] is None:
        return 0
    index = video.frame_index(spark, path, decoder, startSeconds=span[0], endSeconds=span[1])
    shapes = drawn_vehicles(states, transforms, float(source.fps), scale, trail).groupBy("frame").agg(F.collect_list("shape").alias("shapes"))
    rows = index.select("frame").join(shapes, "frame", "left")
    if marks is not None:
        rows = rows.join(drawn_marks(marks, transforms).groupBy("frame").agg(F.collect_list("mark").alias("marks")), "frame", "left")
    else:
        rows = rows.withColumn("marks", F.expr("cast(array() AS array<struct<at:struct<x:bigint,y:bigint>,label:string>>)"))

    def work(batches):
        source = video.load_class(decoder)(path)
        for batch in batches:
            done = []
            for frame, s, m in zip(batch["frame"], batch["shapes"], batch["marks"], strict=True):
                data = source.read(int(frame))
                if data is None:
                    continue
                canvas = np.frombuffer(data, np.uint8).reshape(source.height, source.width, -1).copy()
                paint(canvas, [] if s is None else list(s), [] if m is None else list(m))
                images.write_png(f"{folder}/frame_{frame}.png", canvas)
                done.append(frame)
            yield pd.DataFrame({"frame": done}, dtype="int64")

    return rows.sortWithinPartitions("frame").mapInPandas(work, "frame long").count()
