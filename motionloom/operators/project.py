"""Row-wise maps between boxes, frames of reference and kinematic states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions import geometry as G


def box_centres(df: DataFrame) -> DataFrame:
    """Adds cx, cy of boxes x, y, w, h."""
    return df.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})


def corners_to_box(df: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 to x, y, w, h."""
    return df.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).drop("x1", "y1", "x2", "y2")


def tracker_matrix(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Boxes as corners, score and class number in single precision, as a tracker takes them."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("vehicle_class")) - 1
    corners = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"), "conf": F.col("score"), "cls": number}
    return df.select("clip_id", "frame", "det_ind", *(c.cast("float").alias(n) for n, c in corners.items()))


def with_timestamp(df: DataFrame, fps: Column | float) -> DataFrame:
    return df.withColumn("ts", F.col("frame") / (fps if isinstance(fps, Column) else F.lit(float(fps))))


def with_transform(df: DataFrame, transforms: DataFrame) -> DataFrame:
    """Adds column ``t``, the transform of (clip_id, frame); frames without one get the identity.

    Of several transforms for a frame the last one read (greatest row_id) holds.
    """
    order = "row_id" if "row_id" in transforms.columns else "frame"
    one = transforms.groupBy("clip_id", "frame").agg(F.max_by(F.struct(*(F.col(c).cast("double").alias(c) for c in G.COEFFICIENTS)), order).alias("t"))
    return df.join(one, ["clip_id", "frame"], "left").withColumn("t", F.coalesce("t", G.identity()))


def stabilize(df: DataFrame, transforms: DataFrame) -> DataFrame:
    """Boxes x, y, w, h moved into the stabilized frame; they stay axis-parallel and grow with the transform's scale."""
    moved = with_transform(df, transforms)
    x, y = G.apply(F.col("t"), F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    k = G.scale_of(F.col("t"))
    return moved.withColumns({"_x": x, "_y": y, "_w": F.col("w") * k, "_h": F.col("h") * k}).withColumns({"x": F.col("_x") - F.col("_w") / 2, "y": F.col("_y") - F.col("_h") / 2, "w": F.col("_w"), "h": F.col("_h")}).drop("_x", "_y", "_w", "_h", "t")


def homography_point(h: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 homography (row by row); w = 0 raises."""
    h = [F.lit(float(v)) for v in h]
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(w == 0, F.raise_error(F.lit("point lies on the horizon")).cast("double")).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def to_world(df: DataFrame, homography: Sequence[float] | None) -> DataFrame:
    """Observations in world units: the centre, and the box's midlines as width and height. None: as they are."""
    if homography is None:
        return df
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    point = lambda x, y: homography_point(homography, x, y)
    (lx, ly), (rx, ry), (tx, ty), (bx, by), (mx, my) = point(cx - w / 2, cy), point(cx + w / 2, cy), point(cx, cy - h / 2), point(cx, cy + h / 2), point(cx, cy)
    return df.withColumns({"_cx": mx, "_cy": my, "_w": F.hypot(rx - lx, ry - ly), "_h": F.hypot(bx - tx, by - ty)}).withColumns({k: F.col(f"_{k}") for k in ("cx", "cy", "w", "h")}).drop("_cx", "_cy", "_w", "_h")


def normalize_world(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shift each clip's observations to a zero origin with a pad of its largest box side.

    Returns the observations and the clips' new canvas (clip_id, width, height, scale).
    """
    extents = df.groupBy("clip_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.max(F.greatest("w", "h")).alias("pad"))
    side = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) + F.col("pad")) - (F.col(lo) - F.col("pad")))).cast("int")
    canvas = extents.select("clip_id", side("x0", "x1").alias("width"), side("y0", "y1").alias("height"), F.lit(1.0).alias("scale"))
    moved = df.join(extents.select("clip_id", "x0", "y0", "pad"), "clip_id").withColumns({"cx": F.col("cx") - (F.col("x0") - F.col("pad")), "cy": F.col("cy") - (F.col("y0") - F.col("pad"))})
    return moved.select(*df.columns), canvas


#: Below this speed a vehicle counts as standing.
STANDING = 1e-6


def kinematic_states(df: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """States from smoothed samples (px, py, vx, vy, ax, ay, w, h, ts by clip_id, track_id, frame, row_id).

    The heading is the direction of motion; of a standing vehicle the last
    one, and before any motion the longer box side.
    """
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    df = df.withColumns({"_vx": F.col("vx") * s, "_vy": F.col("vy") * s})
    df = df.withColumn("speed", F.hypot("_vx", "_vy"))
    moving = F.col("speed") >= STANDING
    one = F.when(moving, F.lit(1.0))
    along = F.when(moving, F.struct((F.col("_vx") / F.col("speed")).alias("x"), (F.col("_vy") / F.col("speed")).alias("y")))
    before = Window.partitionBy("clip_id", "track_id").orderBy("frame", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    box = F.when(F.col("w") >= F.col("h"), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    df = df.withColumn("_along", along).withColumn("_h", F.coalesce(F.last("_along", ignorenulls=True).over(before), box))
    accel = F.coalesce(one * (F.col("_vx") * F.col("ax") * s + F.col("_vy") * F.col("ay") * s) / F.when(moving, F.col("speed")), F.lit(0.0))
    return df.select(
        "clip_id", "frame", "ts", F.col("track_id").alias("vehicle_id"), "row_id",
        (F.col("px") * s).alias("x"), (F.col("py") * s).alias("y"), F.col("_h.x").alias("hx"), F.col("_h.y").alias("hy"),
        (F.greatest("w", "h") * s).alias("length"), (F.least("w", "h") * s).alias("width"),
        F.col("_vx").alias("vx"), F.col("_vy").alias("vy"), "speed", accel.alias("accel"),
    )


def finite_differences(obs: DataFrame) -> DataFrame:
    """Samples with velocities and accelerations from neighbouring observations, for exact checks; the first of a track stands still."""
    order = Window.partitionBy("clip_id", "track_id").orderBy("frame", "row_id")
    dt = F.col("ts") - F.lag("ts").over(order)
    df = obs.withColumn("dt", F.coalesce(dt, F.lit(0.0)))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lag(c).over(order), F.col("dt")), F.lit(0.0))
    df = df.withColumns({"vx": rate("cx"), "vy": rate("cy")})
    df = df.withColumns({"ax": rate("vx"), "ay": rate("vy")})
    return df.withColumns({"px": F.col("cx"), "py": F.col("cy")})


def bumpers(df: DataFrame) -> DataFrame:
    """Adds the front and rear bumper points of states."""
    half = F.col("length") / 2
    return df.withColumns({"front_x": F.col("x") + F.col("hx") * half, "front_y": F.col("y") + F.col("hy") * half, "rear_x": F.col("x") - F.col("hx") * half, "rear_y": F.col("y") - F.col("hy") * half})


def to_grid(df: DataFrame, scale: Column | float, height: Column | float) -> DataFrame:
    """Bumper points in grid units with y upwards, as trajectory files hold them."""
    s, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (scale, height))
    df = bumpers(df)
    return df.withColumns({"front_x": F.col("front_x") / s, "front_y": (h * s - F.col("front_y")) / s, "rear_x": F.col("rear_x") / s, "rear_y": (h * s - F.col("rear_y")) / s})


def from_grid(df: DataFrame, scale: Column | float, height: Column | float) -> DataFrame:
    """States from records in grid units: centre, heading (east if the bumpers meet), velocity along it."""
    s, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (scale, height))
    fx, fy, rx, ry = F.col("front_x") * s, h * s - F.col("front_y") * s, F.col("rear_x") * s, h * s - F.col("rear_y") * s
    df = df.withColumns({"_dx": fx - rx, "_dy": fy - ry, "x": (fx + rx) / 2, "y": (fy + ry) / 2}).withColumn("_n", F.hypot("_dx", "_dy"))
    df = df.withColumns({"hx": F.coalesce(F.try_divide("_dx", "_n"), F.lit(1.0)), "hy": F.coalesce(F.try_divide("_dy", "_n"), F.lit(0.0))})
    return df.withColumns({"vx": F.col("hx") * F.col("speed"), "vy": F.col("hy") * F.col("speed")}).drop("_dx", "_dy", "_n")
