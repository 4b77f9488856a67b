"""Quality checks of trajectory records: continuity, heading and plausibility.

Records: clip_id, frame, ts, vehicle_id, row_id, front_x, front_y, rear_x,
rear_y, length, width, speed, accel in grid units; clips: clip_id, width,
height, scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions import geometry as G

# The margin in grid units, degrees, the limits and the names of the checks.
MARGIN = 33.0
HEADING_STEP = 20.0
#: (speed, acceleration) limits by unit system: 0 English, 1 metric.
LIMITS = {0: (230.0, 40.0), 1: (22.0, 5.0)}
CHECKS = ("appearance", "disappearance", "heading_switch", "speed_implausible", "accel_implausible")
_FIELDS = ("clip_id", "ordinal", "ts", "vehicle_id", "check", "value", "front_x", "front_y", "rear_x", "rear_y", "length", "width", "speed", "accel")


def limits(units: int) -> tuple[float, float]:
    return LIMITS.get(units, LIMITS[1])


def numbered(timesteps: DataFrame) -> DataFrame:
    """clip_id, frame, ordinal of distinct timesteps: their number in the clip, from 0."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    return timesteps.select("clip_id", "frame").distinct().withColumn("ordinal", F.row_number().over(order).cast("long") - 1)


def with_ordinal(records: DataFrame, timesteps: DataFrame | None = None) -> DataFrame:
    """Adds the number of the record's timestep in its clip, and the clip's last one.

    ``timesteps`` (clip_id, frame) are all of a clip's, those without vehicles
    included, which a vehicle that is seen before and after is missing from.
    Without them only timesteps with records count.
    """
    steps = numbered(records if timesteps is None else timesteps)
    last = steps.groupBy("clip_id").agg(F.max("ordinal").alias("last_ordinal"))
    return records.join(steps, ["clip_id", "frame"]).join(last, "clip_id")


def centroid() -> tuple[Column, Column]:
    return (F.col("front_x") + F.col("rear_x")) / 2, (F.col("front_y") + F.col("rear_y")) / 2


def heading_angle() -> Column:
    """Null where the bumpers meet."""
    dx, dy = F.col("front_x") - F.col("rear_x"), F.col("front_y") - F.col("rear_y")
    return F.when((dx != 0) | (dy != 0), F.atan2(dy, dx))


def edge_distance() -> Column:
    cx, cy = centroid()
    return F.least(cx, F.col("canvas_width") - cx, cy, F.col("canvas_height") - cy)


def near_boundary(margin: float) -> Column:
    return edge_distance() <= margin + 0.5 * F.greatest("length", "width") / F.col("scale")


def contiguous_runs(records: DataFrame) -> DataFrame:
    """Adds run: the number of the run of consecutive ordinals in the vehicle's track, and run ends."""
    order = Window.partitionBy("clip_id", "vehicle_id").orderBy("ordinal", "row_id")
    starts = F.coalesce(F.col("ordinal") != F.lag("ordinal").over(order) + 1, F.lit(True))
    ends = F.coalesce(F.lead("ordinal").over(order) != F.col("ordinal") + 1, F.lit(True))
    df = records.withColumns({"run_start": starts, "run_end": ends})
    return df.withColumn("run", F.sum(F.col("run_start").cast("long")).over(order))


def judged(records: DataFrame, clips: DataFrame, timesteps: DataFrame | None = None, margin: float = MARGIN, heading_step: float = HEADING_STEP, max_speed: float | None = None, max_accel: float | None = None, units: int = 1) -> DataFrame:
    """The records with one nullable verdict for each check: true, false, or null where it doesn't apply.

    The windows share one partitioning by (clip_id, vehicle_id).
    """
    speed, accel = (given if given is not None else default for given, default in zip((max_speed, max_accel), limits(units), strict=True))
    canvas = clips.select("clip_id", F.col("width").alias("canvas_width"), F.col("height").alias("canvas_height"), "scale")
    df = contiguous_runs(with_ordinal(records, timesteps).join(canvas, "clip_id"))
    order = Window.partitionBy("clip_id", "vehicle_id").orderBy("ordinal", "row_id")
    df = df.withColumn("angle", heading_angle())
    df = df.withColumn("heading_delta", G.angle_step(F.lag("angle").over(order), F.col("angle")))
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.withColumns(
        {
            "ok_appearance": F.when(F.col("run_start"), (F.col("ordinal") == 0) | near_boundary(margin)),
            "ok_disappearance": F.when(F.col("run_end"), (F.col("ordinal") == F.col("last_ordinal")) | near_boundary(margin)),
            "ok_heading_switch": F.when(F.col("heading_delta").isNotNull(), F.col("heading_delta") <= heading_step),
            "ok_speed_implausible": finite("speed") & F.col("speed").between(0.0, speed),
            "ok_accel_implausible": finite("accel") & (F.abs("accel") <= accel),
        }
    )


def of_file(rows: DataFrame, margin: float = MARGIN, heading_step: float = HEADING_STEP, max_speed: float | None = None, max_accel: float | None = None, units: int = 1) -> DataFrame:
    """judged() of the rows of one trajectory file, all its timesteps counted."""
    zero = F.lit(0).cast("long").alias("clip_id")
    clips = rows.filter("kind = 'header'").select(zero, F.col("max_x").alias("width"), F.col("max_y").alias("height"), "scale")
    steps = rows.filter("kind = 'timestep'").select(zero, F.col("ordinal").alias("frame"))
    records = rows.filter("kind = 'vehicle'").select(zero, F.col("ordinal").alias("frame"), F.col("pos").alias("row_id"), "ts", "vehicle_id", "front_x", "front_y", "rear_x", "rear_y", "length", "width", "speed", "accel")
    return judged(records, clips, steps, margin, heading_step, max_speed, max_accel, units)


def report(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """check, compliant, total, pct (null if total is 0) of judged records, by clip or other keys if given."""
    counts = [F.struct(F.lit(c).alias("check"), F.count_if(f"ok_{c}").alias("compliant"), F.count(f"ok_{c}").alias("total")) for c in CHECKS]
    out = df.groupBy(*keys).agg(F.array(*counts).alias("c")).select(*keys, F.explode("c").alias("c")).select(*keys, "c.*")
    return out.withColumn("pct", F.try_divide(F.col("compliant") * 100.0, F.col("total")))


def violations(df: DataFrame) -> DataFrame:
    """One row for each failed check of judged records; value: the distance, angle, speed or acceleration that failed."""
    value = {"appearance": edge_distance(), "disappearance": edge_distance(), "heading_switch": F.col("heading_delta"), "speed_implausible": F.col("speed"), "accel_implausible": F.abs("accel")}
    failed = F.array_compact(F.array(*(F.when(~F.col(f"ok_{c}"), F.struct(F.lit(c).alias("check"), value[c].alias("value"))) for c in CHECKS)))
    return df.withColumn("v", F.explode(failed)).select(*(F.col(f"v.{f}") if f in ("check", "value") else F.col(f) for f in _FIELDS), "canvas_height")


def image_rows(violated: DataFrame) -> DataFrame:
    """Violations in image coordinates (y downwards), for a CSV file; sorted by timestep, vehicle and check."""
    cx, cy = centroid()
    flip = lambda y: F.col("canvas_height") - y
    return violated.select(
        "clip_id", F.col("ordinal").alias("frame_index"), F.col("ts").alias("timestamp_s"), "vehicle_id", "check", "value", cx.alias("centroid_x"), flip(cy).alias("centroid_y"),
        "front_x", flip(F.col("front_y")).alias("front_y"), "rear_x", flip(F.col("rear_y")).alias("rear_y"), "length", "width", "speed", "accel",
    ).orderBy("clip_id", "frame_index", "vehicle_id", "check")


def gate(checks: DataFrame, fail_under: float) -> bool:
    """Whether all checks that apply reach the percentage."""
    return checks.filter(F.col("pct") < fail_under).isEmpty()


def passed(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))
