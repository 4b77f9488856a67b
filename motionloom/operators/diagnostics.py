"""Figures about a run: activity, lifespans, births and deaths, jerk, histograms, nearest poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_counts(timesteps: DataFrame, records: DataFrame) -> DataFrame:
    """Vehicles at each timestep (clip_id, frame, ts), with 0 for empty ones."""
    n = records.groupBy("clip_id", "frame").agg(F.count("*").alias("n"))
    return timesteps.join(n, ["clip_id", "frame"], "left").select("clip_id", "frame", "ts", F.coalesce("n", F.lit(0)).cast("long").alias("active"))


def lifespans(records: DataFrame) -> DataFrame:
    """First and last time of each vehicle: the bars of a Gantt chart, in no order; sort by clip_id and first_ts to draw them."""
    spans = records.groupBy("clip_id", "vehicle_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_records"))
    return spans.withColumn("duration", F.col("last_ts") - F.col("first_ts"))


def births_and_deaths(records: DataFrame) -> DataFrame:
    """Where each vehicle is first and last seen; records are ordered by (ts, x, y, speed, accel)."""
    key = F.struct("ts", "x", "y", "speed", "accel")
    ends = records.groupBy("clip_id", "vehicle_id").agg(F.min(key).alias("b"), F.max(key).alias("d"))
    return ends.select("clip_id", "vehicle_id", F.col("b.x").alias("birth_x"), F.col("b.y").alias("birth_y"), F.col("d.x").alias("death_x"), F.col("d.y").alias("death_y"))


def jerks(records: DataFrame, least: int = 3) -> DataFrame:
    """Change of acceleration by time of tracks with at least so many records, where time moves on."""
    track = Window.partitionBy("clip_id", "vehicle_id")
    order = track.orderBy("ts", "row_id")
    df = records.withColumns({"n": F.count("*").over(track), "dt": F.col("ts") - F.lag("ts").over(order), "da": F.col("accel") - F.lag("accel").over(order)})
    return df.filter((F.col("n") >= least) & (F.col("dt") > 0)).select("clip_id", "vehicle_id", "ts", (F.col("da") / F.col("dt")).alias("jerk"))


def histogram(df: DataFrame, column: str, bins: int, clip: float | None = None) -> DataFrame:
    """Equal bins from the least to the greatest value, the last one closed. Columns: bin, count; empty bins too.

    ``clip``: only finite values with a smaller absolute value. If all values
    are the same, the range is one unit around it, as usual for plots.
    """
    v = F.col(column).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < (float("inf") if clip is None else clip))
    values = df.filter(ok).select(v.alias("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = values.join(F.broadcast(ends)).select(place.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))  # one row is broadcast
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def longest_tracks(records: DataFrame, n: int = 6) -> DataFrame:
    """The n tracks with the most records; ties go to the one that was read first."""
    sizes = records.groupBy("clip_id", "vehicle_id").agg(F.count("*").alias("n_records"), F.min("row_id").alias("first_row"))
    return sizes.orderBy(F.desc("n_records"), "first_row").limit(n)


def shared_longest(smooth: DataFrame, base: DataFrame) -> DataFrame:
    """For each clip, the longest base track that the smoothed run has too, or else the longest."""
    sizes = base.groupBy("clip_id", "vehicle_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    both = smooth.select("clip_id", "vehicle_id").distinct().withColumn("shared", F.lit(1))
    ranked = sizes.join(both, ["clip_id", "vehicle_id"], "left").withColumn("rank", F.struct(F.coalesce("shared", F.lit(0)), "n", -F.col("first_row")))
    return ranked.groupBy("clip_id").agg(F.max_by("vehicle_id", "rank").alias("vehicle_id"))


def nearest_pose(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """For each (clip_id, frame) the transform of the nearest frame; ties go to the one that was read first (least row_id).

    Both sides are sorted together once; each frame looks at the last
    transform before it and the first after it.
    """
    one = transforms.groupBy("clip_id", "frame").agg(F.min_by(F.struct("frame", "row_id", "a", "b", "c", "d", "tx", "ty"), "row_id").alias("t"))
    empty = F.lit(None).cast(one.schema["t"].dataType)
    both = frames.select("clip_id", "frame").distinct().withColumns({"t": empty, "asked": F.lit(True)}).unionByName(one.withColumn("asked", F.lit(False)))
    order = Window.partitionBy("clip_id").orderBy("frame", "asked")
    both = both.withColumns({"before": F.last("t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("t", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))}).filter("asked")
    far = lambda c: F.abs(F.col("frame") - F.col(f"{c}.frame"))
    choose = F.when(F.col("after").isNull() | (far("before") < far("after")) | ((far("before") == far("after")) & (F.col("before.row_id") <= F.col("after.row_id"))), F.col("before")).otherwise(F.col("after"))
    return both.withColumn("t", F.coalesce(choose, "before", "after")).filter("t IS NOT NULL").select("clip_id", "frame", F.col("t.frame").alias("pose_frame"), *(F.col(f"t.{c}") for c in ("a", "b", "c", "d", "tx", "ty")))


def summary(records: DataFrame) -> DataFrame:
    """Records, tracks and time span of each clip."""
    return records.groupBy("clip_id").agg(F.count("*").alias("n_records"), F.countDistinct("vehicle_id").alias("n_tracks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
