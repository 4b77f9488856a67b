"""Tracks that spend most of their life inside exclusion zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.functions import geometry as G


def zones_in_global_frame(zones: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """Zones (zone_id, reference_frame, vertices) with vertices through the pose of their reference frame.

    Without anchors every pose is the identity; with them a missing one raises.
    """
    if anchors is None:
        return zones.select("zone_id", "vertices")
    poses = anchors.select(F.col("frame").alias("reference_frame"), F.col("pose"))
    joined = zones.join(poses, "reference_frame", "left")
    pose = F.when(F.col("pose").isNull(), F.raise_error(F.concat(F.lit("no anchor for reference frame "), F.col("reference_frame").cast("string"))).cast(poses.schema["pose"].dataType)).otherwise(F.col("pose"))
    return joined.select("zone_id", G.map_polygon(pose, F.col("vertices")).alias("vertices"))


def flag_inside(obs: DataFrame, polygons: list[list[tuple[float, float]]]) -> DataFrame:
    """Adds ``inside``: whether the centre lies in any polygon. Each test is preceded by one of the polygon's box."""
    inside = F.lit(False)
    for points in polygons:
        vertices = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
        if len(points) < 3:
            continue
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        box = F.col("cx").between(min(xs), max(xs)) & F.col("cy").between(min(ys), max(ys))
        inside = inside | (box & G.point_in_polygon(F.col("cx"), F.col("cy"), vertices))
    return obs.withColumn("inside", F.coalesce(inside, F.lit(False)))


def flag_zones(obs: DataFrame, zones: DataFrame, literal: int = 64) -> DataFrame:
    """Adds ``inside`` for zones (zone_id, vertices) of any number; the same verdicts either way.

    Zones are drawn by hand, so there are few: up to ``literal`` become literals
    of one projection, without a shuffle. More are joined by grid cells.
    """
    rows = zones.select("vertices").take(literal + 1)
    if len(rows) <= literal:
        return flag_inside(obs, [[(v["x"], v["y"]) for v in r["vertices"]] for r in rows])
    return flag_by_cells(obs, zones)


def flag_by_cells(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """As flag_inside, by an equi-join of the different centres with the grid cells that zones touch.

    A zone lies on the grid whose cells are as wide as it, or less than twice,
    so it touches four cells at most; a centre is looked up once on each grid
    that has zones.
    """
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    boxes = zones.filter(F.size("vertices") >= 3).select("vertices", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    width = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    boxes = boxes.withColumn("level", F.ceil(F.log2(width)).cast("int"))
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    span = lambda a, b: F.explode(F.sequence(cell(a, F.col("level")), cell(b, F.col("level"))))
    cells = boxes.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))
    levels = [r["level"] for r in boxes.select("level").distinct().collect()]  # powers of two: some twenty for any canvas
    points = obs.select("cx", "cy").distinct().filter("cx IS NOT NULL AND cy IS NOT NULL AND NOT isnan(cx) AND NOT isnan(cy)")
    points = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    points = points.withColumns({"gx": cell("cx", F.col("level")), "gy": cell("cy", F.col("level"))})
    near = points.join(cells, ["level", "gx", "gy"]).filter(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))
    hits = near.filter(G.point_in_polygon(F.col("cx"), F.col("cy"), F.col("vertices"))).select("cx", "cy").distinct().withColumn("inside", F.lit(True))
    return obs.join(hits, ["cx", "cy"], "left").select(*obs.columns, F.coalesce("inside", F.lit(False)).alias("inside"))


def excluded_tracks(flagged: DataFrame, min_fraction: float) -> DataFrame:
    """Tracks (clip_id, track_id) of which at least the fraction (inclusive) of observations is inside."""
    if not 0 < min_fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    return flagged.groupBy("clip_id", "track_id").agg(F.count_if("inside").alias("n_inside"), F.count("*").alias("n")).filter(F.col("n_inside") / F.col("n") >= min_fraction)


def drop_excluded(obs: DataFrame, zones: DataFrame, anchors: DataFrame | None, min_fraction: float = 0.5) -> DataFrame:
    flagged = flag_zones(obs, zones_in_global_frame(zones, anchors))
    return obs.join(excluded_tracks(flagged, min_fraction).select("clip_id", "track_id"), ["clip_id", "track_id"], "left_anti")
