"""Deterministic vehicle views over the generic test tables, in Spark and as SQL text with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.operators import project

FPS, SIZE, SCALE, CLIP_COUNT, FRAMES = 10.0, 500, 0.5, 4, 720
EVENT_CLASSES = {"view": "car", "click": "motorcycle", "purchase": "bus", "signup": "truck"}

ZONES = (
    (0, 0, ((0.0, 0.0), (60.0, 0.0), (60.0, 200.0), (0.0, 200.0))),
    (1, 100, ((100.0, 50.0), (220.0, 50.0), (220.0, 90.0), (140.0, 90.0), (140.0, 310.0), (220.0, 310.0), (220.0, 350.0), (100.0, 350.0))),
    (2, 200, ((300.0, 400.0), (480.0, 420.0), (390.0, 495.0))),
)
#: frame, and the pose a, b, tx, c, d, ty.
ANCHORS = ((0, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)), (100, (1.0, 0.0, -40.0, 0.0, 1.0, 15.0)), (200, (0.75, -0.25, 30.0, 0.25, 0.75, -60.0)), (450, (1.25, 0.0, 5.0, 0.0, 1.25, -7.5)))
HOMOGRAPHY = (0.05, 0.002, 1.0, -0.001, 0.06, 2.0, 0.0001, 0.0002, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each user and hour of events; the user is the track, the hour the frame."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 3_600_000_000).cast("long")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    kinds = F.create_map(*(F.lit(x) for pair in EVENT_CLASSES.items() for x in pair))
    df = e.select(
        (F.col("user_id") % CLIP_COUNT).cast("long").alias("clip_id"), F.col("event_id").alias("row_id"), hour.alias("frame"), F.col("user_id").alias("track_id"),
        F.col("value").alias("cx"), (k * F.lit(5.0)).alias("cy"), (4 + F.col("event_id") % 7).cast("double").alias("w"), (2 + F.col("event_id") % 5).cast("double").alias("h"),
        F.coalesce(F.try_element_at(kinds, "event_type"), F.lit("car")).alias("vehicle_class"), F.col("event_type").alias("label"), ((F.col("event_id") % 100).cast("double") / 100.0).alias("score"),
    )
    first = Window.partitionBy("clip_id", "track_id", "frame").orderBy("row_id")
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def clips(spark: SparkSession) -> DataFrame:
    return spark.range(CLIP_COUNT).select(F.col("id").alias("clip_id"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), F.lit(FPS).alias("fps"), F.lit(FRAMES).cast("long").alias("total_frames"), F.lit(SCALE).alias("scale"))


def zones(spark: SparkSession) -> DataFrame:
    rows = [(z, f, [(float(x), float(y)) for x, y in v]) for z, f, v in ZONES]
    return spark.createDataFrame(rows, "zone_id int, reference_frame long, vertices array<struct<x:double,y:double>>")


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, p) for f, p in ANCHORS], "frame long, pose struct<a:double,b:double,tx:double,c:double,d:double,ty:double>")


def transforms(spark: SparkSession) -> DataFrame:
    """A transform for every third frame of each clip, in closed form."""
    f = F.col("frame")
    grid = spark.range(CLIP_COUNT).select(F.col("id").alias("clip_id")).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"), F.lit(3).cast("long"))))
    return grid.select("clip_id", (f + F.col("clip_id") * 1000).alias("row_id"), "frame", (1 + f / 4099).alias("a"), (-f / 8191).alias("b"), (f / 8191).alias("c"), (1 + f / 4099).alias("d"), (f % 17 - 8).cast("double").alias("tx"), (f % 11 - 5).cast("double").alias("ty"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinematic states by finite differences, which SQL gives exactly too."""
    obs = project.with_timestamp(observations(spark, sf_dir), FPS)
    return project.kinematic_states(project.finite_differences(obs), SCALE)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.to_grid(states(spark, sf_dir), SCALE, float(SIZE))


def timesteps(spark: SparkSession) -> DataFrame:
    """Every timestep of each clip, whether it has vehicles or not."""
    return spark.range(CLIP_COUNT).select(F.col("id").alias("clip_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"))).alias("frame"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CLASSES.items())
OBS = f"""obs AS (
    SELECT clip_id, row_id, frame, track_id, cx, cy, w, h, vehicle_class, label, score FROM (
        SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY row_id) AS n FROM (
            SELECT user_id % {CLIP_COUNT} AS clip_id, event_id AS row_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame, user_id AS track_id,
                value AS cx, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT * 5.0::DOUBLE AS cy, (4 + event_id % 7)::DOUBLE AS w, (2 + event_id % 5)::DOUBLE AS h,
                CASE event_type {_CASE} ELSE 'car' END AS vehicle_class, event_type AS label, (event_id % 100)::DOUBLE / 100.0::DOUBLE AS score
            FROM events)) WHERE n = 1)"""
_TRACK = "(PARTITION BY clip_id, track_id ORDER BY frame, row_id)"
STATES = f"""{OBS},
timed AS (SELECT *, frame::DOUBLE / 10.0::DOUBLE AS ts FROM obs),
d1 AS (SELECT *, coalesce(ts - lag(ts) OVER t, 0) AS dt, coalesce((cx - lag(cx) OVER t) / nullif(ts - lag(ts) OVER t, 0), 0) AS vx0, coalesce((cy - lag(cy) OVER t) / nullif(ts - lag(ts) OVER t, 0), 0) AS vy0 FROM timed WINDOW t AS {_TRACK}),
d2 AS (SELECT *, coalesce((vx0 - lag(vx0) OVER t) / nullif(dt, 0), 0) AS ax0, coalesce((vy0 - lag(vy0) OVER t) / nullif(dt, 0), 0) AS ay0 FROM d1 WINDOW t AS {_TRACK}),
d3 AS (SELECT *, vx0 * {SCALE}::DOUBLE AS vx, vy0 * {SCALE}::DOUBLE AS vy, sqrt(vx0 * {SCALE}::DOUBLE * vx0 * {SCALE}::DOUBLE + vy0 * {SCALE}::DOUBLE * vy0 * {SCALE}::DOUBLE) AS speed FROM d2),
states AS (
    SELECT clip_id, frame, ts, track_id AS vehicle_id, row_id, cx * {SCALE}::DOUBLE AS x, cy * {SCALE}::DOUBLE AS y,
        coalesce(last_value(CASE WHEN speed >= 1e-6 THEN vx / speed END IGNORE NULLS) OVER t, CASE WHEN w >= h THEN 1 ELSE 0 END)::DOUBLE AS hx,
        coalesce(last_value(CASE WHEN speed >= 1e-6 THEN vy / speed END IGNORE NULLS) OVER t, CASE WHEN w >= h THEN 0 ELSE 1 END)::DOUBLE AS hy,
        greatest(w, h) * {SCALE}::DOUBLE AS length, least(w, h) * {SCALE}::DOUBLE AS width, vx, vy, speed,
        CASE WHEN speed >= 1e-6 THEN (vx * ax0 * {SCALE}::DOUBLE + vy * ay0 * {SCALE}::DOUBLE) / speed ELSE 0 END AS accel
    FROM d3 WINDOW t AS (PARTITION BY clip_id, track_id ORDER BY frame, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_S, _H = f"{SCALE}::DOUBLE", f"{float(SIZE)}::DOUBLE"
RECORDS = f"""{STATES},
records AS (
    SELECT *, (x + hx * (length / 2)) / {_S} AS front_x, ({_H} * {_S} - (y + hy * (length / 2))) / {_S} AS front_y,
        (x - hx * (length / 2)) / {_S} AS rear_x, ({_H} * {_S} - (y - hy * (length / 2))) / {_S} AS rear_y
    FROM states)"""
_V = "(PARTITION BY clip_id, vehicle_id ORDER BY ordinal, row_id)"
JUDGED = f"""{RECORDS},
steps AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS ordinal, count(*) OVER (PARTITION BY clip_id) - 1 AS last_ordinal
    FROM (SELECT unnest(range({FRAMES})) AS frame), (SELECT unnest(range({CLIP_COUNT})) AS clip_id)),
numbered AS (SELECT records.*, ordinal, last_ordinal FROM records JOIN steps USING (clip_id, frame)),
runs AS (
    SELECT *, coalesce(ordinal <> lag(ordinal) OVER v + 1, true) AS run_start, coalesce(lead(ordinal) OVER v <> ordinal + 1, true) AS run_end,
        (front_x + rear_x) / 2 AS mx, (front_y + rear_y) / 2 AS my,
        CASE WHEN front_x <> rear_x OR front_y <> rear_y THEN atan2(front_y - rear_y, front_x - rear_x) END AS angle
    FROM numbered WINDOW v AS {_V}),
edged AS (SELECT *, least(mx, {SIZE} - mx, my, {SIZE} - my) AS edge, degrees(abs(lag(angle) OVER v - angle)) % 360.0::DOUBLE AS turn FROM runs WINDOW v AS {_V}),
judged AS (
    SELECT *, least(turn, 360 - turn) AS delta,
        CASE WHEN run_start THEN ordinal = 0 OR edge <= 33 + 0.5::DOUBLE * greatest(length, width) / {_S} END AS ok_appearance,
        CASE WHEN run_end THEN ordinal = last_ordinal OR edge <= 33 + 0.5::DOUBLE * greatest(length, width) / {_S} END AS ok_disappearance,
        CASE WHEN turn IS NOT NULL THEN least(turn, 360 - turn) <= 20 END AS ok_heading_switch,
        speed BETWEEN 0 AND 22 AS ok_speed_implausible, abs(accel) <= 5 AS ok_accel_implausible
    FROM edged)"""
TRANSFORMS = f"""tf AS (
    SELECT clip_id, f + clip_id * 1000 AS row_id, f AS frame, 1 + f / 4099.0::DOUBLE AS a, -f / 8191.0::DOUBLE AS b, f / 8191.0::DOUBLE AS c, 1 + f / 4099.0::DOUBLE AS d, (f % 17 - 8)::DOUBLE AS tx, (f % 11 - 5)::DOUBLE AS ty
    FROM (SELECT unnest(range(0, {FRAMES}, 3)) AS f), (SELECT unnest(range({CLIP_COUNT})) AS clip_id))"""
_POSES = {f: p for f, p in ANCHORS}


def _lift(p, x, y):
    return f"({p[0]}::DOUBLE * {x} + {p[1]}::DOUBLE * {y} + {p[2]}::DOUBLE)", f"({p[3]}::DOUBLE * {x} + {p[4]}::DOUBLE * {y} + {p[5]}::DOUBLE)"


GLOBAL_EDGES = "gedges(zone_id, i, px, py, qx, qy) AS (VALUES " + ", ".join(
    f"({z}, {i}, {', '.join((*_lift(_POSES[f], *v[i]), *_lift(_POSES[f], *v[i - 1])))})" for z, f, v in ZONES for i in range(len(v))
) + ")"
PIP = f"""{OBS}, {GLOBAL_EDGES},
hits AS (SELECT row_id, zone_id, count(*) % 2 = 1 AS inside FROM obs JOIN gedges ON (py > cy) <> (qy > cy) AND cx < (qx - px) * (cy - py) / (qy - py) + px GROUP BY ALL),
flagged AS (SELECT o.*, coalesce(f.inside, false) AS inside FROM obs o LEFT JOIN (SELECT row_id, bool_or(inside) AS inside FROM hits GROUP BY row_id) f USING (row_id))"""
