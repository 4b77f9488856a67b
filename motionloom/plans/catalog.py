"""The registered queries: each operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.functions import drawing
from motionloom.functions import geometry as G
from motionloom.operators import cadence, calibrate, diagnostics, egomotion, exclusion, filters, matching, overlay, project, smoothing, validate
from motionloom.plans import views as V
from motionloom.sources import sidecars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def R(column, digits: int = 6):
    """Rounded, without negative zero, as the SQL does it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, digits) for c in columns})


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0 AS {name}"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by frame of a clip, numbered in row order."""
    obs = V.observations(spark, sf_dir)
    order = Window.partitionBy("clip_id", "frame").orderBy("row_id")
    return obs.select("clip_id", "frame", (F.row_number().over(order) - 1).alias("det_ind"), (F.col("cx") - F.col("w") / 2).alias("x"), (F.col("cy") - F.col("h") / 2).alias("y"), "w", "h", "score", "vehicle_class", "track_id", "row_id", "label")


DET = f"{V.OBS}, det AS (SELECT clip_id, frame, (row_number() OVER (PARTITION BY clip_id, frame ORDER BY row_id) - 1)::INTEGER AS det_ind, cx - w / 2 AS x, cy - h / 2 AS y, w, h, score, vehicle_class, track_id, row_id, label FROM obs)"


# Projections

@query(f"WITH {V.OBS} SELECT clip_id, row_id, frame, track_id, cx, cy, w, h, vehicle_class, score, frame::DOUBLE / 10.0::DOUBLE AS ts FROM obs")
def obs_projection(spark, sf):
    return project.with_timestamp(V.observations(spark, sf), V.FPS).drop("label")


@query(f"WITH {DET} SELECT row_id, {r('x + w / 2', 'cx')}, {r('y + h / 2', 'cy')} FROM det")
def bbox_center(spark, sf):
    return project.box_centres(detections(spark, sf)).select("row_id", R("cx").alias("cx"), R("cy").alias("cy"))


@query(f"WITH {DET} SELECT row_id, {r('x - h', 'x')}, {r('y - w', 'y')}, {r('w + h', 'w')}, {r('h + w', 'h')} FROM det")
def corners_to_boxes(spark, sf):
    d = detections(spark, sf)
    corners = d.select("row_id", (F.col("x") - F.col("h")).alias("x1"), (F.col("y") - F.col("w")).alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return rounded(project.corners_to_box(corners), "x", "y", "w", "h")


@query(f"WITH {DET} SELECT clip_id, frame, det_ind, round(x::FLOAT::DOUBLE, 3) AS x1, round(y::FLOAT::DOUBLE, 3) AS y1, round((x + w)::FLOAT::DOUBLE, 3) AS x2, round((y + h)::FLOAT::DOUBLE, 3) AS y2, round(score::FLOAT::DOUBLE, 3) AS conf, CASE vehicle_class WHEN 'car' THEN 0 WHEN 'motorcycle' THEN 1 WHEN 'bus' THEN 2 ELSE 3 END::DOUBLE AS cls FROM det")
def tracker_matrix(spark, sf):
    m = project.tracker_matrix(detections(spark, sf), ("car", "motorcycle", "bus", "truck"))
    return m.select("clip_id", "frame", "det_ind", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x1", "y1", "x2", "y2", "conf")), F.col("cls").cast("double").alias("cls"))


@query(f"WITH {V.OBS}, {V.TRANSFORMS} SELECT row_id, {r('coalesce(a * cx + b * cy + tx, cx)', 'gx')}, {r('coalesce(c * cx + d * cy + ty, cy)', 'gy')} FROM obs LEFT JOIN tf USING (clip_id, frame)".replace("SELECT row_id", "SELECT obs.row_id"))
def affine_apply(spark, sf):
    df = project.with_transform(V.observations(spark, sf), V.transforms(spark))
    x, y = G.apply(F.col("t"), F.col("cx"), F.col("cy"))
    return df.select("row_id", R(x).alias("gx"), R(y).alias("gy"))


@query(f"""WITH {V.TRANSFORMS}, n AS (SELECT p.clip_id, p.frame, p.a * q.a + p.b * q.c AS a, p.a * q.b + p.b * q.d AS b, p.a * q.tx + p.b * q.ty + p.tx AS tx, p.c * q.a + p.d * q.c AS c, p.c * q.b + p.d * q.d AS d, p.c * q.tx + p.d * q.ty + p.ty AS ty FROM tf p JOIN tf q ON p.clip_id = q.clip_id AND q.frame = p.frame + 3)
SELECT clip_id, frame, {r('a', 'a')}, {r('b', 'b')}, {r('tx', 'tx')}, {r('d / (a * d - b * c)', 'ia')}, {r('-(d / (a * d - b * c) * tx + -b / (a * d - b * c) * ty)', 'itx')}, {r('sqrt(abs(a * d - b * c))', 'scale')}, {r('degrees(atan2(c, a))', 'rotation')}, {r('sqrt(tx * tx + ty * ty)', 'translation')} FROM n""")
def affine_compose_inverse(spark, sf):
    t = V.transforms(spark).select("clip_id", "frame", F.struct(*G.COEFFICIENTS).alias("t"))
    n = t.join(t.select("clip_id", (F.col("frame") - 3).alias("frame"), F.col("t").alias("u")), ["clip_id", "frame"]).withColumn("m", G.compose(F.col("t"), F.col("u")))
    n = n.withColumn("i", G.inverse(F.col("m")))
    parts = G.decompose(F.col("m"))
    return n.select("clip_id", "frame", R("m.a").alias("a"), R("m.b").alias("b"), R("m.tx").alias("tx"), R("i.a").alias("ia"), R("i.tx").alias("itx"), R(G.scale_of(F.col("m"))).alias("scale"), R(parts["rotation"]).alias("rotation"), R(parts["translation"]).alias("translation"))


@query(f"""WITH {DET}, {V.TRANSFORMS}, m AS (SELECT det.row_id, coalesce(a, 1) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 1) AS d, coalesce(tx, 0) AS tx, coalesce(ty, 0) AS ty, x + w / 2 AS mx, y + h / 2 AS my, w, h FROM det LEFT JOIN tf USING (clip_id, frame)),
k AS (SELECT *, sqrt(abs(a * d - b * c)) AS k FROM m)
SELECT row_id, {r('a * mx + b * my + tx - w * k / 2', 'x')}, {r('c * mx + d * my + ty - h * k / 2', 'y')}, {r('w * k', 'w')}, {r('h * k', 'h')} FROM k""")
def stabilize_boxes(spark, sf):
    out = project.stabilize(detections(spark, sf), V.transforms(spark))
    return out.select("row_id", *(R(c).alias(c) for c in ("x", "y", "w", "h")))


_H = [f"{v}::DOUBLE" for v in V.HOMOGRAPHY]


def _hx(x: str, y: str) -> tuple[str, str]:
    w = f"({_H[6]} * {x} + {_H[7]} * {y} + {_H[8]})"
    return f"(({_H[0]} * {x} + {_H[1]} * {y} + {_H[2]}) / {w})", f"(({_H[3]} * {x} + {_H[4]} * {y} + {_H[5]}) / {w})"


def _between(p, q):
    (a, b), (c, d) = p, q
    return f"sqrt(({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b}))"


WORLD = f"""{V.OBS}, world AS (SELECT clip_id, row_id, {_hx('cx', 'cy')[0]} AS cx, {_hx('cx', 'cy')[1]} AS cy, {_between(_hx('(cx - w / 2)', 'cy'), _hx('(cx + w / 2)', 'cy'))} AS w, {_between(_hx('cx', '(cy - h / 2)'), _hx('cx', '(cy + h / 2)'))} AS h FROM obs)"""


@query(f"WITH {WORLD} SELECT row_id, {r('cx', 'cx')}, {r('cy', 'cy')}, {r('w', 'w')}, {r('h', 'h')} FROM world")
def world_project(spark, sf):
    return project.to_world(V.observations(spark, sf), V.HOMOGRAPHY).select("row_id", *(R(c).alias(c) for c in ("cx", "cy", "w", "h")))


@query(f"""WITH {WORLD}, e AS (SELECT clip_id, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, max(greatest(w, h)) AS pad FROM world GROUP BY clip_id)
SELECT row_id, {r('cx - (x0 - pad)', 'cx')}, {r('cy - (y0 - pad)', 'cy')}, greatest(1, ceil((x1 + pad) - (x0 - pad)))::INTEGER AS width, greatest(1, ceil((y1 + pad) - (y0 - pad)))::INTEGER AS height FROM world JOIN e USING (clip_id)""")
def world_extent_normalize(spark, sf):
    obs, canvas = project.normalize_world(project.to_world(V.observations(spark, sf), V.HOMOGRAPHY))
    return obs.join(canvas, "clip_id").select("row_id", R("cx").alias("cx"), R("cy").alias("cy"), "width", "height")


@query("SELECT model, round(sensor_mm * altitude / (focal_mm * 1920), 9) AS gsd, altitude FROM (VALUES " + ", ".join(f"('{k}', {s}::DOUBLE, {f}::DOUBLE)" for k, (s, f) in calibrate.DRONES.items()) + ") t(model, sensor_mm, focal_mm), (SELECT unnest([30.0::DOUBLE, 50.0::DOUBLE, 120.0::DOUBLE]) AS altitude)")
def gsd_by_drone(spark, sf):
    df = calibrate.drones(spark).withColumn("altitude", F.explode(F.array(*(F.lit(v) for v in (30.0, 50.0, 120.0)))))
    return df.select("model", "altitude", F.round(calibrate.ground_sample_distance(F.col("sensor_mm"), F.col("altitude"), F.col("focal_mm"), F.lit(1920)), 9).alias("gsd"))


# Filters

@query(f"WITH {V.OBS} SELECT row_id, CASE label WHEN 'view' THEN 'car' WHEN 'click' THEN 'motorcycle' WHEN 'purchase' THEN 'bus' ELSE 'truck' END AS vehicle_class FROM obs WHERE label <> 'error'")
def class_map_filter(spark, sf):
    return filters.map_classes(V.observations(spark, sf), V.EVENT_CLASSES).select("row_id", "vehicle_class")


@query(f"WITH {V.OBS} SELECT row_id, score FROM obs WHERE score >= 0.5::DOUBLE")
def conf_filter(spark, sf):
    return filters.by_score(V.observations(spark, sf), 0.5).select("row_id", "score")


@query(f"WITH {V.OBS} SELECT row_id, frame FROM obs WHERE frame BETWEEN 100 AND 305")
def time_window(spark, sf):
    return filters.in_window(V.observations(spark, sf), V.FPS, V.FRAMES, 10.04, 30.55).select("row_id", "frame")


@query(f"WITH {DET}, t AS (SELECT clip_id, frame, CASE WHEN track_id % 5 = 0 THEN -1 ELSE det_ind END AS det_ind, track_id FROM det) SELECT clip_id, frame, det_ind, t.track_id, d.vehicle_class, d.score FROM t JOIN det d USING (clip_id, frame, det_ind)")
def detection_join(spark, sf):
    d = detections(spark, sf)
    none = F.when(F.col("track_id") % 5 == 0, -1).otherwise(F.col("det_ind"))  # the tracker only predicts these
    return filters.with_detection(d.select("clip_id", "frame", none.cast("int").alias("det_ind"), "track_id"), d.drop("track_id")).select("clip_id", "frame", "det_ind", "track_id", "vehicle_class", "score")


@query(f"WITH {V.OBS}, o AS (SELECT *, CASE WHEN row_id % 50 = 0 THEN 0 ELSE w END AS w2, CASE WHEN row_id % 70 = 0 THEN 1.5::DOUBLE ELSE score END AS s2 FROM obs) SELECT row_id, concat_ws(',', CASE WHEN w2 <= 0 THEN 'size' END, CASE WHEN s2 > 1 THEN 'score' END) AS faults FROM o WHERE w2 <= 0 OR s2 > 1")
def quarantined(spark, sf):
    o = V.observations(spark, sf).withColumns({"w": F.when(F.col("row_id") % 50 == 0, 0.0).otherwise(F.col("w")), "score": F.when(F.col("row_id") % 70 == 0, 1.5).otherwise(F.col("score"))})
    return filters.quarantine(o)[1].select("row_id", F.array_join("faults", ",").alias("faults"))


@query(f"WITH {V.OBS} SELECT row_id, track_id FROM obs WHERE track_id IN (SELECT track_id FROM obs GROUP BY clip_id, track_id HAVING count(*) >= 65)")
def support_gate(spark, sf):
    return filters.supported(V.observations(spark, sf), ["clip_id", "track_id"], 65).select("row_id", "track_id")


# Zones

def _flagged(spark, sf):
    return exclusion.flag_zones(V.observations(spark, sf), exclusion.zones_in_global_frame(V.zones(spark), V.anchors(spark)))


@query(f"WITH {V.PIP} SELECT row_id, inside FROM flagged")
def pip_flags(spark, sf):
    return _flagged(spark, sf).select("row_id", "inside")


@query(f"WITH {V.PIP} SELECT clip_id, track_id, count(*) FILTER (inside) AS n_inside, count(*) AS n FROM flagged GROUP BY clip_id, track_id HAVING count(*) FILTER (inside)::DOUBLE / count(*) >= 0.4::DOUBLE")
def excluded_tracks(spark, sf):
    return exclusion.excluded_tracks(_flagged(spark, sf), 0.4)


@query(f"WITH {V.PIP}, gone AS (SELECT track_id FROM flagged GROUP BY clip_id, track_id HAVING count(*) FILTER (inside)::DOUBLE / count(*) >= 0.4::DOUBLE) SELECT row_id, track_id, frame FROM obs WHERE track_id NOT IN (SELECT track_id FROM gone)")
def kept_observations(spark, sf):
    return exclusion.drop_excluded(V.observations(spark, sf), V.zones(spark), V.anchors(spark), 0.4).select("row_id", "track_id", "frame")


@query(f"WITH {V.GLOBAL_EDGES} SELECT zone_id, round(abs(sum(qx * py - px * qy)) / 2, 6) AS area, count(*)::INTEGER AS n FROM gedges GROUP BY zone_id")
def polygon_area(spark, sf):
    z = exclusion.zones_in_global_frame(V.zones(spark), V.anchors(spark))
    return z.select("zone_id", R(G.polygon_area(F.col("vertices"))).alias("area"), F.size("vertices").alias("n"))


@query("""WITH g AS (SELECT k, x, y, CASE WHEN k = 0 THEN x - 1080 ELSE x END AS x0, CASE WHEN k = 0 THEN x ELSE x + 1920 * k END AS x1, y AS y0, CASE WHEN k = 0 THEN y + 1920 ELSE y + 1080 * k END AS y1
    FROM (SELECT unnest([0.0::DOUBLE, 0.5, 1, 1.5]) AS k), (SELECT unnest(range(-2000, 2001, 250)) AS x), (SELECT unnest(range(-1200, 1201, 150)) AS y))
SELECT k, x::INTEGER AS shift_x, y::INTEGER AS shift_y, round(greatest(0, least(1920, x1) - greatest(0, x0)) * greatest(0, least(1080, y1) - greatest(0, y0)) / 2073600.0::DOUBLE, 6) AS overlap FROM g""")
def clipped_overlap(spark, sf):
    """Shifted canvases at three scales, and turned by a right angle (k = 0)."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 1.5)))).alias("k")).withColumn("shift_x", F.explode(F.sequence(F.lit(-2000), F.lit(2000), F.lit(250)))).withColumn("shift_y", F.explode(F.sequence(F.lit(-1200), F.lit(1200), F.lit(150))))
    turn = F.when(F.col("k") == 0, 1.0).otherwise(0.0)
    t = G.affine(F.col("k"), -turn, F.col("shift_x"), turn, F.col("k"), F.col("shift_y"))
    return grid.select("k", "shift_x", "shift_y", R(G.clipped_overlap(t, F.lit(1920.0), F.lit(1080.0))).alias("overlap"))


# Telemetry and timing

@query("WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN '[REL_ALT: ' || value || ' abs_alt: 99.0]' WHEN event_id % 3 = 1 THEN '[abs_alt:' || value || ']' ELSE 'no data' END AS line FROM events), a AS (SELECT CAST(coalesce(nullif(regexp_extract(line, '(?i)rel_alt\\s*:\\s*(-?\\d+(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(line, '(?i)abs_alt\\s*:\\s*(-?\\d+(?:\\.\\d+)?)', 1), '')) AS DOUBLE) AS a FROM l) SELECT round(avg(a), 6) AS altitude_m, count(a) AS n FROM a")
def srt_mean_altitude(spark, sf):
    e = V.table(spark, sf, "events")
    k, v = F.col("event_id") % 3, F.col("value").cast("string")
    lines = e.select(F.when(k == 0, F.concat(F.lit("[REL_ALT: "), v, F.lit(" abs_alt: 99.0]"))).when(k == 1, F.concat(F.lit("[abs_alt:"), v, F.lit("]"))).otherwise("no data").alias("value"))
    return calibrate.mean_altitude(lines).select(R("altitude_m").alias("altitude_m"), "n")


@query("SELECT event_id // 5 AS frame, max(value) FILTER (event_id % 5 = 0) AS s0, max(value) FILTER (event_id % 5 = 1) AS s1, max(value) FILTER (event_id % 5 = 2) AS s2, max(value) FILTER (event_id % 5 = 3) AS s3, max(value) FILTER (event_id % 5 = 4) AS s4, NULL::DOUBLE AS s9 FROM events GROUP BY 1")
def timing_pivot(spark, sf):
    t = V.table(spark, sf, "events").select(F.floor(F.col("event_id") / 5).alias("frame"), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("step"), F.col("value").alias("seconds"))
    return sidecars.timing_table(t, ["s0", "s1", "s2", "s3", "s4", "s9"])


# Tracks

@query(f"WITH {V.STATES} SELECT row_id, {r('dt', 'dt')} FROM d1")
def track_dt(spark, sf):
    obs = project.with_timestamp(V.observations(spark, sf), V.FPS)
    return project.finite_differences(obs).select("row_id", R("dt").alias("dt"))


@query(f"WITH {V.STATES} SELECT row_id, {r('hx', 'hx')}, {r('hy', 'hy')} FROM states")
def heading_locf(spark, sf):
    return V.states(spark, sf).select("row_id", R("hx").alias("hx"), R("hy").alias("hy"))


@query(f"WITH {V.STATES} SELECT clip_id, frame, vehicle_id, row_id, {r('x', 'x')}, {r('y', 'y')}, {r('length', 'length')}, {r('width', 'width')}, {r('speed', 'speed', 5)}, {r('accel', 'accel', 4)} FROM states")
def kinematic_state(spark, sf):
    s = V.states(spark, sf)
    return s.select("clip_id", "frame", "vehicle_id", "row_id", *(R(c).alias(c) for c in ("x", "y", "length", "width")), R("speed", 5).alias("speed"), R("accel", 4).alias("accel"))


@query(f"WITH {V.RECORDS} SELECT row_id, {r('front_x', 'front_x')}, {r('front_y', 'front_y')}, {r('rear_x', 'rear_x')}, {r('rear_y', 'rear_y')} FROM records")
def ssam_grid_coords(spark, sf):
    return V.records(spark, sf).select("row_id", *(R(c).alias(c) for c in ("front_x", "front_y", "rear_x", "rear_y")))


@query(f"WITH {V.STATES} SELECT row_id, {r('x', 'x')}, {r('y', 'y')}, {r('hx', 'hx')}, {r('hy', 'hy')}, {r('hx * speed', 'vx', 8)} FROM states")
def grid_inverse(spark, sf):
    s = project.from_grid(V.records(spark, sf), V.SCALE, float(V.SIZE))
    return s.select("row_id", *(R(c).alias(c) for c in ("x", "y", "hx", "hy")), R("vx", 8).alias("vx"))


@query(f"""WITH RECURSIVE {V.OBS}, steps AS (SELECT clip_id, frame, frame::DOUBLE / 10.0::DOUBLE AS ts, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS n FROM (SELECT DISTINCT clip_id, frame FROM obs)),
fold AS (
    SELECT clip_id, frame, ts, n, true AS ok, ts + 0.25::DOUBLE AS due FROM steps WHERE n = 1
    UNION ALL SELECT s.clip_id, s.frame, s.ts, s.n, s.ts >= f.due - 0.05::DOUBLE,
        CASE WHEN s.ts >= f.due - 0.05::DOUBLE THEN f.due + 0.25::DOUBLE * (floor((s.ts + 0.05::DOUBLE - f.due) / 0.25::DOUBLE) + 1) ELSE f.due END
    FROM fold f JOIN steps s ON s.clip_id = f.clip_id AND s.n = f.n + 1)
SELECT clip_id, frame, ts FROM fold WHERE ok""")
def decimated_timesteps(spark, sf):
    obs = project.with_timestamp(V.observations(spark, sf), V.FPS)
    return cadence.timesteps(obs, 0.25, V.FPS)


@query(f"""WITH RECURSIVE {V.OBS}, z AS (SELECT row_id, clip_id, track_id, cx, frame::DOUBLE / 10.0::DOUBLE AS ts, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame, row_id) AS n FROM obs),
k AS (
    SELECT row_id, clip_id, track_id, n, ts, cx AS x, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 2.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 1e6::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1e6::DOUBLE AS p22 FROM z WHERE n = 1
    UNION ALL
    SELECT u.row_id, u.clip_id, u.track_id, u.n, u.ts, px + q00 / s * y, pv + q01 / s * y, pa + q02 / s * y, q00 - q00 / s * q00, q01 - q00 / s * q01, q02 - q00 / s * q02, q11 - q01 / s * q01, q12 - q01 / s * q02, q22 - q02 / s * q02
    FROM (
        SELECT *, q00 + 4 AS s, cx - px AS y FROM (
            SELECT z.row_id, z.clip_id, z.track_id, z.n, z.ts, z.cx, k.x + d * k.v + d * d / 2 * k.a AS px, k.v + d * k.a AS pv, k.a AS pa,
                p00 + 2 * d * p01 + d * d * p02 + d * d * p11 + d * d * d * p12 + d * d * d * d / 4 * p22 + d * d * d * d * d AS q00,
                p01 + d * p02 + d * p11 + 1.5 * d * d * p12 + d * d * d / 2 * p22 + 20.0 / 8 * d * d * d * d AS q01,
                p02 + d * p12 + d * d / 2 * p22 + 20.0 / 6 * d * d * d AS q02,
                p11 + 2 * d * p12 + d * d * p22 + 20.0 / 3 * d * d * d AS q11, p12 + d * p22 + 10.0 * d * d AS q12, p22 + 20.0 * d AS q22
            FROM (SELECT k.*, z.ts - k.ts AS d FROM k JOIN z ON z.clip_id = k.clip_id AND z.track_id = k.track_id AND z.n = k.n + 1) k JOIN z ON z.clip_id = k.clip_id AND z.track_id = k.track_id AND z.n = k.n + 1)) u)
SELECT row_id, round(x, 2) + 0 AS px, round(v, 2) + 0 AS vx FROM k""")
def kalman_forward(spark, sf):
    obs = project.with_timestamp(V.observations(spark, sf), V.FPS)
    return smoothing.smooth_tracks(obs, backward=False).select("row_id", R("px", 2).alias("px"), R("vx", 2).alias("vx"))


@query()
def rts_smooth(spark, sf):
    obs = project.with_timestamp(V.observations(spark, sf), V.FPS)
    return smoothing.smooth_tracks(obs).select("row_id", "track_id", "frame", "px", "py", "vx", "vy", "ax", "ay")


@query()
def postprocess_states(spark, sf):
    from motionloom.plans import postprocess

    options = postprocess.Options(min_fraction=0.4, fps=V.FPS)
    return postprocess.to_states(V.observations(spark, sf), V.clips(spark), options, V.zones(spark), V.anchors(spark))[0]


# Checks

def _judged(spark, sf):
    return validate.judged(V.records(spark, sf), V.clips(spark), V.timesteps(spark))


@query(f"WITH {V.JUDGED} SELECT clip_id, vehicle_id, row_id, ordinal, (sum(run_start::INTEGER) OVER (PARTITION BY clip_id, vehicle_id ORDER BY ordinal, row_id))::BIGINT AS run, run_start, run_end FROM judged")
def contiguous_runs(spark, sf):
    return _judged(spark, sf).select("clip_id", "vehicle_id", "row_id", "ordinal", "run", "run_start", "run_end")


@query(f"WITH {V.JUDGED} SELECT row_id, ordinal, {r('delta', 'heading_delta', 4)} FROM judged WHERE NOT ok_heading_switch")
def heading_switches(spark, sf):
    return _judged(spark, sf).filter("NOT ok_heading_switch").select("row_id", "ordinal", R("heading_delta", 4).alias("heading_delta"))


@query(f"WITH {V.JUDGED} SELECT row_id, ok_appearance, ok_disappearance FROM judged WHERE run_start OR run_end")
def near_boundary_appearances(spark, sf):
    return _judged(spark, sf).filter("run_start OR run_end").select("row_id", "ok_appearance", "ok_disappearance")


@query(f"WITH {V.JUDGED} SELECT clip_id, count(*) FILTER (ok_speed_implausible) AS speed_ok, count(*) FILTER (ok_accel_implausible) AS accel_ok, count(*) AS n FROM judged GROUP BY clip_id")
def plausibility_counts(spark, sf):
    return _judged(spark, sf).groupBy("clip_id").agg(F.count_if("ok_speed_implausible").alias("speed_ok"), F.count_if("ok_accel_implausible").alias("accel_ok"), F.count("*").alias("n"))


_REPORT = " UNION ALL ".join(f"SELECT clip_id, '{c}' AS \"check\", count(*) FILTER (ok_{c}) AS compliant, count(ok_{c}) AS total, round(100.0::DOUBLE * count(*) FILTER (ok_{c}) / nullif(count(ok_{c}), 0), 6) AS pct FROM judged GROUP BY clip_id" for c in validate.CHECKS)


@query(f"WITH {V.JUDGED} {_REPORT}")
def compliance_report(spark, sf):
    return rounded(validate.report(_judged(spark, sf), ("clip_id",)), "pct")


_VALUES = {"appearance": "edge", "disappearance": "edge", "heading_switch": "delta", "speed_implausible": "speed", "accel_implausible": "abs(accel)"}
_VIOLATIONS = " UNION ALL ".join(f"SELECT clip_id, ordinal AS frame_index, vehicle_id, '{c}' AS \"check\", {r(v, 'value', 3)}, {r('mx', 'centroid_x', 4)}, {r(f'{V.SIZE} - my', 'centroid_y', 4)} FROM judged WHERE NOT ok_{c}" for c, v in _VALUES.items())


@query(f"WITH {V.JUDGED} {_VIOLATIONS}")
def violations_sorted(spark, sf):
    rows = validate.image_rows(validate.violations(_judged(spark, sf)))
    return rows.select("clip_id", "frame_index", "vehicle_id", "check", R("value", 3).alias("value"), R("centroid_x", 4).alias("centroid_x"), R("centroid_y", 4).alias("centroid_y"))


_MARKS = f"""{V.JUDGED}, v AS ({" UNION ALL ".join(f"SELECT clip_id, row_id, ordinal, vehicle_id, '{c}' AS chk, mx, {V.SIZE} - my AS my FROM judged WHERE NOT ok_{c}" for c in _VALUES)}),
marks AS (SELECT clip_id, ordinal AS frame, vehicle_id, string_agg(DISTINCT chk, ' / ' ORDER BY chk) AS label, max_by(mx, row_id) AS centroid_x, max_by(my, row_id) AS centroid_y FROM v WHERE chk IN ('appearance', 'speed_implausible', 'accel_implausible') GROUP BY ALL)"""


@query(f"WITH {_MARKS} SELECT clip_id, frame, vehicle_id, label, {r('centroid_x', 'centroid_x', 4)}, {r('centroid_y', 'centroid_y', 4)} FROM marks")
def violation_collapse(spark, sf):
    j = _judged(spark, sf)
    rows = validate.violations(j).join(j.select("clip_id", "ordinal", "vehicle_id", "row_id"), ["clip_id", "ordinal", "vehicle_id"])
    cx, cy = validate.centroid()
    rows = rows.select("clip_id", "row_id", "vehicle_id", "check", (F.col("ordinal") / V.FPS).alias("timestamp_s"), cx.alias("centroid_x"), (F.col("canvas_height") - cy).alias("centroid_y"))
    return rounded(overlay.collapse_violations(rows, V.FPS, ["appearance", " speed_implausible ", "accel_implausible", ""]), "centroid_x", "centroid_y", digits=4)


# Overlay

@query(f"WITH {V.STATES} SELECT row_id, len(t)::INTEGER AS n, t[1].x AS first_x, t[1].y AS first_y, (list_sum(list_transform(t, lambda p: p.x)))::BIGINT AS sum_x FROM (SELECT row_id, list({{'x': round_even(x, 0)::BIGINT, 'y': round_even(y, 0)::BIGINT}}) OVER (PARTITION BY clip_id, vehicle_id ORDER BY frame, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t FROM states)")
def trails_last_n(spark, sf):
    t = overlay.trails(V.states(spark, sf), 5)
    return t.select("row_id", F.size("trail").alias("n"), F.col("trail")[0]["x"].alias("first_x"), F.col("trail")[0]["y"].alias("first_y"), F.aggregate("trail", F.lit(0).cast("long"), lambda s, p: s + p["x"]).alias("sum_x"))


@query(f"WITH {V.STATES} SELECT clip_id, round_even(ts::FLOAT::DOUBLE * 10, 0)::BIGINT AS frame, count(*) AS n FROM states GROUP BY ALL")
def frame_states_join(spark, sf):
    s = overlay.states_on_frames(V.states(spark, sf), V.FPS)
    frames = s.select("clip_id", "frame").distinct()
    return frames.join(s, ["clip_id", "frame"]).groupBy("clip_id", "frame").agg(F.count("*").alias("n"))


@query(f"WITH {V.OBS}, {V.TRANSFORMS} SELECT f.clip_id, f.frame, {r('coalesce(a, 1)', 'a')}, {r('coalesce(tx, 0)', 'tx')} FROM (SELECT DISTINCT clip_id, frame FROM obs) f LEFT JOIN tf USING (clip_id, frame)")
def transform_left_default(spark, sf):
    f = V.observations(spark, sf).select("clip_id", "frame").distinct()
    return project.with_transform(f, V.transforms(spark)).select("clip_id", "frame", R("t.a").alias("a"), R("t.tx").alias("tx"))


_DRAW = f"""{V.STATES}, {V.TRANSFORMS}, s AS (SELECT *, round_even(ts::FLOAT::DOUBLE * 10, 0)::BIGINT AS vframe FROM states),
j AS (SELECT s.*, coalesce(a, 1) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 1) AS d, coalesce(tx, 0) AS tx, coalesce(ty, 0) AS ty FROM s LEFT JOIN tf ON tf.clip_id = s.clip_id AND tf.frame = s.vframe),
i AS (SELECT *, d / (a * d - b * c) AS ia, -b / (a * d - b * c) AS ib, -c / (a * d - b * c) AS ic, a / (a * d - b * c) AS id FROM j)"""


@query(f"""WITH {_DRAW} SELECT row_id, vframe AS frame, round_even(ia * (x / 0.5::DOUBLE) + ib * (y / 0.5::DOUBLE) - (ia * tx + ib * ty), 0)::BIGINT AS px, round_even(ic * (x / 0.5::DOUBLE) + id * (y / 0.5::DOUBLE) - (ic * tx + id * ty), 0)::BIGINT AS py,
    'v' || vehicle_id || '  ' || round_even(speed, 0)::BIGINT AS label, {r('x + hx * length / 2', 'front_x', 4)}, {r('y - hy * length / 2', 'rear_y', 4)}, least(5, row_number() OVER (PARTITION BY clip_id, vehicle_id ORDER BY vframe, row_id))::INTEGER AS trail_n,
    CASE WHEN vehicle_id % 3 = 0 AND vframe % 2 = 0 THEN 'speed' END AS mark FROM i""")
def draw_list(spark, sf):
    states = V.states(spark, sf)
    marks = overlay.states_on_frames(states, V.FPS).filter("vehicle_id % 3 = 0 AND frame % 2 = 0").select("clip_id", "frame", "vehicle_id").distinct().withColumn("label", F.lit("speed"))
    d = overlay.draw_list(states, V.transforms(spark), marks, V.FPS, V.SCALE, 5)
    return d.select("row_id", "frame", "px", "py", "label", R("front_x", 4).alias("front_x"), R("rear_y", 4).alias("rear_y"), F.size("trail").alias("trail_n"), "mark")


_CHANNEL = "trunc(255 * (0.95::DOUBLE - 0.95::DOUBLE * 0.85::DOUBLE * greatest(0, least(({n} + h * 6) % 6, 4 - ({n} + h * 6) % 6, 1))))::INTEGER"


@query(f"SELECT event_id, {_CHANNEL.format(n=1)} AS b, {_CHANNEL.format(n=3)} AS g, {_CHANNEL.format(n=5)} AS r FROM (SELECT event_id, (event_id * 0.618033988749895::DOUBLE) % 1 AS h FROM events)")
def vehicle_colour(spark, sf):
    return V.table(spark, sf, "events").select("event_id", drawing.colour(F.col("event_id")).alias("c")).select("event_id", "c.b", "c.g", "c.r")


@query("SELECT code, CASE WHEN regexp_full_match(code, '\\d+(\\.\\d+)?(:\\d+(\\.\\d+)?){0,2}') THEN round(list_reduce(list_transform(string_split(code, ':'), lambda p: p::DOUBLE), lambda a, b: a * 60 + b), 6) END AS seconds FROM (SELECT unnest(['5', '5.25', '1:30', '01:02:03.5', '1:2:3:4', 'x', '1:-2', '0:00']) AS code)")
def timecodes(spark, sf):
    codes = spark.createDataFrame([(c,) for c in ("5", "5.25", "1:30", "01:02:03.5", "1:2:3:4", "x", "1:-2", "0:00")], "code string")
    return codes.select("code", R(drawing.timecode_seconds(F.col("code"))).alias("seconds"))


@query("WITH p(frame, a, b, tx, c, d, ty) AS (VALUES " + ", ".join(f"({f}, {', '.join(f'{v}::DOUBLE' for v in p)})" for f, p in V.ANCHORS) + "), v AS (SELECT a * x + b * y + tx AS x, c * x + d * y + ty AS y FROM p, (VALUES (0, 0), (500, 0), (500, 500), (0, 500)) r(x, y)) SELECT floor(min(x))::BIGINT AS x0, floor(min(y))::BIGINT AS y0, ceil(max(x))::BIGINT AS x1, ceil(max(y))::BIGINT AS y1 FROM v")
def mosaic_bounds(spark, sf):
    return overlay.mosaic_bounds(V.anchors(spark).withColumn("clip_id", F.lit(0)), 500.0, 500.0).drop("clip_id")


# Diagnostics

@query(f"WITH {V.STATES}, t AS (SELECT clip_id, f AS frame, f / 10.0::DOUBLE AS ts FROM (SELECT unnest(range({V.FRAMES})) AS f), (SELECT unnest(range(4)) AS clip_id)) SELECT t.clip_id, t.frame, t.ts, count(s.row_id) AS active FROM t LEFT JOIN states s ON s.clip_id = t.clip_id AND s.frame = t.frame GROUP BY ALL")
def active_counts(spark, sf):
    steps = spark.range(V.FRAMES).select(F.col("id").alias("frame"), (F.col("id") / 10.0).alias("ts")).join(V.clips(spark).select("clip_id"))
    return diagnostics.active_counts(steps, V.states(spark, sf))


@query(f"WITH {V.STATES} SELECT clip_id, vehicle_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_records, round(max(ts) - min(ts), 6) AS duration FROM states GROUP BY ALL")
def track_lifespans(spark, sf):
    return rounded(diagnostics.lifespans(V.states(spark, sf)), "duration")


@query(f"WITH {V.STATES}, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, vehicle_id ORDER BY ts, x, y, speed, accel) AS a, row_number() OVER (PARTITION BY clip_id, vehicle_id ORDER BY ts DESC, x DESC, y DESC, speed DESC, accel DESC) AS b FROM states) SELECT clip_id, vehicle_id, {r('max(x) FILTER (a = 1)', 'birth_x')}, {r('max(y) FILTER (a = 1)', 'birth_y')}, {r('max(x) FILTER (b = 1)', 'death_x')}, {r('max(y) FILTER (b = 1)', 'death_y')} FROM o GROUP BY ALL")
def births_deaths(spark, sf):
    return rounded(diagnostics.births_and_deaths(V.states(spark, sf)), "birth_x", "birth_y", "death_x", "death_y")


_JERKS = f"{V.STATES}, j AS (SELECT vehicle_id, ts, (accel - lag(accel) OVER v) / nullif(ts - lag(ts) OVER v, 0) AS jerk, ts - lag(ts) OVER v AS gap, count(*) OVER (PARTITION BY clip_id, vehicle_id) AS n FROM states WINDOW v AS (PARTITION BY clip_id, vehicle_id ORDER BY ts, row_id)), jerks AS (SELECT * FROM j WHERE n >= 3 AND gap > 0)"


@query(f"WITH {_JERKS} SELECT vehicle_id, ts, {r('jerk', 'jerk', 2)} FROM jerks")
def jerk_values(spark, sf):
    return diagnostics.jerks(V.states(spark, sf)).select("vehicle_id", "ts", R("jerk", 2).alias("jerk"))


def _hist(source: str, column: str, bins: int) -> str:
    return f"e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}), c AS (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin, count(*) AS n FROM {source}, e GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS \"count\" FROM (SELECT unnest(range({bins})) AS bin) b LEFT JOIN c ON c.bin = b.bin"


@query(f"WITH {_JERKS}, v AS (SELECT round(jerk, 2) AS j FROM jerks WHERE abs(round(jerk, 2)) < 200), {_hist('v', 'j', 60)}")
def jerk_hist(spark, sf):
    j = diagnostics.jerks(V.states(spark, sf)).select(F.round("jerk", 2).alias("jerk"))
    return diagnostics.histogram(j, "jerk", 60, 200)


@query(f"WITH {V.OBS}, {_hist('obs', 'score', 40)}")
def score_hist(spark, sf):
    return diagnostics.histogram(V.observations(spark, sf), "score", 40)


@query(f"WITH {V.STATES}, l AS (SELECT round(max(ts) - min(ts), 3) AS duration FROM states GROUP BY clip_id, vehicle_id), {_hist('l', 'duration', 40)}")
def duration_hist(spark, sf):
    return diagnostics.histogram(diagnostics.lifespans(V.states(spark, sf)).select(F.round("duration", 3).alias("duration")), "duration", 40)


@query(f"WITH {V.STATES} SELECT clip_id, vehicle_id, count(*) AS n_records, min(row_id) AS first_row FROM states GROUP BY ALL ORDER BY n_records DESC, first_row LIMIT 6")
def top6_tracks(spark, sf):
    return diagnostics.longest_tracks(V.states(spark, sf))


@query(f"WITH {V.STATES}, n AS (SELECT clip_id, vehicle_id, count(*) AS n, min(row_id) AS f, max(frame) AS last FROM states GROUP BY ALL) SELECT clip_id, arg_max(vehicle_id, (CASE WHEN last >= 715 THEN 1 ELSE 0 END, n, -f)) AS vehicle_id FROM n GROUP BY clip_id")
def representative_track(spark, sf):
    s = V.states(spark, sf)
    return diagnostics.shared_longest(s.filter("frame >= 715"), s)


@query(f"WITH {V.OBS}, {V.TRANSFORMS}, g AS (SELECT * FROM tf), f AS (SELECT DISTINCT clip_id, frame FROM obs) SELECT f.clip_id, f.frame, arg_min(g.frame, (abs(g.frame - f.frame), g.row_id)) AS pose_frame, round(arg_min(g.tx, (abs(g.frame - f.frame), g.row_id)), 6) AS tx FROM f JOIN g ON g.clip_id = f.clip_id GROUP BY ALL")
def nearest_pose(spark, sf):
    near = diagnostics.nearest_pose(V.observations(spark, sf), V.transforms(spark))
    return near.select("clip_id", "frame", "pose_frame", R("tx").alias("tx"))


@query(f"WITH {V.STATES} SELECT clip_id, count(*) AS n_records, count(DISTINCT vehicle_id) AS n_tracks, min(ts) AS first_ts, max(ts) AS last_ts FROM states GROUP BY clip_id")
def run_summary(spark, sf):
    return diagnostics.summary(V.states(spark, sf))


# Matching and camera motion

@query(f"""WITH {DET}, p AS (SELECT a.clip_id, a.frame, a.det_ind, b.det_ind AS next_det, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS shared, a.w * a.h + b.w * b.h AS total
FROM det a JOIN det b ON a.clip_id = b.clip_id AND b.frame = a.frame + 1), q AS (SELECT *, shared / (total - shared) AS iou FROM p WHERE shared / (total - shared) >= 0.01::DOUBLE),
o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame, det_ind ORDER BY iou DESC, next_det) AS f, row_number() OVER (PARTITION BY clip_id, frame, next_det ORDER BY iou DESC, det_ind) AS g FROM q)
SELECT clip_id, frame, det_ind, next_det, round(iou, 6) AS iou FROM o WHERE f = 1 AND g = 1""")
def iou_links(spark, sf):
    return rounded(matching.iou_links(detections(spark, sf).select("clip_id", "frame", "det_ind", "x", "y", "w", "h"), 0.01), "iou")


@query("WITH p AS (SELECT l.vec_id, l.label, q.vec_id AS candidate, round(list_sum(list_transform(range(1, len(l.embedding) + 1), lambda i: abs(l.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 9) AS distance FROM embeddings l JOIN embeddings q ON l.label = q.label AND l.vec_id <> q.vec_id AND len(l.embedding) = len(q.embedding)), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY distance, candidate) AS n FROM p), b AS (SELECT vec_id, label, max(candidate) FILTER (n = 1) AS candidate, max(distance) FILTER (n = 1) AS distance, max(distance) FILTER (n = 2) AS second FROM o WHERE n <= 2 GROUP BY ALL) SELECT * FROM b WHERE distance < 0.8::DOUBLE * second")
def knn_ratio_match(spark, sf):
    return matching.ratio_matches(matching.nearest_two(V.table(spark, sf, "embeddings")), ["vec_id", "label"], 0.8)


def _descriptors(spark, sf, side: int):
    e = V.table(spark, sf, "events").filter(F.col("event_id") % 2 == side)
    return e.select(F.lit(0).cast("long").alias("clip_id"), F.floor(F.col("event_id") / 40).alias("pair_id"), F.col("event_id").alias("key_id"), F.array(F.col("event_id") * F.col("user_id"), F.col("event_id") * 7919).alias("descriptor"))


@query("WITH p AS (SELECT l.event_id // 40 AS pair_id, l.event_id AS left_id, q.event_id AS right_id, (bit_count(xor(l.event_id * l.user_id, q.event_id * q.user_id)) + bit_count(xor(l.event_id * 7919, q.event_id * 7919)))::INTEGER AS distance FROM events l JOIN events q ON l.event_id % 2 = 0 AND q.event_id % 2 = 1 AND l.event_id // 40 = q.event_id // 40), o AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS n FROM p), b AS (SELECT pair_id, left_id, max(right_id) FILTER (n = 1) AS right_id, max(distance) FILTER (n = 1) AS distance, max(distance) FILTER (n = 2) AS second FROM o GROUP BY ALL) SELECT 0::BIGINT AS clip_id, * FROM b WHERE distance < 0.7::DOUBLE * second")
def hamming_match(spark, sf):
    return matching.hamming_matches(_descriptors(spark, sf, 0), _descriptors(spark, sf, 1), 0.7)


@query(f"WITH {DET}, k AS (SELECT clip_id, frame, row_id, cx AS kx, cy AS ky FROM obs), b AS (SELECT clip_id, frame, floor(x - 40) AS x0, floor(y - 40) AS y0, ceil(x - 40 + w + 30) AS x1, ceil(y - 40 + h + 30) AS y1 FROM det) SELECT row_id FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.clip_id = k.clip_id AND b.frame = k.frame AND kx >= x0 AND kx < x1 AND ky >= y0 AND ky < y1)")
def keypoint_mask(spark, sf):
    k = V.observations(spark, sf).select("clip_id", "frame", "row_id", F.col("cx").alias("kx"), F.col("cy").alias("ky"))
    b = detections(spark, sf).select("clip_id", "frame", (F.col("x") - 40).alias("x"), (F.col("y") - 40).alias("y"), (F.col("w") + 30).alias("w"), (F.col("h") + 30).alias("h"))
    return egomotion.outside_vehicles(k, b).select("row_id")


@query("""WITH RECURSIVE m AS (SELECT f AS frame, f % 97 = 96 AS lost, f >= 2 AND f % 41 <> 40 AS usable, (f % 30 * 9)::DOUBLE AS mx, (f % 7)::DOUBLE AS my, greatest(0, 500 - f % 30 * 9) * greatest(0, 500 - f % 7) < 125000 AS far FROM (SELECT unnest(range(720)) AS f)),
k AS (
    SELECT -1::BIGINT AS frame, false AS started, false AS anchored, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty
    UNION ALL SELECT m.frame, started OR usable, usable AND (NOT started OR lost OR far),
        CASE WHEN started AND usable AND NOT lost AND far THEN ax + mx ELSE ax END, CASE WHEN started AND usable AND NOT lost AND far THEN ay + my ELSE ay END,
        CASE WHEN NOT started OR NOT usable THEN tx WHEN lost THEN ax ELSE ax + mx END, CASE WHEN NOT started OR NOT usable THEN ty WHEN lost THEN ay ELSE ay + my END
    FROM k JOIN m ON m.frame = k.frame + 1)
SELECT 0::BIGINT AS clip_id, frame, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, tx, ty, anchored FROM k WHERE frame >= 0""")
def anchor_chain(spark, sf):
    f = F.col("frame")
    m = spark.range(V.FRAMES).select(F.lit(0).cast("long").alias("clip_id"), F.col("id").alias("frame"))
    m = m.select("clip_id", "frame", ((f >= 2) & (f % 41 != 40)).alias("usable"), F.when(f % 97 != 96, 1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), (f % 30 * 9).cast("double").alias("tx"), (f % 7).cast("double").alias("ty"))
    return egomotion.chain_poses(m, 500.0, 500.0, 0.5)


@query()
def camera_fit(spark, sf):
    obs = V.observations(spark, sf)
    t = project.with_transform(obs, V.transforms(spark))
    x, y = G.apply(F.col("t"), F.col("cx"), F.col("cy"))
    return egomotion.fit_motions(t.select("clip_id", "frame", F.col("cx").alias("x0"), F.col("cy").alias("y0"), x.alias("x1"), y.alias("y1")), 2.0, 4)


@query()
def associated_tracks(spark, sf):
    return matching.associate(detections(spark, sf), 0.01)


@query(f"WITH {V.OBS} SELECT row_id, true AS close FROM obs")
def homography_world(spark, sf):
    """World points by a fitted homography lie within a millimetre of those by the one it was fitted to."""
    image = [(0.0, 0.0), (500.0, 0.0), (500.0, 500.0), (0.0, 500.0)]
    h = calibrate.fit_homography(image, [tuple(p) for p in calibrate.project(np.array(V.HOMOGRAPHY).reshape(3, 3), np.array(image))])
    obs = V.observations(spark, sf)
    exact = project.homography_point(V.HOMOGRAPHY, F.col("cx"), F.col("cy"))
    fitted = project.homography_point(h.ravel().tolist(), F.col("cx"), F.col("cy"))
    return obs.select("row_id", (F.hypot(exact[0] - fitted[0], exact[1] - fitted[1]) < 1e-3).alias("close"))


def _trj_rows(spark, sf):
    from motionloom.plans import postprocess

    return V.states(spark, sf), V.clips(spark), postprocess


@query(f"WITH {V.RECORDS} SELECT clip_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS ordinal, vehicle_id, round(front_x::FLOAT::DOUBLE, 2) AS front_x, round(front_y::FLOAT::DOUBLE, 2) AS front_y, round(length::FLOAT::DOUBLE, 2) AS length, round(ts::FLOAT::DOUBLE, 4) AS ts FROM records")
def trj_roundtrip(spark, sf):
    """Pack each clip's file and parse it again."""
    from motionloom.sources import trj
    from motionloom.sources.tracks import first_rows

    states, clips, post = _trj_rows(spark, sf)
    rows = first_rows(states.withColumnRenamed("vehicle_id", "track_id")).withColumnRenamed("track_id", "vehicle_id")
    files = trj.packed(post.to_records(rows, clips), clips)

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for clip, data in zip(frame["clip_id"], frame["data"], strict=True):
                got = [x for x in trj.rows_of(bytes(data), str(clip), "strict") if x[1] == "vehicle"]
                yield pd.DataFrame([(clip, x[2], x[3], x[5], x[8], x[9], x[12]) for x in got], columns=["clip_id", "ordinal", "ts", "vehicle_id", "front_x", "front_y", "length"])

    out = files.mapInPandas(parse, "clip_id long, ordinal long, ts double, vehicle_id long, front_x double, front_y double, length double")
    return out.select("clip_id", "ordinal", "vehicle_id", *(R(c, 2).alias(c) for c in ("front_x", "front_y", "length")), R("ts", 4).alias("ts"))
