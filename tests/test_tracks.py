import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.operators import cadence, calibrate, egomotion, exclusion, filters, matching, project, smoothing, validate
from motionloom.schema import CLIPS

OBS = "clip_id long, row_id long, frame long, track_id long, cx double, cy double, w double, h double, vehicle_class string, score double"


def obs(spark, rows):
    return spark.createDataFrame([(0, i, f, t, float(x), float(y), w, h, "car", 0.9) for i, (f, t, x, y, w, h) in enumerate(rows)], OBS)


def test_smoother_recovers_motion():
    t = np.arange(40) / 10
    s = smoothing.filter_and_smooth(np.c_[5 + t + t**2, 0 * t], t, 0.5, 1e-3)
    assert s[25, 0, 0] == pytest.approx(5 + t[25] + t[25] ** 2, abs=0.1)
    assert s[25, 1, 0] == pytest.approx(1 + 2 * t[25], abs=0.2) and s[25, 2, 0] == pytest.approx(2, abs=0.2)
    t = np.arange(120) / 10
    z = 3 * t + np.random.default_rng(0).normal(0, 1, 120)
    s = smoothing.filter_and_smooth(z[:, None], t, 1.0, 0.1)
    assert np.std(s[:, 0, 0] - 3 * t) < np.std(z - 3 * t)
    assert len(smoothing.filter_and_smooth(np.empty((0, 2)), np.empty(0), 1, 1)) == 0
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            smoothing.filter_and_smooth(np.zeros((1, 2)), np.zeros(1), *bad)
    with pytest.raises(ValueError):
        smoothing.filter_and_smooth(np.zeros((2, 2)), np.zeros(1), 1, 1)


def test_states_of_moving_and_standing_tracks(spark):
    rows = [(f, 1, f, 50, 4.0, 2.0) for f in range(30)] + [(f, 2, 20, 20, 2.0, 4.0) for f in range(10)]
    samples = smoothing.smooth_tracks(project.with_timestamp(obs(spark, rows), 10.0), 0.5, 1.0)
    got = {(r.vehicle_id, r.frame): r for r in project.kinematic_states(samples, 0.5).collect()}
    r = got[1, 15]
    assert r.x == pytest.approx(7.5, abs=0.3) and (r.length, r.width) == (2.0, 1.0) and r.hx > 0.9
    assert (got[2, 9].hx, got[2, 9].hy) == (0.0, 1.0) and got[2, 9].accel == 0


def test_exclusion_by_fraction(spark):
    inside, outside = (10, 10), (300, 300)
    rows = [(f, 1, *(inside if f < 2 else outside), 2.0, 2.0) for f in range(3)] + [(f, 2, *(inside if f < 1 else outside), 2.0, 2.0) for f in range(3)] + [(f, 3, *(inside if f < 1 else outside), 2.0, 2.0) for f in range(2)]
    zones = spark.createDataFrame([(0, 0, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)])], "zone_id int, reference_frame long, vertices array<struct<x:double,y:double>>")
    kept = exclusion.drop_excluded(obs(spark, rows), zones, None, 0.5)
    assert {r.track_id for r in kept.collect()} == {2}
    anchors = spark.createDataFrame([(5, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))], "frame long, pose struct<a:double,b:double,tx:double,c:double,d:double,ty:double>")
    with pytest.raises(Exception, match="no anchor"):
        exclusion.drop_excluded(obs(spark, rows), zones, anchors, 0.5).collect()
    with pytest.raises(ValueError):
        exclusion.excluded_tracks(obs(spark, rows), 0.0)


@pytest.mark.parametrize(("fps", "interval", "kept"), [(10, 0.2, [0, 2, 4, 6, 8]), (10, 0.05, list(range(10))), (30, 0.1, [0, 3, 6, 9])])
def test_cadence_grid(fps, interval, kept):
    assert [i for i, ok in enumerate(cadence.accepted((i / fps for i in range(10)), interval, fps)) if ok] == kept


def test_cadence_on_a_table(spark):
    df = spark.createDataFrame([(c, f, 10 + f / 10) for c in (0, 1) for f in range(10)], "clip_id long, frame long, ts double")
    assert sorted({r.frame for r in cadence.decimate(df, 0.2, 10).collect()}) == [0, 2, 4, 6, 8]
    assert cadence.decimate(df, 0, 10) is df
    assert {r.n_timesteps for r in cadence.count_accepted(df, 0.25, 10).collect()} == {4}
    with pytest.raises(ValueError):
        cadence.Grid(0, 10)


def test_windows():
    assert filters.window_bounds(10, 100, 0.3, 0.6) == (3, 6)
    assert filters.window_bounds(10, 50, None, 99) == (0, 49)
    assert filters.window_bounds(10, 0, 1, None) == (10, None)
    for args in ((10, 50, 6, None), (10, 50, 3, 2), (10, 50, -1, None)):
        with pytest.raises(ValueError):
            filters.window_bounds(*args)


def test_homographies(spark):
    image = [(0, 0), (100, 0), (100, 100), (0, 100)]
    h = calibrate.fit_homography(image, [(x / 2, y / 2) for x, y in image])
    assert calibrate.project(h, np.array([[40.0, 60.0]]))[0] == pytest.approx((20, 30))
    assert calibrate.local_scale(h, (50, 50)) == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, (20, 2))
    q = p * 0.5
    q[:4] += 40
    assert calibrate.project(calibrate.fit_homography(p, q, 0.5), p[10:]) == pytest.approx(p[10:] * 0.5, abs=1e-3)
    with pytest.raises(ValueError):
        calibrate.fit_homography(image[:3], image[:3])
    point = lambda h, x, y: spark.range(1).select(*project.homography_point(h, F.lit(x), F.lit(y))).first()
    assert tuple(point((1, 0, 0, 0, 1, 0, 0, 0.1, 1), 2.0, 10.0)) == (1, 5)
    with pytest.raises(Exception, match="horizon"):
        point((1, 0, 0, 0, 1, 0, 0, 1, -5), 0.0, 5.0)


def test_world_mode(spark):
    rows = [(f, 1, 10 * f + 20, 40, 4.0, 2.0) for f in range(6)]
    moved, canvas = project.normalize_world(project.to_world(obs(spark, rows), (0.5, 0, 0, 0, 0.5, 0, 0, 0, 1)))
    xs = [r.cx for r in moved.orderBy("frame").collect()]
    assert np.diff(xs) == pytest.approx([5.0] * 5) and xs[0] == pytest.approx(2.0)
    c = canvas.first()
    assert c["width"] == 29 and c["height"] == 4 and c["scale"] == 1.0


def test_ground_sample_distance(spark):
    v = spark.range(1).select(calibrate.ground_sample_distance(*(F.lit(x) for x in (17.3, 50.0, 12.29, 1920.0)))).first()[0]
    assert v == pytest.approx(0.03666, abs=1e-4)
    assert calibrate.resolve_scale(1920, model="MAVIC_3", altitude_m=50) == pytest.approx(v)
    with pytest.raises(KeyError, match="mavic_3"):
        calibrate.lookup("kite")
    lines = spark.createDataFrame([("[rel_alt: 50.0 abs_alt: 90]",), ("[REL_ALT: 51]",), ("rel_alt:49.0",), ("none",)], "value string")
    assert tuple(calibrate.mean_altitude(lines).first()) == (50.0, 3)


def test_stabilize(spark):
    d = spark.createDataFrame([(0, 3, 0, 0.0, 0.0, 4.0, 2.0)], "clip_id long, frame long, det_ind int, x double, y double, w double, h double")
    t = spark.createDataFrame([(0, 3, 2.0, 0.0, 0.0, 2.0, 10.0, -5.0)], "clip_id long, frame long, a double, b double, c double, d double, tx double, ty double")
    r = project.stabilize(d, t).first()
    assert (r.x, r.y, r.w, r.h) == (10.0, -5.0, 8.0, 4.0)
    assert project.stabilize(d.withColumn("frame", F.lit(9)), t).first()["x"] == 0.0


def record(clip, frame, vid, x, y, heading=0.0, speed=1.0, accel=0.0):
    dx, dy = 2 * np.cos(heading), 2 * np.sin(heading)
    return clip, frame, frame / 10, vid, frame * 100 + vid, float(x + dx), float(y + dy), float(x - dx), float(y - dy), 4.0, 2.0, float(speed), float(accel)


def test_validator(spark):
    rows = [record(0, f, 1, 250, 250) for f in range(6)]
    rows += [record(0, f, 2, 250, 250, heading=0 if f < 3 else 1, speed=30 if f == 2 else 5) for f in (2, 3)]  # appears and ends inside
    rows += [record(0, f, 3, 5, 250, accel=-9) for f in (1, 3)]  # at the edge, with a gap
    r = spark.createDataFrame(rows, "clip_id long, frame long, ts double, vehicle_id long, row_id long, front_x double, front_y double, rear_x double, rear_y double, length double, width double, speed double, accel double")
    clips = spark.createDataFrame([(0, 500, 500, 10.0, 6, 1.0)], CLIPS)
    j = validate.judged(r, clips).cache()
    report = {c["check"]: (c["compliant"], c["total"]) for c in validate.report(j).collect()}
    assert report == {"appearance": (3, 4), "disappearance": (3, 4), "heading_switch": (6, 7), "speed_implausible": (9, 10), "accel_implausible": (8, 10)}
    v = [(x.frame_index, x.vehicle_id, x.check) for x in validate.image_rows(validate.violations(j)).collect()]
    assert v == sorted(v) and len(v) == 6
    assert not validate.gate(validate.report(j), 99) and validate.gate(validate.report(j), 50)
    assert [x["pct"] for x in validate.report(j.limit(0)).collect()] == [None] * 5


def test_anchor_chain():
    eye = lambda x: (True, np.array([[1, 0, x], [0, 1, 0]], float))
    lost, blank = (True, None), (False, None)

    def run(*steps):
        return [(float(p[0, 2]), again) for p, again in egomotion.chained(steps, 100, 100, 0.5)]

    assert run(eye(0), eye(1)) == [(0, True), (1, False)]
    assert run(eye(0), eye(70), eye(10)) == [(0, True), (70, True), (80, False)]
    assert run(eye(0), eye(5), lost) == [(0, True), (5, False), (0, True)]  # the old anchor's pose
    assert run(eye(0), eye(20), lost, eye(5)) == [(0, True), (20, False), (0, True), (5, False)]
    assert run(eye(0), eye(70), eye(10), lost) == [(0, True), (70, True), (80, False), (70, True)]
    assert run(blank, blank, eye(9), eye(4), blank, eye(6)) == [(0, False), (0, False), (0, True), (4, False), (4, False), (6, False)]


def test_fit_similarity():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 200, (60, 2))
    q = p + (-7, 4)
    q[:15] += rng.uniform(20, 50, (15, 2))
    m = egomotion.fit_similarity(p, q, 2.0, 10)
    assert m[:, 2] == pytest.approx((-7, 4), abs=1e-6)
    assert egomotion.fit_similarity(p[:5], q[:5], 2.0, 10) is None


def test_association_keeps_ids(spark):
    rows = [(0, f, i, 10.0 + 2 * f + 100 * i, 50.0, 20.0, 10.0) for f in range(8) for i in range(3) if (f, i) != (4, 1)]
    rows = [(c, f, k, x, y, w, h) for (c, f, i, x, y, w, h), k in zip(rows, range(len(rows)), strict=True)]
    d = spark.createDataFrame(rows, "clip_id long, frame long, det_ind int, x double, y double, w double, h double")
    ids = {r.track_id for r in matching.associate(d, 0.3).collect()}
    assert ids == {0, 1, 2}


@pytest.mark.parametrize("block", [8, 1024])
def test_two_nearest_over_all_components(spark, block):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(6, 64)) * 4
    v = np.float32(spots[rng.integers(0, 6, 120)] + rng.normal(size=(120, 64)))
    v[:, :8] = 0.5  # a prefix can't tell them apart
    v[10:15], v[30] = v[9], v[31]
    rows = [(i, v[i].tolist(), i % 2) for i in range(120)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 64, 1), (203, v[0].tolist(), None), (204, [1.0], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = {}
    for i in range(120):
        near = sorted((round(float(np.abs(v[i].astype(float) - v[j]).sum()), 9), j) for j in range(i % 2, 120, 2) if j != i)
        want[i] = near
    near = matching.nearest_two(e, block)
    got = {}
    for r in matching.ratio_matches(near, ["vec_id", "label"], 0.95).collect():
        got[r.vec_id] = (r.candidate, pytest.approx(r.distance, abs=1e-8))
    assert got == {i: (n[0][1], n[0][0]) for i, n in want.items() if n[0][0] < 0.95 * n[1][0]} and got


def test_tracks_smoothed_together(spark):
    """Whatever tracks share a step or a batch, each has the states it has alone."""
    rng = np.random.default_rng(5)
    rows = []
    for track in range(23):
        for f in np.sort(rng.choice(200, rng.integers(1, 60), replace=False)).tolist():
            rows.append((track % 3, len(rows), f, f / 10, track, 4.0, 2.0, float(rng.normal(f, 2)), float(rng.normal(50, 1))))
    obs = spark.createDataFrame(rows, "clip_id long, row_id long, frame long, ts double, track_id long, w double, h double, cx double, cy double")
    for together, backward in ((1, True), (100, True), (50_000, False)):
        got = {r["row_id"]: r for r in smoothing.smooth_tracks(obs, 2.0, 20.0, backward, together).collect()}
        assert len(got) == len(rows)
        for track in range(23):
            own = [r for r in rows if r[4] == track]
            want = _one_by_one(np.array([r[7:] for r in own]), np.array([r[3] for r in own]), backward)
            for r, s in zip(own, want, strict=True):
                g = got[r[1]]
                assert [g["px"], g["py"], g["vx"], g["vy"], g["ax"], g["ay"]] == pytest.approx(s.ravel().tolist(), rel=1e-6, abs=1e-6)


def _one_by_one(z, ts, backward):
    """The textbook filter of one track, and the backward pass as the least-squares solution by information matrices."""
    f = lambda d: np.array([[1, d, d * d / 2], [0, 1, d], [0, 0, 1]])
    q = lambda d: 20.0 * np.array([[d**5 / 20, d**4 / 8, d**3 / 6], [d**4 / 8, d**3 / 3, d**2 / 2], [d**3 / 6, d**2 / 2, d]])
    p, x, out, seen = np.diag([4.0, 1e6, 1e6]), np.zeros((3, 2)), [], []
    x[0] = z[0]
    for k in range(len(z)):
        if k:
            d = ts[k] - ts[k - 1]
            x, p = f(d) @ x, f(d) @ p @ f(d).T + q(d)
        before = x, p
        s = p[0, 0] + 4.0
        x, p = x + np.outer(p[:, 0] / s, z[k] - x[0]), p - np.outer(p[:, 0], p[0]) / s
        seen.append((before, (x, p)))
        out.append(x)
    if backward:
        for k in range(len(z) - 2, -1, -1):
            (mx, mp), (x, p) = seen[k + 1][0], seen[k][1]
            out[k] = x + np.linalg.solve(mp, f(ts[k + 1] - ts[k]) @ p).T @ (out[k + 1] - mx)
    return out


def test_empty_timesteps_end_runs(spark):
    rows = [(0, f, f / 10, 7, f, 250.0, 250.0, 240.0, 250.0, 4.0, 2.0, 5.0, 0.0) for f in (0, 2, 3)]
    r = spark.createDataFrame(rows, "clip_id long, frame long, ts double, vehicle_id long, row_id long, front_x double, front_y double, rear_x double, rear_y double, length double, width double, speed double, accel double")
    clips = spark.createDataFrame([(0, 500, 500, 10.0, 6, 1.0)], CLIPS)
    every = spark.createDataFrame([(0, f) for f in range(6)], "clip_id long, frame long")
    count = lambda j: {c["check"]: (c["compliant"], c["total"]) for c in validate.report(j).collect()}
    assert count(validate.judged(r, clips))["appearance"] == (1, 1)  # frame 1 is no timestep of the records
    got = count(validate.judged(r, clips, every))
    assert got["appearance"] == (1, 2) and got["disappearance"] == (0, 2)  # nor is frame 3 the last one


def test_many_zones_by_cells(spark):
    rng = np.random.default_rng(3)
    zones = []
    for i in range(300):
        c, size = rng.uniform(0, 1000, 2), 10 ** rng.uniform(0, 2.7)
        zones.append((i, [tuple(map(float, c + size * rng.uniform(-1, 1, 2))) for _ in range(rng.integers(2, 7))]))
    z = spark.createDataFrame(zones, "zone_id long, vertices array<struct<x:double,y:double>>")
    obs = spark.createDataFrame([(i, *map(float, rng.uniform(-50, 1050, 2))) for i in range(2000)] + [(5000, None, 1.0)], "row_id long, cx double, cy double")
    want = {r["row_id"]: r["inside"] for r in exclusion.flag_inside(obs, [v for _, v in zones[:100]]).collect()}
    got = {r["row_id"]: r["inside"] for r in exclusion.flag_zones(obs, z.filter("zone_id < 100")).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert exclusion.flag_zones(obs, z).count() == len(want)
