import json
import struct

import pytest
from pyspark.sql import functions as F

from motionloom.plans import config, postprocess, timing
from motionloom.schema import CLIPS, OBSERVATIONS
from motionloom.sources import frames, sidecars, tracks, trj


def make(spark, n=6):
    return spark.createDataFrame([(0, i, i // 2, i % 2, 10.0 * (i // 2) + 20, 40.0 + i % 2 * 30, 4.0, 2.0, "car", 0.5) for i in range(n * 2)], OBSERVATIONS)


def test_track_record_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    tracks.write_tracks(make(spark), path, 30.0, 1920, 1080, 900, 0.05)
    got, clips = tracks.read_tracks(spark, path)
    assert got.count() == 12 and tuple(clips.first()) == (0, 1920, 1080, 30.0, 900, 0.05)
    assert tracks.read_scores(spark, path).columns == ["score"]
    single = str(tmp_path / "one.parquet")
    tracks.write_single_record(make(spark), single, {"fps": 30.0, "width": 5, "height": 6, "total_frames": 7, "meters_per_pixel": 0.1}, row_group=5)
    got, clips = tracks.read_tracks(spark, single)
    assert got.count() == 12 and clips.first()["height"] == 6
    tracks.write_tracks(make(spark).limit(0), str(tmp_path / "empty.parquet"), 30.0, 2, 2, 0, 1.0)
    assert tracks.read_tracks(spark, str(tmp_path / "empty.parquet"))[0].count() == 0
    make(spark).select("frame", "track_id", "cx", "cy", "w", "h", "vehicle_class", "score").write.parquet(str(tmp_path / "bare.parquet"))
    with pytest.raises(ValueError, match="lacks"):
        tracks.read_tracks(spark, str(tmp_path / "bare.parquet"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tracks.write_tracks(make(spark), path, 30.0, 1920, 1080, 900, 0.05)


def test_trj_bytes():
    assert [len(x) for x in (trj.pack_header(0.5, 100, 50)[:6], trj.pack_header(0.5, 100, 50)[6:], trj.pack_timestep(1.0), trj.pack_vehicle((42, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)))] == [6, 22, 5, 42]
    assert trj.pack_header(1, 1, 1)[1:2] == b"L"
    with pytest.raises(ValueError):
        trj.pack_header(0, 1, 1)
    body = trj.pack_header(0.5, 100, 50) + trj.pack_timestep(0.5) + trj.pack_vehicle((42, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8))
    rows = list(trj.rows_of(body, "p", "strict"))
    assert [r[1] for r in rows] == ["header", "timestep", "vehicle"] and rows[2][5] == 42 and rows[2][-1] == pytest.approx(1.04)
    for bad, message in ((body + b"\x09", "unknown record"), (body[:-3], "cut short"), (b"", "empty"), (trj.pack_header(1, 1, 1) + trj.pack_vehicle((1,) * 11), "before TIMESTEP")):
        with pytest.raises(ValueError, match=message):
            list(trj.parse(bad))
    assert len(list(trj.parse(body + b"\x09rest", "lenient"))) == 3
    big = struct.pack(">BBfB", 0, ord("B"), 3.0, 1) + struct.pack(">BBfiiii", 1, 1, 1.0, 0, 0, 10, 10) + struct.pack(">Bf", 2, 1.5) + struct.pack(">BiiBffffffff8s", 3, 7, 0, 0, *[1.0] * 8, b"")
    got = list(trj.parse(big, "tolerant"))
    assert got[1][1] == (1.5,) and got[2][1][0] == 7


def test_export_and_read_back(spark, tmp_path):
    clips = spark.createDataFrame([(0, 200, 200, 10.0, 6, 0.5)], CLIPS)
    options = postprocess.Options(fps=10.0)
    states, clips = postprocess.to_states(make(spark), clips, options)
    folder = str(tmp_path / "out")
    done = postprocess.export(states, clips, folder, options).collect()
    assert done[0]["bytes"] == 28 + 6 * 5 + 12 * 42
    got = trj.vehicles(trj.read_trj(spark, folder))
    assert got.count() == 12 and got.select("ordinal").distinct().count() == 6
    r = got.filter("vehicle_id = 0 AND ordinal = 3").first()
    assert (r.front_x + r.rear_x) / 2 == pytest.approx(50, abs=1) and r.length == 2.0
    with pytest.raises(Exception, match="FileExists"):
        postprocess.export(states, clips, folder, options).collect()
    thin = postprocess.export(states, clips, folder, postprocess.Options(fps=10.0, timestep=0.2), force=True).collect()
    assert thin[0]["bytes"] == 28 + 3 * 5 + 6 * 42


def test_world_mode_plan(spark):
    corners = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]
    points = spark.createDataFrame([(0, p, (p[0] / 2, p[1] / 2)) for p in corners], "reference_frame int, image struct<x:double,y:double>, world struct<x:double,y:double>")
    clips = spark.createDataFrame([(0, 200, 200, 10.0, 6, 0.5)], CLIPS)
    states, canvas = postprocess.to_states(make(spark), clips, postprocess.Options(fps=10.0, pos_noise=0.1), correspondences=points)
    xs = [r.x for r in states.filter("vehicle_id = 0").orderBy("frame").collect()]
    assert xs[5] - xs[4] == pytest.approx(5, abs=0.2) and canvas.first()["scale"] == 1.0


def test_sidecars(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    square = [[0, 0], [1, 0], [1, 1]]
    z = sidecars.read_zones(spark, put("z.json", {"exclusion_zones": [{"label": "a", "vertices": square}]})).first()
    assert z["reference_frame"] == 0 and z["vertices"][1]["x"] == 1.0
    assert sidecars.read_zones(spark, put("e.json", {"exclusion_zones": []})).count() == 0
    for bad in ({"exclusion_zones": [{"vertices": square[:2]}]}, {"exclusion_zones": [{"vertices": [[True, 0], *square]}]}, {"exclusion_zones": [{"vertices": square, "reference_frame": -1}]}, {"exclusion_zones": [{"vertices": [[0], *square]}]}, {}, "{"):
        with pytest.raises(ValueError):
            sidecars.read_zones(spark, put("bad.json", bad))
    c = {"correspondences": [{"image": p, "world": p} for p in [*square, [0, 1]]]}
    assert sidecars.read_calibration(spark, put("c.json", c)).count() == 4
    with pytest.raises(ValueError, match="at least 4"):
        sidecars.read_calibration(spark, put("c3.json", {"correspondences": c["correspondences"][:3]}))
    pose = {"a": 1, "b": 0, "tx": 2, "c": 0, "d": 1, "ty": 3}
    path = put("m.json", {"video": "v", "reference_frames": [{"frame_index": f, "image": f"frame_{f}.png", "pose": pose} for f in (5, 12)]})
    anchors = sidecars.read_anchors(spark, path)
    sidecars.write_anchors(anchors, str(tmp_path / "again.json"), "v")
    assert sorted(r["frame"] for r in sidecars.read_anchors(spark, str(tmp_path / "again.json")).collect()) == [5, 12]
    t = sidecars.read_transforms(spark, put("t.csv", "frame,a,b,c,d,tx,ty\n0,1,0,0,1,0,0\n1,1,2,3,4,5,6\n"))
    assert t.filter("frame = 1").first()["ty"] == 6.0
    sidecars.write_transforms(t, str(tmp_path / "t2"))
    assert sidecars.read_transforms(spark, str(tmp_path / "t2")).count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        sidecars.read_transforms(spark, put("tb.csv", "frame,a,b,c,d,tx,ty\nx,1,0,0,1,0,0\n")).collect()
    with pytest.raises(ValueError, match="lacks"):
        sidecars.read_violations(spark, put("v.csv", "timestamp_s,vehicle_id\n1,2\n"))
    assert sidecars.read_telemetry(spark, put("s.srt", "1\n[rel_alt: 50.0]\nabs_alt: 88.5\n")).agg(F.sum("altitude_m")).first()[0] == 138.5


def test_discovery(spark, tmp_path):
    for n in ("a.trj", "a_smooth.trj", "a.parquet", "a_transforms.csv", "b.trj"):
        (tmp_path / n).write_bytes(b"x")
    got = {r["stem"]: r for r in sidecars.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["smooth"].endswith("a_smooth.trj") and got["b"]["record"] is None


class FakeVideo:
    fps, width, height, total_frames = 10.0, 4, 3, 40

    def __init__(self, path):
        self.path = path

    def read(self, frame):
        return bytes([frame]) * 36


def test_video_source(spark):
    import sys

    sys.modules.setdefault("tests.test_sources", sys.modules[__name__])
    name = f"{FakeVideo.__module__}:FakeVideo"
    reader = frames.FrameReader({"path": "v", "decoder": name, "startseconds": "0.3", "endseconds": "2.0", "processfps": "5", "framesperpartition": "4"})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in got] == list(range(3, 21, 2)) and got[0][5] == bytes([3]) * 36
    assert frames.probe(spark, "v", name).first()["total_frames"] == 40


GOOD = {
    "input": {"video": "v.mp4", "process_fps": 0.0}, "detector": {"name": "rt_detr", "checkpoint": "c", "conf": 0.3, "filename": ""}, "runtime": {"device": "cuda:0"},
    "calibration": {"drone_model": "Mavic_3", "altitude_m": 50}, "ego_motion": {"enabled": False}, "tracker": {"det_thresh": 0.1},
    "export": {"out": "t.parquet", "transform_csv": "", "anchors_dir": ""}, "window": {"start": "00:10", "end": ""}, "run": {"timing_csv": ""},
}


def problems_of(**sections):
    try:
        config.resolve({**GOOD, **sections})
    except config.SettingsError as e:
        return e.problems
    return []


def test_settings(tmp_path):
    s = config.resolve(GOOD)
    assert s.get("window.start") == 10 and s.get("window.end") is None and s.get("run.timing_csv") is None
    assert s.scale(1920) == pytest.approx(0.0367, abs=1e-4)
    assert config.static_problems(s) == ["input.video: v.mp4 isn't a file"]
    assert config.resolve(GOOD, {"detector.conf": 0.5, "input.video": None}).get("detector.conf") == 0.5
    assert len(problems_of(detector={"name": "x", "checkpoint": "", "conf": 2, "filename": 3}, runtime={"device": "tpu"}, calibration={})) == 6
    assert len(problems_of(ego_motion={"enabled": True})) == 5 and len(problems_of(ego_motion={"enabled": 1})) == 1
    assert problems_of(export={**GOOD["export"], "anchors_dir": "a"}) == ["export.anchors_dir needs ego_motion.enabled"]
    assert problems_of(window={"start": "20", "end": "10"}) and problems_of(window={"start": "x", "end": ""}) and problems_of(input={"video": "v", "process_fps": -1})
    assert problems_of(calibration={"drone_model": "mavic_3", "srt": "s"}) == [] and problems_of(calibration={"meters_per_pixel": 0.05}) == []
    assert len(problems_of(calibration={"meters_per_pixel": 0.05, "drone_model": "mavic_3"})) == 1 and len(problems_of(calibration={"meters_per_pixel": -1})) == 1
    missing = []
    try:
        config.resolve({})
    except config.SettingsError as e:
        missing = e.problems
    assert len(missing) == len(config.REQUIRED) + 1
    same = config.resolve({**GOOD, "run": {"timing_csv": "t.parquet"}})
    assert config.static_problems(same)[1:] == ["run.timing_csv must differ from export.out"]
    with pytest.raises(ValueError):
        config.timecode("1:2:3:4")
    (tmp_path / "s.toml").write_text("[input]\nvideo = 'x'\n")
    assert sidecars.read_settings(str(tmp_path / "s.toml"))["input"]["video"] == "x"
    (tmp_path / "b.toml").write_text("[input")
    with pytest.raises(ValueError):
        sidecars.read_settings(str(tmp_path / "b.toml"))


def test_stopwatch(spark):
    ticks = iter(range(100))
    w = timing.Stopwatch(lambda: float(next(ticks)))
    assert w.time("read", lambda: 3) == 3
    w.time("read", lambda: 4)
    w.time("track", lambda: 5)
    wide = {r["frame"]: r for r in sidecars.timing_table(w.frame(spark), ["read", "track", "detect"]).collect()}
    assert wide[0]["track"] == 1.0 and wide[1]["track"] is None and wide[1]["detect"] is None
