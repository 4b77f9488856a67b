"""The commands from a video to a report, with a small array video and a stub detector."""

import json
import sys
import zlib

import numpy as np
import pytest

from motionloom.__main__ import main
from motionloom.operators import egomotion, features, tracking
from motionloom.sources import images, tracks, trj

DETECTOR = '''
import numpy as np

class Bright:
    """Finds the two bright boxes of the test video."""

    def __init__(self, conf, **rest):
        assert rest["name"] == "rt_detr" and conf == 0.3

    def detect(self, pixels):
        for value, name in ((250, "car"), (240, "truck"), (230, "tree")):
            y, x = np.nonzero(pixels[..., 0] == value)
            if len(x) > 20:
                yield x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, 0.4 if name == "car" else 0.9, name
'''


def scene(n=24, width=160, height=120, speed=2, pan=1, vehicles=True):
    """A textured ground that moves by ``pan`` pixels a frame, and two vehicles of their own speeds."""
    ground = np.random.default_rng(1).integers(0, 200, (height // 4 + 1, width // 4 + n, 1)).repeat(4, 0).repeat(4, 1).astype(np.uint8)
    out = []
    for f in range(n):
        frame = ground[:height, f * pan : f * pan + width].repeat(3, 2).copy()
        if vehicles:
            frame[30:40, 20 + speed * f : 40 + speed * f] = 250
            frame[80:92, 110 - speed * f : 134 - speed * f] = 240
        out.append(frame)
    return np.array(out)


def settings(folder, **changes):
    base = {
        "input": {"video": f"{folder}/v.npz", "process_fps": 0.0}, "detector": {"name": "rt_detr", "checkpoint": "c", "conf": 0.3, "filename": ""}, "runtime": {"device": "cpu"},
        "calibration": {"meters_per_pixel": 0.5}, "ego_motion": {"enabled": True, "n_features": 300, "match_ratio": 0.8, "min_matches": 10, "ransac_threshold": 3.0, "min_anchor_overlap": 0.9},
        "tracker": {"det_thresh": 0.1}, "export": {"out": f"{folder}/out/record.parquet", "transform_csv": f"{folder}/out/t.csv", "anchors_dir": f"{folder}/out/anchors"},
        "window": {"start": "", "end": ""}, "run": {"timing_csv": f"{folder}/out/time.csv"},
    }
    lines = []
    for section, values in {**base, **changes}.items():
        lines += [f"[{section}]", *(f"{k} = {json.dumps(v)}" for k, v in values.items())]
    (folder / "run.toml").write_text("\n".join(lines))
    return str(folder / "run.toml")


@pytest.fixture
def seams(spark, tmp_path):
    (tmp_path / "bright_boxes.py").write_text(DETECTOR)
    spark.sparkContext.addPyFile(str(tmp_path / "bright_boxes.py"))
    sys.path.insert(0, str(tmp_path))
    yield ["--decoder", "motionloom.sources.frames:ArrayVideo", "--detector", "bright_boxes:Bright"]
    sys.path.remove(str(tmp_path))


def test_from_video_to_report(spark, tmp_path, seams, capsys):
    np.savez(tmp_path / "v.npz", frames=scene(), fps=10.0)
    path = settings(tmp_path)
    assert main(["run", "--config", path, "--check"]) == 0
    assert main(["run", "--config", path, *seams]) == 0
    record = str(tmp_path / "out/record.parquet")
    obs, clips = tracks.read_tracks(spark, record)
    rows = obs.orderBy("frame", "track_id").collect()
    assert len(rows) == 48 and {r["track_id"] for r in rows} == {0, 1} and {r["vehicle_class"] for r in rows} == {"car", "truck"}
    assert clips.first()["scale"] == 0.5 and clips.first()["total_frames"] == 24
    # In the global frame the ground stands still: the pan is added to the car's own speed.
    car = [r for r in rows if r["vehicle_class"] == "car"]
    assert car[-1]["cx"] == pytest.approx(30 + 23 * 3, abs=2) and car[-1]["cy"] == pytest.approx(35, abs=1)
    moved = (tmp_path / "out/t.csv").read_text().splitlines()
    assert len(moved) == 25 and float(moved[-1].split(",")[5]) == pytest.approx(23, abs=0.5)
    manifest = json.loads((tmp_path / "out/anchors/manifest.json").read_text())["reference_frames"]
    assert manifest[0]["frame_index"] == 0 and len(manifest) >= 2 and all((tmp_path / "out/anchors" / a["image"]).is_file() for a in manifest)
    spent = (tmp_path / "out/time.csv").read_text().splitlines()
    assert spent[0] == "frame,detect,observe,egomotion,stabilize,track,record" and len(spent) == 25
    assert not (tmp_path / "out/record.parquet.work").exists()
    assert main(["run", "--config", path, *seams]) == 2 and "--force" in capsys.readouterr().err
    assert main(["run", "--config", path, *seams, "--force"]) == 0 and tracks.read_tracks(spark, record)[0].count() == 48

    out = str(tmp_path / "run.trj")
    assert main(["postprocess", record, "--out", out]) == 0
    assert trj.read_trj(spark, out).filter("kind = 'vehicle'").count() == 48
    assert main(["postprocess", record, "--out", out]) == 2
    assert main(["postprocess", record, "--out", out, "--force", "--timestep-precision", "0.2"]) == 0
    assert trj.read_trj(spark, out).filter("kind = 'timestep'").count() == 12
    capsys.readouterr()
    assert main(["validate", out, "--json", "--violations-csv", str(tmp_path / "bad.csv"), "--max-speed", "1"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["steps"] == 12 and report["records"] == 24 and report["tracks"] == 2 and len(report["checks"]) == 5
    assert main(["validate", out, "--fail-under", "99", "--max-speed", "1"]) == 1
    assert main(["validate", str(tmp_path / "run.toml")]) == 1

    painted = tmp_path / "painted"
    assert main(["render", str(tmp_path / "v.npz"), "--trj", out, "--out", str(painted), "--transforms", str(tmp_path / "out/t.csv"), "--violations", str(tmp_path / "bad.csv"), "--decoder", seams[1]]) == 0
    assert len(list(painted.glob("frame_*.png"))) == 24
    data = (painted / "frame_10.png").read_bytes()
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]), np.uint8).reshape(120, 1 + 160 * 3)[:, 1:].reshape(120, 160, 3)
    assert ((raw == (255, 0, 0)).all(axis=2)).sum() > 50  # the violations' circles


def test_video_without_vehicles(spark, tmp_path, seams):
    np.savez(tmp_path / "v.npz", frames=scene(5, 128, 96, vehicles=False), fps=30.0)
    path = settings(tmp_path, ego_motion={"enabled": False}, export={"out": f"{tmp_path}/r.parquet", "transform_csv": "", "anchors_dir": ""}, run={"timing_csv": ""}, window={"start": "0.1", "end": ""})
    assert main(["run", "--config", path, *seams]) == 0
    assert main(["postprocess", str(tmp_path / "r.parquet"), "--out", str(tmp_path / "r.trj")]) == 0
    rows = trj.read_trj(spark, str(tmp_path / "r.trj")).collect()
    assert [(r["kind"], r["max_x"], r["max_y"]) for r in rows] == [("header", 128, 96)]


def test_bad_settings(tmp_path, capsys):
    path = settings(tmp_path, tracker={"det_thresh": 3}, input={"video": "", "process_fps": 0})
    assert main(["run", "--config", path, "--check", "--json"]) == 2
    report = json.loads(capsys.readouterr().out)
    assert not report["ok"] and len(report["problems"]) == 2
    assert main(["run", "--config", path]) == 2


def test_features_follow_a_turn():
    big = np.random.default_rng(3).integers(0, 255, (40, 40)).astype(float).repeat(8, 0).repeat(8, 1)
    angle, c = np.deg2rad(20), 160
    y, x = np.mgrid[0:320, 0:320]
    sx = np.cos(angle) * (x - c) + np.sin(angle) * (y - c) + c
    sy = -np.sin(angle) * (x - c) + np.cos(angle) * (y - c) + c
    turned = big[np.clip(np.rint(sy), 0, 319).astype(int), np.clip(np.rint(sx), 0, 319).astype(int)]
    (p, a), (q, b) = features.extract(big, 400), features.extract(turned, 400)
    pairs = features.match(b, a, 0.8)
    m = egomotion.fit_similarity(q[pairs[:, 1] * 0 + pairs[:, 0]], p[pairs[:, 1]], 3.0, 10)
    assert m is not None and np.rad2deg(np.arctan2(m[1, 0], m[0, 0])) == pytest.approx(-20, abs=1)
    blank = features.extract(np.zeros((100, 100)), 50)
    assert len(blank[0]) == 0 and len(features.match(blank[1], a, 0.8)) == 0
    masked, _ = features.extract(big, 400, np.array([[0, 0, 320, 200]]))
    assert len(masked) and masked[:, 1].min() >= 200


def test_two_stages_and_patience():
    t = tracking.Tracks(tracking.Options(patience=5))
    box = lambda x, y=50.0: [x, y, 20.0, 10.0]
    ids, _ = t.step(0, np.array([box(0), box(200)]), np.array([0.9, 0.9]))
    assert ids.tolist() == [0, 1]
    for f in range(1, 10):  # one fades, the other goes on at 8 pixels a frame
        ids, out = t.step(f, np.array([box(8.0 * f), box(200)]), np.array([0.9, 0.2]))
        assert ids.tolist() == [0, 1]
    assert abs(out[0][0] - 72) < 4
    ids, _ = t.step(13, np.array([box(8.0 * 13)]), np.array([0.9]))  # unseen for three frames, but where the model says
    assert ids.tolist() == [0]
    ids, _ = t.step(30, np.array([box(8.0 * 30), box(200)]), np.array([0.9, 0.05]))
    assert ids.tolist() == [2, -1]  # both ended; too low a score starts nothing


def test_png_of_grey():
    assert images.png(np.zeros((2, 3, 1), np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"
