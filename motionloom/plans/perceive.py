"""From a video to a track record: detect, estimate camera motion, stabilise, track.

Frames are decoded once, in the task that detects in them, and never travel
through Spark: ``scan`` turns a table of frame numbers into one small row for
each frame. Detection and feature extraction are split by frame range; camera
motion and tracking are folds in frame order, which hold one frame at a time.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.operators import egomotion, features, project, tracking
from motionloom.plans.config import Settings
from motionloom.schema import VEHICLE_CLASSES
from motionloom.sources import frames as video
from motionloom.sources import sidecars, tracks

_DETECTION = "struct<x:double,y:double,w:double,h:double,score:double,vehicle_class:string>"
SCAN = f"clip_id long, frame long, detections array<{_DETECTION}>, corners binary, descriptors binary, detect_seconds double, feature_seconds double"
_POSE = "a double, b double, c double, d double, tx double, ty double"


@dataclass(frozen=True)
class Seams:
    """Classes that the engine doesn't bring, as "module:Class", and what the detector is made with.

    The decoder is as in ``sources.frames``. A detector is made once for each
    task as ``Detector(**settings)``; ``detect(pixels)`` takes a height x width
    x 3 array and gives (x, y, w, h, score, vehicle_class) rows.
    """

    decoder: str
    detector: str
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EgoMotion:
    n_features: int = 2000
    match_ratio: float = 0.75
    min_matches: int = 10
    ransac_threshold: float = 3.0
    min_anchor_overlap: float = 0.6


def scan(index: DataFrame, seams: Seams, least: float, n_features: int = 0, clip_id: int = 0) -> DataFrame:
    """One row for each frame of (path, frame): detections of at least the score, and n features outside of them.

    Classes other than those of vehicles go. A frame that can't be decoded gives no row.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = video.load_class
        detector, opened = load(seams.detector)(**seams.settings), {}
        for batch in batches:
            rows = []
            for path, frame in zip(batch["path"], batch["frame"], strict=True):
                if path not in opened:
                    opened = {path: load(seams.decoder)(path)}
                source = opened[path]
                data = source.read(int(frame))
                if data is None:
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(source.height, source.width, -1)
                began = time.perf_counter()
                found = [d for d in detector.detect(pixels) if d[4] >= least and d[5] in VEHICLE_CLASSES]
                seen = time.perf_counter()
                points, bits = features.extract(pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., 0], n_features, np.array([d[:4] for d in found])) if n_features else features.NONE
                dicts = [dict(zip(("x", "y", "w", "h", "score", "vehicle_class"), (*map(float, d[:5]), d[5]), strict=True)) for d in found]
                rows.append((clip_id, frame, dicts, points.astype("<i4").tobytes(), bits.tobytes(), seen - began, time.perf_counter() - seen))
            yield pd.DataFrame(rows, columns=["clip_id", "frame", "detections", "corners", "descriptors", "detect_seconds", "feature_seconds"])

    return index.select("path", "frame").mapInPandas(work, SCAN)


def detections(scanned: DataFrame) -> DataFrame:
    """The schema DETECTIONS, one row for each."""
    return scanned.select("clip_id", "frame", F.posexplode("detections").alias("det_ind", "d")).select("clip_id", "frame", "det_ind", "d.*")


def _in_order(df: DataFrame, fold: Callable[[Iterator[tuple]], Iterator[tuple]], out: str) -> DataFrame:
    """Run a fold over the rows of each clip in the order of frames; a task holds one batch at a time, not a clip."""
    names, columns = df.columns, [c.split(" ")[0] for c in out.split(", ")]

    def work(batches):
        rows = (r for b in batches for r in zip(*(b[c] for c in names), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            folded = fold(group)
            while part := list(itertools.islice(folded, 2000)):
                yield pd.DataFrame(part, columns=columns)

    return df.repartition("clip_id").sortWithinPartitions("clip_id", "frame").mapInPandas(work, out)


def camera_poses(scanned: DataFrame, width: int, height: int, o: EgoMotion) -> DataFrame:
    """clip_id, frame, the pose into the global frame, whether the frame became an anchor, seconds.

    Features are matched with the current anchor's, so the fold keeps those of one frame.
    """

    def fold(rows):
        anchor, now, spent = None, None, 0.0

        def motions():
            nonlocal now, spent
            for clip, frame, corners, bits in rows:
                began = time.perf_counter()
                points = np.frombuffer(corners, "<i4").reshape(-1, 2).astype(float)
                now = clip, frame, points, np.frombuffer(bits, np.uint64).reshape(-1, features.WORDS)
                usable, motion = len(points) >= o.min_matches, None
                if usable and anchor is not None:
                    pairs = features.match(now[3], anchor[1], o.match_ratio)
                    motion = egomotion.fit_similarity(points[pairs[:, 0]], anchor[0][pairs[:, 1]], o.ransac_threshold, o.min_matches)
                spent = time.perf_counter() - began
                yield usable, motion

        for pose, again in egomotion.chained(motions(), width, height, o.min_anchor_overlap):
            if again:
                anchor = now[2], now[3]
            yield (*now[:2], *map(float, pose[:, :2].ravel()), *map(float, pose[:, 2]), again, spent)

    return _in_order(scanned.select("clip_id", "frame", "corners", "descriptors"), fold, f"clip_id long, frame long, {_POSE}, anchored boolean, seconds double")


TRACKED = "clip_id long, frame long, det_ind int, track_id long, cx double, cy double, w double, h double, score double, vehicle_class string, seconds double"


def tracked(dets: DataFrame, options: tracking.Options) -> DataFrame:
    """Filtered boxes of the detections that a track takes, with its id; ids count from 0 in each clip."""

    def fold(rows):
        live = tracking.Tracks(options)
        for (clip, frame), group in itertools.groupby(rows, key=lambda r: r[:2]):
            found = sorted(group, key=lambda r: r[2])
            boxes = np.array([(x + w / 2, y + h / 2, w, h) for _, _, _, x, y, w, h, _, _ in found])
            ids, out, spent = tracking.timed_step(live, int(frame), boxes, np.array([r[7] for r in found]))
            for r, i, box in zip(found, ids.tolist(), out.tolist(), strict=True):
                if i >= 0:
                    yield (clip, frame, r[2], i, *box, r[7], r[8], spent)

    return _in_order(dets.select("clip_id", "frame", "det_ind", "x", "y", "w", "h", "score", "vehicle_class"), fold, TRACKED)


STEPS = ("detect", "observe", "egomotion", "stabilize", "track", "record")


def timings(scanned: DataFrame, poses: DataFrame | None, tracks_: DataFrame) -> DataFrame:
    """(step, frame, seconds). Stabilising and recording are columns of a plan, so no frame has a time of its own for them."""
    parts = [scanned.select(F.lit("detect").alias("step"), "frame", F.col("detect_seconds").alias("seconds"))]
    if poses is not None:
        both = scanned.join(poses.select("clip_id", "frame", "seconds"), ["clip_id", "frame"])
        parts.append(both.select(F.lit("egomotion").alias("step"), "frame", (F.col("feature_seconds") + F.col("seconds")).alias("seconds")))
    parts.append(tracks_.groupBy("frame").agg(F.first("seconds").alias("seconds")).select(F.lit("track").alias("step"), "frame", "seconds"))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, settings: Settings, seams: Seams, work: str, force: bool = False) -> dict:
    """Carry out a run: the record, and the transforms, anchors and timings if they are on.

    ``work`` is a folder that driver and executors share; the scan and the
    folds' results are written there, so that a frame is decoded and tracked
    once, whatever is lost or read again.
    """
    s = settings.get
    mode = "overwrite" if force else "errorifexists"
    options = {k: v for k, v in {"startSeconds": s("window.start"), "endSeconds": s("window.end"), "processFps": s("input.process_fps") or None}.items() if v is not None}
    source = video.load_class(seams.decoder)(s("input.video"))
    altitude = None
    if s("calibration.srt") and not s("calibration.altitude_m"):
        altitude = sidecars.read_telemetry(spark, s("calibration.srt")).agg(F.avg("altitude_m")).first()[0]
    scale = settings.scale(source.width, altitude)
    if not scale > 0:
        raise ValueError("the scale must be positive")
    ego = EgoMotion(*(s(f"ego_motion.{k}") for k in ("n_features", "match_ratio", "min_matches", "ransac_threshold", "min_anchor_overlap"))) if s("ego_motion.enabled") else None

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    index = video.frame_index(spark, s("input.video"), seams.decoder, **options)
    scanned = kept(scan(index, seams, s("detector.conf"), ego.n_features if ego else 0), "scan")
    found, poses = detections(scanned), None
    if ego:
        poses = kept(camera_poses(scanned, source.width, source.height, ego), "poses")
        found = project.stabilize(found, poses)
    ids = kept(tracked(found, tracking.Options(low=s("tracker.det_thresh"))), "tracked")
    tracks.write_tracks(ids, s("export.out"), float(source.fps), source.width, source.height, source.total_frames, scale, mode)
    if s("export.transform_csv"):
        sidecars.one_file(lambda p: sidecars.write_transforms(poses, p, mode), s("export.transform_csv"))
    anchors = 0
    if s("export.anchors_dir"):
        anchors = export_anchors(egomotion.anchor_events(poses), s("input.video"), seams.decoder, s("export.anchors_dir"))
    if s("run.timing_csv"):
        spent = timings(scanned, poses, ids)
        sidecars.one_file(lambda p: sidecars.write_timings(spent, list(STEPS), p, mode), s("run.timing_csv"))
    return {"frames": scanned.count(), "observations": ids.count(), "anchors": anchors, "scale": scale}


def export_anchors(events: DataFrame, path: str, decoder: str, folder: str) -> int:
    """frame_<number>.png of each anchor, written by the executors, and manifest.json; the number of anchors."""

    def put(batches):
        from motionloom.sources import images

        source = video.load_class(decoder)(path)
        for batch in batches:
            for frame in batch["frame"]:
                pixels = np.frombuffer(source.read(int(frame)), np.uint8).reshape(source.height, source.width, -1)
                images.write_png(f"{folder}/frame_{frame}.png", pixels)
            yield pd.DataFrame({"frame": batch["frame"]})

    done = events.select("frame").mapInPandas(put, "frame long").count()
    pose = F.struct(*(F.col(k) for k in ("a", "b", "tx", "c", "d", "ty"))).alias("pose")
    sidecars.write_anchors(events.select("frame", pose, F.format_string("frame_%d.png", "frame").alias("image")), f"{folder}/manifest.json", path)
    return done
