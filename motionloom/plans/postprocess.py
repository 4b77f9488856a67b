"""From a track record to kinematic states, trajectory records and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.operators import cadence, calibrate, exclusion, project, smoothing
from motionloom.sources import trj
from motionloom.sources.tracks import first_rows


@dataclass(frozen=True)
class Options:
    min_fraction: float = 0.5
    pos_noise: float = 2.0
    jerk: float = 20.0
    timestep: float = 0.0
    fps: float = 30.0

    def __post_init__(self):
        if self.timestep < 0 or not 0 < self.min_fraction <= 1:
            raise ValueError("timestep must be at least 0 and min_fraction in (0, 1]")


def lifted_points(correspondences: DataFrame, anchors: DataFrame | None) -> tuple[list, list]:
    """Image points in the global frame, and world points: four numbers for each surveyed point, on the driver, where the fit is."""
    rows = correspondences.collect()
    used = correspondences.select(F.col("reference_frame").alias("frame")).distinct()
    poses = {} if anchors is None else {r["frame"]: r["pose"] for r in anchors.select("frame", "pose").join(used, "frame").collect()}
    image = []
    for r in rows:
        x, y = r["image"]["x"], r["image"]["y"]
        if anchors is not None:
            if r["reference_frame"] not in poses:
                raise ValueError(f"no anchor for reference frame {r['reference_frame']}")
            p = poses[r["reference_frame"]]
            x, y = p["a"] * x + p["b"] * y + p["tx"], p["c"] * x + p["d"] * y + p["ty"]
        image.append((x, y))
    return image, [(r["world"]["x"], r["world"]["y"]) for r in rows]


def to_states(obs: DataFrame, clips: DataFrame, options: Options, zones: DataFrame | None = None, anchors: DataFrame | None = None, correspondences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """States and the clip table they belong to.

    The order matters: exclusion works on global pixels, smoothing on world
    units, thinning on what is left. One shuffle by track for the smoother; the
    windows after it keep that partitioning.
    """
    noise = options.pos_noise, options.jerk
    if zones is not None:
        obs = exclusion.drop_excluded(obs, zones, anchors, options.min_fraction)
    scale = F.col("scale")
    if correspondences is not None:
        image, world = lifted_points(correspondences, anchors)
        h = calibrate.fit_homography(image, world)
        centre = (sum(x for x, _ in image) / len(image), sum(y for _, y in image) / len(image))
        noise = calibrate.noise_in_world(*noise, calibrate.local_scale(h, centre))
        obs, canvas = project.normalize_world(project.to_world(obs, h.ravel().tolist()))
        clips = clips.drop("width", "height", "scale").join(canvas, "clip_id")
        scale = F.lit(1.0)
    obs = project.with_timestamp(obs, options.fps)
    samples = smoothing.smooth_tracks(obs, *noise)
    if correspondences is None:
        samples = samples.join(clips.select("clip_id", "scale"), "clip_id")
    return project.kinematic_states(samples, scale), clips


def to_records(states: DataFrame, clips: DataFrame) -> DataFrame:
    """States as grid-unit records, in the clip's canvas."""
    canvas = clips.select("clip_id", F.col("scale").alias("_scale"), F.col("height").alias("_height"))
    return project.to_grid(states.join(canvas, "clip_id"), F.col("_scale"), F.col("_height").cast("double")).drop("_scale", "_height")


def export(states: DataFrame, clips: DataFrame, folder: str, options: Options, force: bool = False) -> DataFrame:
    """Write each clip's trajectory file, thinned to the timestep if there is one."""
    kept = cadence.decimate(states, options.timestep, options.fps)
    rows = first_rows(kept.withColumnRenamed("vehicle_id", "track_id")).withColumnRenamed("track_id", "vehicle_id")
    return trj.write_trj(to_records(rows, clips), clips, folder, force)
