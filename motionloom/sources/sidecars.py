"""Small files beside a clip: zones, calibrations, anchors, transforms, violations, telemetry, timings, settings."""

from __future__ import annotations

import json
import shutil
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.operators import calibrate

_POSE = ("a", "b", "tx", "c", "d", "ty")
_POINT = "struct<x:double,y:double>"
TRANSFORM_FIELDS = "frame long, a double, b double, c double, d double, tx double, ty double"


def _load(path: str) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path}: an object is expected")
    return found


def _number(value, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{where}: a number is expected")
    return float(value)


def _pair(value, where: str) -> tuple[float, float]:
    if not isinstance(value, list) or len(value) != 2:
        raise ValueError(f"{where}: a pair is expected")
    return _number(value[0], where), _number(value[1], where)


def _frame(entry: dict, key: str, where: str, default: int | None = None) -> int:
    value = entry.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{where}: {key} must be a whole number from 0")
    return value


def _entries(found: dict, key: str, path: str) -> list[dict]:
    entries = found.get(key)
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError(f"{path}: {key} must be a list of objects")
    return entries


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """zone_id, label, reference_frame, vertices. An empty list is fine."""
    rows = []
    for i, e in enumerate(_entries(_load(path), "exclusion_zones", path)):
        where = f"{path}: zone {i}"
        points = e.get("vertices")
        if not isinstance(points, list) or len(points) < 3:
            raise ValueError(f"{where}: at least 3 vertices are needed")
        rows.append((i, e.get("label"), _frame(e, "reference_frame", where, 0), [_pair(p, where) for p in points]))
    return spark.createDataFrame(rows, f"zone_id int, label string, reference_frame int, vertices array<{_POINT}>")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """reference_frame, image, world: at least 4 correspondences."""
    rows = []
    for i, e in enumerate(_entries(_load(path), "correspondences", path)):
        where = f"{path}: correspondence {i}"
        rows.append((_frame(e, "reference_frame", where, 0), _pair(e.get("image"), where), _pair(e.get("world"), where)))
    if len(rows) < 4:
        raise ValueError(f"{path}: at least 4 correspondences are needed")
    return spark.createDataFrame(rows, f"reference_frame int, image {_POINT}, world {_POINT}")


def read_anchors(spark: SparkSession, path: str, clip_id: int = 0) -> DataFrame:
    """clip_id, frame, pose, image of an anchor manifest."""
    rows = []
    for i, e in enumerate(_entries(_load(path), "reference_frames", path)):
        where = f"{path}: anchor {i}"
        pose = e.get("pose")
        if not isinstance(pose, dict) or not isinstance(e.get("image"), str):
            raise ValueError(f"{where}: pose and image are needed")
        rows.append((clip_id, _frame(e, "frame_index", where), tuple(_number(pose.get(k), where) for k in _POSE), e["image"]))
    kind = ",".join(f"{k}:double" for k in _POSE)
    return spark.createDataFrame(rows, f"clip_id long, frame long, pose struct<{kind}>, image string")


def write_anchors(anchors: DataFrame, path: str, video: str) -> None:
    rows = anchors.orderBy("frame").collect()
    entries = [{"frame_index": r["frame"], "image": r["image"], "pose": r["pose"].asDict()} for r in rows]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"video": video, "reference_frames": entries}, indent=2), encoding="utf-8")


def read_transforms(spark: SparkSession, path: str, clip_id: int = 0) -> DataFrame:
    """clip_id, row_id, frame, a, b, c, d, tx, ty; malformed rows raise."""
    df = spark.read.schema(TRANSFORM_FIELDS).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.select(F.lit(clip_id).cast("long").alias("clip_id"), F.monotonically_increasing_id().alias("row_id"), "*")


def write_transforms(transforms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    transforms.select(*(x.split(" ")[0] for x in TRANSFORM_FIELDS.split(", "))).orderBy("frame").coalesce(1).write.mode(mode).csv(path, header=True)


VIOLATION_FIELDS = ("timestamp_s", "vehicle_id", "check", "centroid_x", "centroid_y")


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in VIOLATION_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    kinds = ("double", "long", "string", "double", "double")
    return df.select(F.monotonically_increasing_id().alias("row_id"), *(F.col(c).cast(k).alias(c) for c, k in zip(VIOLATION_FIELDS, kinds, strict=True)))


def write_violations(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Image rows of violations with fixed decimals."""
    digits = {"timestamp_s": 3, "centroid_x": 1, "centroid_y": 1, "front_x": 1, "front_y": 1, "rear_x": 1, "rear_y": 1, "length": 2, "width": 2, "speed": 3, "accel": 3}
    text = [F.format_string(f"%.{digits[c]}f", F.col(c)).alias(c) if c in digits else F.col(c) for c in rows.columns]
    rows.select(*text).coalesce(1).write.mode(mode).csv(path, header=True)


def one_file(write: Callable[[str], None], path: str) -> None:
    """Let ``write`` fill a folder beside a local path, and put its only data file at the path; elsewhere the path is the folder."""
    if "://" in path:
        return write(path)
    folder = Path(f"{path}.part")
    try:
        write(str(folder))
        next(folder.glob("part-*")).replace(path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Altitudes of a subtitle telemetry file, one row for each line that has one."""
    lines = spark.read.text(path)
    return lines.select(calibrate.altitude(F.col("value")).alias("altitude_m")).filter("altitude_m IS NOT NULL")


def timing_table(timings: DataFrame, steps: list[str]) -> DataFrame:
    """(step, frame, seconds) rows as one row for each frame; steps that weren't run stay null."""
    return timings.groupBy("frame").pivot("step", steps).agg(F.first("seconds"))


def write_timings(timings: DataFrame, steps: list[str], path: str, mode: str = "errorifexists") -> None:
    timing_table(timings, steps).orderBy("frame").coalesce(1).write.mode(mode).csv(path, header=True)


def read_settings(path: str) -> dict:
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ValueError(f"{path}: {e}") from e


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectory files under a folder with the files that belong to them, by stem; smoothed ones aren't starting points."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parts = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    kinds = {"trj": r"^(.*?)(?<!_smooth)\.trj$", "smooth": r"^(.*)_smooth\.trj$", "record": r"^(.*)\.parquet$", "transforms": r"^(.*)_transforms\.csv$"}
    stem = F.coalesce(*(F.nullif(F.regexp_extract("name", p, 1), F.lit("")) for p in kinds.values()))
    by = parts.withColumn("stem", stem).filter("stem IS NOT NULL").groupBy("dir", "stem")
    found = by.agg(*(F.max(F.when(F.col("name").rlike(p), F.col("path"))).alias(k) for k, p in kinds.items()))
    return found.filter("trj IS NOT NULL")


def anchor_images(spark: SparkSession, folder: str) -> DataFrame:
    """frame, path of the images named frame_<number>.png; others are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").load(folder).select("path")
    return files.withColumn("frame", F.expr("try_cast(regexp_extract(path, 'frame_([0-9]+)[.]png$', 1) AS BIGINT)")).filter("frame IS NOT NULL").select("frame", "path")
