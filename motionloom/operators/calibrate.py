"""From camera and survey data to units: ground sample distance, homographies, scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sensor width (mm) and focal length (mm) by camera drone. Fixed values.
DRONES = {
    "mavic_3": (17.3, 12.29),
    "mavic_2_pro": (13.2, 10.26),
    "air_2s": (13.2, 8.4),
    "mini_3_pro": (6.4, 6.7),
    "mini_4_pro": (6.4, 6.7),
}


def drones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DRONES.items()], "model string, sensor_mm double, focal_mm double")


def lookup(model: str) -> tuple[float, float]:
    found = DRONES.get(model.lower())
    if found is None:
        raise KeyError(f"unknown model {model!r}; known: {', '.join(sorted(DRONES))}")
    return found


def ground_sample_distance(sensor_mm: Column, altitude_m: Column, focal_mm: Column, image_width_px: Column) -> Column:
    """Metres by pixel; anything not positive raises."""
    ok = (sensor_mm > 0) & (altitude_m > 0) & (focal_mm > 0) & (image_width_px > 0)
    return F.when(ok, sensor_mm * altitude_m / (focal_mm * image_width_px)).otherwise(F.raise_error(F.lit("all inputs must be positive")).cast("double"))


def altitude(line: Column) -> Column:
    """The relative altitude of a telemetry line, or else the absolute one, or null."""
    number = r"\s*:\s*(-?\d+(?:\.\d+)?)"
    return F.coalesce(*(F.nullif(F.regexp_extract(line, f"(?i){k}{number}", 1), F.lit("")) for k in ("rel_alt", "abs_alt"))).cast("double")


def mean_altitude(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(altitude(F.col(column)).alias("a")).agg(F.avg("a").alias("altitude_m"), F.count("a").alias("n"))


def resolve_scale(width_px: int, meters_per_pixel: float | None = None, model: str | None = None, altitude_m: float | None = None) -> float:
    """The given scale, or the one from the drone's camera and altitude."""
    if meters_per_pixel is not None:
        return meters_per_pixel
    if model is None or altitude_m is None:
        raise ValueError("either meters_per_pixel, or model and altitude")
    sensor, focal = lookup(model)
    return sensor * altitude_m / (focal * width_px)


def _direct(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(p, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows))[2][-1]
    return (h / h[8] if abs(h[8]) > 1e-12 else h).reshape(3, 3)


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ np.asarray(h).T
    return q[:, :2] / q[:, 2:]


def fit_homography(image: Sequence[tuple[float, float]], world: Sequence[tuple[float, float]], threshold: float = 3.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Exact from 4 points; with more the one that most agree with, refitted to those. Points are taken in single precision."""
    if len(image) != len(world) or len(image) < 4:
        raise ValueError("at least 4 pairs of points are needed")
    p, q = (np.asarray(v, np.float32).astype(float) for v in (image, world))
    if len(p) == 4:
        a, b = [], []
        for (x, y), (u, v) in zip(p, q, strict=True):
            a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            b += [u, v]
        return np.append(np.linalg.solve(np.array(a), np.array(b)), 1.0).reshape(3, 3)
    rng, best = np.random.default_rng(seed), None
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            i = rng.choice(len(p), 4, replace=False)
            good = np.hypot(*(project(_direct(p[i], q[i]), p) - q).T) < threshold
            if best is None or good.sum() > best.sum():
                best = good
    if best is None or best.sum() < 4:
        raise ValueError("no homography fits the points")
    return _direct(p[best], q[best])


def local_scale(h: np.ndarray, point: tuple[float, float]) -> float:
    """World length of a step of one pixel to the right."""
    a, b = project(np.asarray(h), np.array([point, (point[0] + 1, point[1])], float))
    return float(np.hypot(*(b - a)))


def noise_in_world(pos_noise: float, jerk: float, scale: float) -> tuple[float, float]:
    return pos_noise * scale, jerk * scale**2
