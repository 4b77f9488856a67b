"""Run settings: every key is given, and all problems are found and told together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from motionloom.operators import calibrate


class SettingsError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def timecode(value: str) -> float:
    """SS(.ms), MM:SS or HH:MM:SS in seconds."""
    parts = value.strip().split(":")
    if not 1 <= len(parts) <= 3 or not all(re.fullmatch(r"\d+(\.\d+)?", p) for p in parts):
        raise ValueError(f"{value!r} is no time code")
    total = 0.0
    for p in parts:
        total = total * 60 + float(p)
    return total


# Sections, keys, detector names and the form of a device.
DETECTORS = ("yolov8_visdrone", "rt_detr")
DEVICE = r"cpu|mps|cuda(:\d+)?"


@dataclass(frozen=True)
class Rule:
    """What a value has to be: its type, what else holds for it (and how that is told), and what it becomes."""

    kind: type | tuple
    kind_name: str
    holds: Callable = lambda v: True
    told: str = ""
    turn: Callable = lambda v: v

    def check(self, value) -> tuple[object, str | None]:
        if not isinstance(value, self.kind) or (isinstance(value, bool) and self.kind is not bool):
            return None, f"{self.kind_name} is expected"
        if not self.holds(value):
            return None, f"{self.told} is expected"
        try:
            return self.turn(value), None
        except ValueError as e:
            return None, str(e)


def _number(holds: Callable, told: str) -> Rule:
    return Rule((int, float), "a number", holds, told, float)


TEXT = Rule(str, "a text", bool, "a text that isn't empty")
OFF_OR_PATH = Rule(str, "a path, or \"\" for off,", turn=lambda v: v or None)
OFF_OR_TIME = Rule(str, "a time code, or \"\" for the clip's end,", turn=lambda v: timecode(v) if v else None)
FLAG = Rule(bool, "true or false")
SHARE = _number(lambda v: 0 <= v <= 1, "a number from 0 to 1")
INNER_SHARE = _number(lambda v: 0 < v < 1, "a number between 0 and 1")
POSITIVE = _number(lambda v: v > 0, "a positive number")

#: Keys that every run has.
REQUIRED = {
    "input.video": TEXT,
    "input.process_fps": _number(lambda v: v >= 0, "a number from 0 (0: every frame)"),
    "detector.name": Rule(str, "a text", lambda v: v in DETECTORS, f"one of {', '.join(DETECTORS)}"),
    "detector.checkpoint": TEXT,
    "detector.conf": SHARE,
    "detector.filename": Rule(str, "a text"),
    "runtime.device": Rule(str, "a text", lambda v: re.fullmatch(DEVICE, v), "cpu, mps or cuda[:n]"),
    "ego_motion.enabled": FLAG,
    "tracker.det_thresh": SHARE,
    "export.out": TEXT,
    "export.transform_csv": OFF_OR_PATH,
    "export.anchors_dir": OFF_OR_PATH,
    "window.start": OFF_OR_TIME,
    "window.end": OFF_OR_TIME,
    "run.timing_csv": OFF_OR_PATH,
}
#: Keys that a run with stabilisation has too.
EGO_MOTION = {
    "ego_motion.n_features": Rule(int, "a whole number", lambda v: v > 0, "a positive number"),
    "ego_motion.match_ratio": INNER_SHARE,
    "ego_motion.min_matches": Rule(int, "a whole number", lambda v: v >= 2, "a number from 2"),
    "ego_motion.ransac_threshold": POSITIVE,
    "ego_motion.min_anchor_overlap": INNER_SHARE,
}
#: Keys of the two ways to a scale.
CALIBRATION = {"calibration.meters_per_pixel": POSITIVE, "calibration.drone_model": Rule(str, "a text"), "calibration.altitude_m": POSITIVE, "calibration.srt": Rule(str, "a text")}


@dataclass(frozen=True)
class Settings:
    values: dict = field(default_factory=dict)

    def get(self, key: str):
        """A value by its dotted key; None if it is off or not given."""
        return self.values.get(key)

    def scale(self, width_px: int, altitude_m: float | None = None) -> float:
        return calibrate.resolve_scale(width_px, self.get("calibration.meters_per_pixel"), self.get("calibration.drone_model"), self.get("calibration.altitude_m") or altitude_m)


def _calibration_problems(values: dict, refused: set[str]) -> list[str]:
    """Exactly one way to the scale, and the altitude or the telemetry that goes with a drone."""
    direct, model = values.get("calibration.meters_per_pixel"), values.get("calibration.drone_model")
    if direct is not None and model:
        return ["calibration: either meters_per_pixel or drone_model is expected, not both"]
    if direct is not None or "calibration.meters_per_pixel" in refused:
        return []
    if not model:
        return ["calibration: meters_per_pixel is expected, or drone_model with altitude_m or srt"]
    out = []
    if model.lower() not in calibrate.DRONES:
        out.append(f"calibration.drone_model: {model!r} isn't one of {', '.join(sorted(calibrate.DRONES))}")
    if values.get("calibration.altitude_m") is None and not values.get("calibration.srt"):
        out.append("calibration: drone_model goes with altitude_m or srt")
    return out


def resolve(found: dict, overrides: dict | None = None) -> Settings:
    """Checked settings of a nested dict; raises SettingsError with every problem.

    ``overrides`` are by dotted key and come first; None overrides nothing.
    Keys that no rule is for are passed over.
    """
    given = {f"{s}.{k}": v for s, part in found.items() if isinstance(part, dict) for k, v in part.items()}
    given |= {k: v for k, v in (overrides or {}).items() if v is not None}
    problems, values, refused = [], {}, set()

    def read(rules: dict, required: bool) -> None:
        for key, rule in rules.items():
            if key not in given:
                if required:
                    problems.append(f"{key} is missing")
                continue
            value, fault = rule.check(given[key])
            if fault:
                problems.append(f"{key}: {fault}")
                refused.add(key)
            else:
                values[key] = value

    read(REQUIRED, True)
    if values.get("ego_motion.enabled"):
        read(EGO_MOTION, True)
    read(CALIBRATION, False)
    problems += _calibration_problems(values, refused)
    if values.get("ego_motion.enabled") is False:
        problems += [f"{k} needs ego_motion.enabled" for k in ("export.transform_csv", "export.anchors_dir") if values.get(k)]
    start, end = values.get("window.start"), values.get("window.end")
    if end is not None and end <= (start or 0):
        problems.append("window.end must come after window.start")
    if problems:
        raise SettingsError(problems)
    return Settings(values)


def static_problems(settings: Settings) -> list[str]:
    """Problems that the file system shows before a run, without opening the video.

    The record may be a folder, for Spark writes it as one; the other outputs are files.
    """
    video, out = settings.get("input.video"), settings.get("export.out")
    problems = [] if Path(video).is_file() else [f"input.video: {video} isn't a file"]
    files = {k: settings.get(k) for k in ("export.transform_csv", "run.timing_csv") if settings.get(k)}
    problems += [f"{k}: {p} is a directory" for k, p in files.items() if Path(p).is_dir()]
    if (folder := settings.get("export.anchors_dir")) and Path(folder).is_file():
        problems.append(f"export.anchors_dir: {folder} is a file")
    places: dict[Path, str] = {Path(out).resolve(): "export.out"}
    for k, p in reversed(files.items()):
        if (same := places.setdefault(Path(p).resolve(), k)) != k:
            problems.append(f"{k} must differ from {same}")
    return problems


def check_report(path: str) -> dict:
    """What is wrong with a settings file, as {"ok": ..., "problems": [...]}."""
    from motionloom.sources import sidecars

    try:
        problems = static_problems(resolve(sidecars.read_settings(path)))
    except SettingsError as e:
        problems = e.problems
    except ValueError as e:
        problems = [str(e)]
    return {"ok": not problems, "problems": problems}
