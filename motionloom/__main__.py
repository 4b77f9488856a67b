"""python -m motionloom run | postprocess | validate | render"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motionloom.operators import overlay, project, validate
from motionloom.plans import config, painting, perceive, postprocess
from motionloom.shipping import ship
from motionloom.sources import frames, sidecars, tracks, trj


class Refused(Exception):
    """Something the user can mend; told on one line."""


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("motionloom").getOrCreate()
    ship(spark)
    return spark


def _free(path: str | None, force: bool) -> None:
    """An output that exists is only replaced when told to; asked for on a terminal, refused elsewhere."""
    if path is None:
        return
    if Path(path).exists() and not force:
        if not sys.stdin.isatty():
            raise Refused(f"{path} exists; --force replaces it")
        if input(f"{path} exists. Replace it? [y/N] ").strip().lower() not in ("y", "yes"):
            raise Refused(f"{path} is left as it is")
    Path(path).parent.mkdir(parents=True, exist_ok=True)


def run(args) -> int:
    if args.check:
        report = config.check_report(args.config)
        if args.json:
            print(json.dumps(report))
        else:
            print("\n".join(report["problems"]) or "settings are fine", file=sys.stdout if report["ok"] else sys.stderr)
        return 0 if report["ok"] else 2
    settings = config.resolve(sidecars.read_settings(args.config))
    if problems := config.static_problems(settings):
        raise config.SettingsError(problems)
    for key in ("export.out", "run.timing_csv", "export.transform_csv"):
        _free(settings.get(key), args.force)
    made = {"name": settings.get("detector.name"), "checkpoint": settings.get("detector.checkpoint"), "filename": settings.get("detector.filename"), "device": settings.get("runtime.device"), "conf": settings.get("detector.conf")}
    work = args.work or f"{settings.get('export.out')}.work"
    try:
        # What exists by now may be replaced: the user was asked.
        done = perceive.run(_spark(), settings, perceive.Seams(args.decoder, args.detector, made), work, True)
    finally:
        if not args.work:
            shutil.rmtree(work, ignore_errors=True)
    print(f"{done['frames']} frames, {done['observations']} observations -> {settings.get('export.out')} (scale {done['scale']})")
    return 0


def to_trajectories(args) -> int:
    spark = _spark()
    _free(args.out, args.force)
    obs, clips = tracks.read_tracks(spark, args.tracks)
    clip = clips.first()
    options = postprocess.Options(args.exclusion_min_fraction, args.pos_noise, args.jerk, args.timestep_precision, clip["fps"])
    zones = sidecars.read_zones(spark, args.exclusion_zones) if args.exclusion_zones else None
    anchors = sidecars.read_anchors(spark, args.anchors) if args.anchors else None
    pairs = sidecars.read_calibration(spark, args.calibration) if args.calibration else None
    states, canvas = postprocess.to_states(obs, clips, options, zones, anchors, pairs)
    folder = f"{args.out}.part"
    try:
        written = postprocess.export(states, canvas, folder, options, True).first()
        Path(written["path"]).replace(args.out)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(f"{args.tracks} -> {args.out} ({written['bytes']} bytes)")
    return 0


_ROW = "  {:<22}{:>12}{:>12}{:>9}"


def check_trajectories(args) -> int:
    spark = _spark()
    rows = trj.read_trj(spark, args.path, "tolerant").persist()
    try:
        try:
            head = rows.filter("kind = 'header'").first()
        except PySparkException as e:
            raise Refused(f"{args.path} can't be read: {next((x for x in str(e).splitlines() if 'ValueError' in x), e)}") from e
        if head is None:
            raise Refused(f"{args.path} has no dimensions")
        judged = validate.of_file(rows, args.boundary_margin, args.max_heading_step, args.max_speed, args.max_accel, head["units"]).persist()
        counts = validate.report(judged).collect()
        figures = rows.agg(F.count_if(F.col("kind") == "timestep").alias("steps"), F.count_if(F.col("kind") == "vehicle").alias("records"), F.count_distinct("vehicle_id").alias("tracks")).first()
        if args.violations_csv:
            found = validate.image_rows(validate.violations(judged)).drop("clip_id")
            sidecars.one_file(lambda p: sidecars.write_violations(found, p, "overwrite"), args.violations_csv)
    finally:
        spark.catalog.clearCache()
    if args.json:
        print(json.dumps({**figures.asDict(), "checks": [r.asDict() for r in counts]}))
    else:
        print(f"version {head['version']:.2f}, units {head['units']}, scale {head['scale']:g}: {figures['steps']} timesteps, {figures['records']} records, {figures['tracks']} tracks")
        print(_ROW.format("check", "compliant", "total", "%"))
        for r in counts:
            print(_ROW.format(r["check"], r["compliant"], r["total"], "-" if r["pct"] is None else f"{r['pct']:.1f}"))
    low = [r["check"] for r in counts if args.fail_under is not None and r["pct"] is not None and r["pct"] < args.fail_under]
    if low:
        print(f"below {args.fail_under:g} %: {', '.join(low)}", file=sys.stderr)
    return 1 if low else 0


def draw(args) -> int:
    spark = _spark()
    _free(args.out, args.force)
    rows = trj.read_trj(spark, args.trj)
    scale = rows.filter("kind = 'header'").first()["scale"]
    records = trj.vehicles(rows).select(F.lit(0).cast("long").alias("clip_id"), F.col("ordinal").alias("frame"), F.col("pos").alias("row_id"), "*")
    states = project.from_grid(records, F.col("scale"), F.col("height").cast("double"))
    transforms = sidecars.read_transforms(spark, args.transforms) if args.transforms else None
    marks = None
    if args.violations:
        fps = float(frames.load_class(args.decoder)(args.video).fps)
        found = sidecars.read_violations(spark, args.violations).withColumn("clip_id", F.lit(0).cast("long"))
        marks = overlay.collapse_violations(found, fps, args.checks.split(",") if args.checks else None)
    n = painting.render(spark, args.video, args.decoder, states, args.out, scale, transforms, marks, args.trail)
    print(f"{n} frames -> {args.out}" if n else f"{args.trj} has no vehicles")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motionloom")
    commands = p.add_subparsers(required=True)

    c = commands.add_parser("run", help="a video to a track record")
    c.add_argument("--config", required=True)
    c.add_argument("--check", action="store_true", help="only check the settings: 0 if they are fine, else 2")
    c.add_argument("--json", action="store_true", help="with --check: the report as JSON")
    c.add_argument("--force", action="store_true")
    c.add_argument("--decoder", default="motionloom.sources.frames:CvVideo", help="module:Class")
    c.add_argument("--detector", default="motionloom.sources.frames:NoDetector", help="module:Class")
    c.add_argument("--work", help="a folder that the cluster shares; by default beside the record")
    c.set_defaults(call=run)

    c = commands.add_parser("postprocess", help="a track record to a trajectory file")
    c.add_argument("tracks")
    c.add_argument("--out", "-o", required=True)
    for name in ("--exclusion-zones", "--anchors", "--calibration"):
        c.add_argument(name)
    for name, default in (("--exclusion-min-fraction", 0.5), ("--pos-noise", 2.0), ("--jerk", 20.0), ("--timestep-precision", 0.0)):
        c.add_argument(name, type=float, default=default)
    c.add_argument("--force", action="store_true")
    c.set_defaults(call=to_trajectories)

    c = commands.add_parser("validate", help="checks of a trajectory file; 1 if one is below --fail-under")
    c.add_argument("path")
    c.add_argument("--boundary-margin", type=float, default=validate.MARGIN)
    c.add_argument("--max-heading-step", type=float, default=validate.HEADING_STEP)
    for name in ("--max-speed", "--max-accel", "--fail-under"):
        c.add_argument(name, type=float)
    c.add_argument("--violations-csv")
    c.add_argument("--json", action="store_true")
    c.set_defaults(call=check_trajectories)

    c = commands.add_parser("render", help="trajectories painted over the video's frames")
    c.add_argument("video")
    c.add_argument("--trj", required=True)
    c.add_argument("--out", "-o", required=True, help="a folder for the painted frames")
    for name in ("--transforms", "--violations", "--checks"):
        c.add_argument(name)
    c.add_argument("--trail", type=int, default=0, help="steps; 0: the whole path")
    c.add_argument("--decoder", default="motionloom.sources.frames:CvVideo", help="module:Class")
    c.add_argument("--force", action="store_true")
    c.set_defaults(call=draw)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.call(args)
    except config.SettingsError as e:
        print("\n".join(["the settings have problems:", *(f"  {p}" for p in e.problems)]), file=sys.stderr)
        return 2
    except (Refused, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1 if args.call is check_trajectories else 2


if __name__ == "__main__":
    sys.exit(main())
