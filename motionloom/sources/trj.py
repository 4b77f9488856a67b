"""The SSAM trajectory format, version 1.04 (and 3.0 for reading), as a Spark data source named ``trj``.

Little-endian records, each after a tag byte: 0 FORMAT (endian char, version),
1 DIMENSIONS (units, scale, four bounds), 2 TIMESTEP (time), 3 VEHICLE (ids,
lane, bumper points, length, width, speed, acceleration).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT, DIMENSIONS, TIMESTEP, VEHICLE = range(4)
_FIELDS = ("vehicle_id", "link_id", "lane_id", "front_x", "front_y", "rear_x", "rear_y", "length", "width", "speed", "accel")
SCHEMA = "path string, kind string, ordinal long, ts double, pos long, vehicle_id long, link_id long, lane_id int, front_x double, front_y double, rear_x double, rear_y double, length double, width double, speed double, accel double, units int, scale double, min_x int, min_y int, max_x int, max_y int, version double"


@dataclass
class Header:
    version: float = 1.04
    units: int = 1
    scale: float = 1.0
    bounds: tuple[int, int, int, int] = (0, 0, 0, 0)


def pack_header(scale: float, width: int, height: int, units: int = 1) -> bytes:
    if scale <= 0:
        raise ValueError("scale must be positive")
    return struct.pack("<BBf", FORMAT, ord("L"), 1.04) + struct.pack("<BBfiiii", DIMENSIONS, units, scale, 0, 0, width, height)


def pack_timestep(ts: float) -> bytes:
    return struct.pack("<Bf", TIMESTEP, ts)


def pack_vehicle(v) -> bytes:
    return struct.pack("<BiiBffffffff", VEHICLE, *v)


def parse(data: bytes, dialect: str = "strict") -> Iterator[tuple[str, tuple]]:
    """('header', Header), ('timestep', (ts,)) and ('vehicle', fields) of a file.

    strict: little-endian 1.04 only. tolerant: both byte orders and the
    elevation fields of version 3. lenient: stops quietly at an unknown or cut
    record.
    """
    at, order, extra, seen, head = 0, "<", 0, False, None
    if not data and dialect != "lenient":
        raise ValueError("the file is empty")
    if dialect == "tolerant" and data[0] != FORMAT:
        raise ValueError("the file doesn't begin with FORMAT")

    def take(form: str):
        nonlocal at
        size = struct.calcsize(order + form)
        if at + size > len(data):
            raise ValueError(f"the record at byte {at - 1} is cut short")
        got = struct.unpack_from(order + form, data, at)
        at += size
        return got

    version = 1.04
    while at < len(data):
        tag = data[at]
        at += 1
        try:
            if tag == FORMAT:
                mark = data[at : at + 1]
                at += 1
                if dialect == "tolerant":
                    if mark not in (b"L", b"B"):
                        raise ValueError(f"unknown byte order {mark!r}")
                    order = "<" if mark == b"L" else ">"
                (version,) = take("f")
                if version >= 2.999 and dialect != "strict":
                    (z,) = take("B")
                    extra = 8 if z else 0
            elif tag == DIMENSIONS:
                units, scale, *bounds = take("Bfiiii")
                head = Header(version, units, scale, tuple(bounds))
                yield "header", head
            elif tag == TIMESTEP:
                if head is None and dialect != "lenient":
                    raise ValueError("TIMESTEP before DIMENSIONS")
                seen = True
                yield "timestep", take("f")
            elif tag == VEHICLE:
                if not seen:
                    raise ValueError("VEHICLE before TIMESTEP")
                row = take("iiBffffffff")
                if extra:
                    take(f"{extra}s")
                yield "vehicle", row
            else:
                raise ValueError(f"unknown record {tag} at byte {at - 1}")
        except ValueError:
            if dialect == "lenient":
                return
            raise


def rows_of(data: bytes, path: str, dialect: str) -> Iterator[tuple]:
    """Rows of SCHEMA: one header row, one for each timestep, one for each vehicle."""
    head, ordinal, ts, pos = Header(), -1, 0.0, 0
    for kind, value in parse(data, dialect):
        if kind == "header":
            head = value
            yield (path, kind, None, None, None, *[None] * len(_FIELDS), head.units, head.scale, *head.bounds, head.version)
        elif kind == "timestep":
            ordinal, ts, pos = ordinal + 1, value[0], 0
            yield (path, kind, ordinal, ts, None, *[None] * len(_FIELDS), head.units, head.scale, *head.bounds, head.version)
        else:
            yield (path, kind, ordinal, ts, pos, *value, head.units, head.scale, *head.bounds, head.version)
            pos += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TrjReader(DataSourceReader):
    """One partition for each file: records have no sync marks, so a file is read from its start."""

    def __init__(self, options: dict):
        self.path, self.dialect = options["path"], options.get("dialect", "strict")

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".trj"))
        prefix = self.path[: len(self.path) - len(root)] if "://" in self.path else ""
        return [_File(prefix + f) for f in files]

    def read(self, partition):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(root) as f:
            yield from rows_of(f.read(), partition.path, self.dialect)


class TrjDataSource(DataSource):
    """format("trj"), option dialect: strict, tolerant or lenient."""

    @classmethod
    def name(cls) -> str:
        return "trj"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TrjReader:
        return TrjReader(self.options)


def read_trj(spark: SparkSession, path: str, dialect: str = "strict") -> DataFrame:
    spark.dataSource.register(TrjDataSource)
    return spark.read.format("trj").option("dialect", dialect).load(path)


def vehicles(trj: DataFrame) -> DataFrame:
    return trj.filter("kind = 'vehicle'").select("path", "ordinal", "ts", "pos", *_FIELDS, "scale", F.col("max_y").alias("height"))


def packed(states: DataFrame, clips: DataFrame, height_scale: bool = True) -> DataFrame:
    """The bytes of each clip's file as rows (clip_id, data). states: grid units, with frame, ts, track_row, row_id.

    A file is one ordered stream, so a clip's records meet in one task. A clip
    without records gives a file of its header alone.
    """
    cols = ["clip_id", "frame", "ts", "track_row", "row_id", *_FIELDS]
    df = states.withColumns({"link_id": F.lit(0), "lane_id": F.lit(0)}).select(*cols)
    canvas = clips.select("clip_id", "width", "height", "scale")

    def pack(frame, clip):
        if clip.empty:
            return clip[["clip_id"]].assign(data=b"")
        frame = frame.sort_values(["frame", "track_row", "row_id"], kind="stable")
        first = clip.iloc[0]
        out = [pack_header(float(first["scale"]), int(first["width"]), int(first["height"]))]
        kind = np.dtype([("tag", "u1"), ("vehicle_id", "<i4"), ("link_id", "<i4"), ("lane_id", "u1"), *((f, "<f4") for f in _FIELDS[3:])])
        if len(frame) and frame["vehicle_id"].abs().max() > 0x7FFFFFFF:
            raise ValueError("a vehicle id doesn't fit 32 bits")
        for _, rows in frame.groupby("frame", sort=False):
            block = np.empty(len(rows), kind)
            block["tag"] = VEHICLE
            for f in _FIELDS:
                block[f] = rows[f].to_numpy()
            out += [pack_timestep(float(rows["ts"].iloc[0])), block.tobytes()]
        return clip[["clip_id"]].head(1).assign(data=[b"".join(out)])

    return df.groupBy("clip_id").cogroup(canvas.groupBy("clip_id")).applyInPandas(pack, "clip_id long, data binary")


def write_trj(states: DataFrame, clips: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Write <folder>/<clip_id>.trj for each clip, on the executors; returns (clip_id, path, bytes)."""

    def put(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for frame in batches:
            done = []
            for clip, data in zip(frame["clip_id"], frame["data"], strict=True):
                name = f"{root}/{clip}.trj"
                if not force and store.get_file_info(name).type != fs.FileType.NotFound:
                    raise FileExistsError(name)
                with store.open_output_stream(f"{name}.part") as f:
                    f.write(data)
                store.move(f"{name}.part", name)
                done.append((clip, f"{folder}/{clip}.trj", len(data)))
            yield pd.DataFrame(done, columns=["clip_id", "path", "bytes"])

    return packed(states, clips).mapInPandas(put, "clip_id long, path string, bytes long")
