"""Schemas of the tables that the operators pass on. Every table carries ``clip_id``."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


CLIPS = _struct("clip_id:long width:int height:int fps:double total_frames:long scale:double")
#: The stored track record, as it is on disk.
TRACK_RECORD = _struct("frame:long track_id:long cx:double cy:double w:double h:double vehicle_class:string score:double")
OBSERVATIONS = _struct("clip_id:long row_id:long frame:long track_id:long cx:double cy:double w:double h:double vehicle_class:string score:double")
DETECTIONS = _struct("clip_id:long frame:long det_ind:int x:double y:double w:double h:double score:double vehicle_class:string")
TRANSFORMS = _struct("clip_id:long frame:long a:double b:double c:double d:double tx:double ty:double")
STATES = _struct("clip_id:long frame:long ts:double vehicle_id:long row_id:long x:double y:double hx:double hy:double length:double width:double vx:double vy:double speed:double accel:double")
#: A vehicle record of a trajectory file, in grid units.
RECORDS = _struct("clip_id:long ordinal:long ts:double pos:long vehicle_id:long front_x:double front_y:double rear_x:double rear_y:double length:double width:double speed:double accel:double")
VEHICLE_CLASSES = ("car", "motorcycle", "bus", "truck")
