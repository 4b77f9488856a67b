"""Colours, labels and time codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fractional part of the golden ratio: hues of consecutive ids lie far apart.
_TURN = 0.618033988749895


def colour(vehicle_id: Column) -> Column:
    """A vehicle's colour as a struct b, g, r of 0 to 255: hue from the id, saturation 0.85, value 0.95."""
    hue = F.pmod(vehicle_id.cast("double") * _TURN, F.lit(1.0)) * 6.0
    sector, f = F.floor(hue).cast("int"), hue - F.floor(hue)
    v, s = 0.95, 0.85
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *six: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in six)), sector % 6 + 1)
    r, g, b = pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)
    return F.struct(*((x * 255).cast("int").alias(n) for n, x in (("b", b), ("g", g), ("r", r))))


def label(vehicle_id: Column, speed: Column) -> Column:
    """v<id> and the speed rounded half to even."""
    return F.concat(F.lit("v"), vehicle_id.cast("string"), F.lit("  "), F.rint(speed).cast("long").cast("string"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(done.cast("double"), total.cast("double"))))


def timecode_seconds(value: Column) -> Column:
    """SS(.ms), MM:SS or HH:MM:SS as seconds; null if it isn't one."""
    parts = F.split(F.trim(value), ":")
    n = F.size(parts)
    seconds = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60.0 + F.try_to_number(p, F.lit("999999.999999")).cast("double"))
    return F.when((n <= 3) & F.forall(parts, lambda p: p.rlike(r"^\d+(\.\d+)?$")), seconds)
