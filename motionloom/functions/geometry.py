"""Affine, vector and polygon functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Affine transform columns: x' = a x + b y + tx, y' = c x + d y + ty.
COEFFICIENTS = ("a", "b", "tx", "c", "d", "ty")


def affine(a, b, tx, c, d, ty) -> Column:
    """A transform as a struct of six doubles."""
    return F.struct(*(x.cast("double").alias(n) if isinstance(x, Column) else F.lit(float(x)).alias(n) for n, x in zip(COEFFICIENTS, (a, b, tx, c, d, ty), strict=True)))


def identity() -> Column:
    return affine(1, 0, 0, 0, 1, 0)


def apply(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["tx"], t["c"] * x + t["d"] * y + t["ty"]


def compose(outer: Column, inner: Column) -> Column:
    """The transform that does ``inner`` first."""
    o, i = outer, inner
    return affine(
        o["a"] * i["a"] + o["b"] * i["c"], o["a"] * i["b"] + o["b"] * i["d"], o["a"] * i["tx"] + o["b"] * i["ty"] + o["tx"],
        o["c"] * i["a"] + o["d"] * i["c"], o["c"] * i["b"] + o["d"] * i["d"], o["c"] * i["tx"] + o["d"] * i["ty"] + o["ty"],
    )


def determinant(t: Column) -> Column:
    return t["a"] * t["d"] - t["b"] * t["c"]


def inverse(t: Column) -> Column:
    """The inverse; a singular transform raises."""
    det = determinant(t)
    det = F.when(det == 0, F.raise_error(F.lit("transform has no inverse")).cast("double")).otherwise(det)
    a, b, c, d = t["d"] / det, -t["b"] / det, -t["c"] / det, t["a"] / det
    return affine(a, b, -(a * t["tx"] + b * t["ty"]), c, d, -(c * t["tx"] + d * t["ty"]))


def scale_of(t: Column) -> Column:
    return F.sqrt(F.abs(determinant(t)))


def decompose(t: Column) -> dict[str, Column]:
    """Translation length, rotation in degrees and scale of a similarity."""
    return {"translation": F.hypot(t["tx"], t["ty"]), "rotation": F.degrees(F.atan2(t["c"], t["a"])), "scale": F.hypot(t["a"], t["c"])}


def magnitude(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def normalized(x: Column, y: Column) -> tuple[Column, Column]:
    """The unit vector; the zero vector raises."""
    m = F.hypot(x, y)
    m = F.when(m == 0, F.raise_error(F.lit("zero vector has no direction")).cast("double")).otherwise(m)
    return x / m, y / m


def heading_from_angle(radians: Column) -> tuple[Column, Column]:
    return F.cos(radians), F.sin(radians)


def reversed_heading(hx: Column, hy: Column) -> tuple[Column, Column]:
    return -hx, -hy


def angle_step(a: Column, b: Column) -> Column:
    """Smallest unsigned difference of two angles (radians), in degrees up to 180."""
    d = F.pmod(F.degrees(F.abs(a - b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def point_in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule over an array of structs (x, y); fewer than 3 vertices: outside."""
    n = F.size(vertices)

    def crossed(inside: Column, i: Column) -> Column:
        p, q = F.get(vertices, i), F.get(vertices, F.pmod(i + n - 1, n))
        spans = (p["y"] > y) != (q["y"] > y)
        at = F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]
        return F.when(spans & (x < at), ~inside).otherwise(inside)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossed)).otherwise(F.lit(False))


def bounds_of(vertices: Column) -> Column:
    """Smallest box around the vertices, as a struct for a cheap test before point_in_polygon."""
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def in_bounds(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def map_polygon(t: Column, vertices: Column) -> Column:
    def moved(v: Column) -> Column:
        x, y = apply(t, v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(vertices, moved)


def polygon_area(vertices: Column) -> Column:
    """Shoelace area; 0 below 3 vertices."""
    n = F.size(vertices)

    def added(s: Column, i: Column) -> Column:
        p, q = F.get(vertices, i), F.get(vertices, F.pmod(i + 1, n))
        return s + (p["x"] * q["y"] - q["x"] * p["y"])

    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), added)) / 2).otherwise(F.lit(0.0))


def _half_plane(vertices: Column, keep, meet) -> Column:
    """One step of polygon clipping: the part of the polygon where ``keep`` holds."""
    n = F.size(vertices)

    def edge(i: Column) -> Column:
        p, q = F.get(vertices, F.pmod(i + n - 1, n)), F.get(vertices, i)
        none = F.array().cast("array<struct<x:double,y:double>>")
        here, cross = F.array(F.struct(q["x"].alias("x"), q["y"].alias("y"))), F.array(meet(p, q))
        return F.when(keep(q), F.when(keep(p), here).otherwise(F.concat(cross, here))).otherwise(F.when(keep(p), cross).otherwise(none))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), edge))).otherwise(vertices)


def _step(keep, meet):
    return lambda v: _half_plane(v, keep, meet)


def clip_to_rectangle(vertices: Column, width: Column, height: Column) -> Column:
    """The polygon's part within [0, width] x [0, height], edges included."""

    def at_x(limit):
        def meet(p, q):
            return F.struct(limit.cast("double").alias("x"), (p["y"] + (q["y"] - p["y"]) * F.try_divide(limit - p["x"], q["x"] - p["x"])).alias("y"))

        return meet

    def at_y(limit):
        def meet(p, q):
            return F.struct((p["x"] + (q["x"] - p["x"]) * F.try_divide(limit - p["y"], q["y"] - p["y"])).alias("x"), limit.cast("double").alias("y"))

        return meet

    zero = F.lit(0.0)
    for keep, meet in (
        (lambda v: v["x"] >= zero, at_x(zero)), (lambda v: v["x"] <= width, at_x(width)),
        (lambda v: v["y"] >= zero, at_y(zero)), (lambda v: v["y"] <= height, at_y(height)),
    ):
        # Bound as a lambda variable, the polygon of the step before is computed once.
        vertices = F.get(F.transform(F.array(vertices), _step(keep, meet)), F.lit(0))
    return vertices


def rectangle(width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    corners: Sequence[tuple[Column, Column]] = ((zero, zero), (width, zero), (width, height), (zero, height))
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))


def clipped_overlap(t: Column, width: Column, height: Column) -> Column:
    """Share of the canvas that the moved canvas still covers, at most 1."""
    part = clip_to_rectangle(map_polygon(t, rectangle(width, height)), width, height)
    share = lambda v: F.when(F.size(v) >= 3, F.least(F.lit(1.0), polygon_area(v) / (width * height))).otherwise(F.lit(0.0))
    return F.get(F.transform(F.array(part), share), F.lit(0))
