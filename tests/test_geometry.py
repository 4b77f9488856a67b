import math

import pytest
from pyspark.sql import functions as F

from motionloom.functions import drawing
from motionloom.functions import geometry as G


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def polygon(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
C_SHAPE = [(0, 0), (10, 0), (10, 3), (3, 3), (3, 7), (10, 7), (10, 10), (0, 10)]


@pytest.mark.parametrize(("points", "x", "y", "inside"), [(SQUARE, 5, 5, True), (SQUARE, 15, 5, False), (C_SHAPE, 7, 5, False), (C_SHAPE, 1, 5, True), (SQUARE[:2], 5, 0, False)])
def test_point_in_polygon(spark, points, x, y, inside):
    assert value(spark, G.point_in_polygon(F.lit(float(x)), F.lit(float(y)), polygon(points))) is inside


def test_transform_algebra(spark):
    t = G.affine(0, -2, 5, 2, 0, -1)
    r = spark.range(1).select(G.compose(t, G.inverse(t)).alias("i"), G.scale_of(t).alias("s"), G.determinant(t).alias("d")).first()
    assert [round(r["i"][c], 9) for c in ("a", "b", "tx", "c", "d", "ty")] == [1, 0, 0, 0, 1, 0]
    assert r["s"] == pytest.approx(2) and r["d"] == pytest.approx(4)
    x, y = G.apply(t, F.lit(1.0), F.lit(2.0))
    assert (value(spark, x), value(spark, y)) == (1.0, 1.0)
    with pytest.raises(Exception, match="no inverse"):
        value(spark, G.inverse(G.affine(1, 2, 0, 2, 4, 0)))
    parts = G.decompose(G.affine(2 * math.cos(0.5), -2 * math.sin(0.5), 3, 2 * math.sin(0.5), 2 * math.cos(0.5), 4))
    assert [value(spark, parts[k]) for k in ("translation", "rotation", "scale")] == pytest.approx([5, math.degrees(0.5), 2])


@pytest.mark.parametrize(("t", "share"), [((1, 0, 50, 0, 1, 0), 0.5), ((1, 0, 200, 0, 1, 0), 0.0), ((0.5, 0, 25, 0, 0.5, 25), 0.25), ((1, 0, 0, 0, 1, 0), 1.0), ((3, 0, -10, 0, 3, -10), 1.0)])
def test_clipped_overlap(spark, t, share):
    assert value(spark, G.clipped_overlap(G.affine(*t), F.lit(100.0), F.lit(100.0))) == pytest.approx(share)


def test_area_vectors_angles(spark):
    assert value(spark, G.polygon_area(polygon(SQUARE))) == 100
    assert value(spark, G.polygon_area(polygon(SQUARE[:2]))) == 0
    assert value(spark, G.angle_step(F.lit(math.radians(350)), F.lit(math.radians(10)))) == pytest.approx(20)
    x, y = G.normalized(F.lit(3.0), F.lit(4.0))
    assert (value(spark, x), value(spark, y)) == pytest.approx((0.6, 0.8))
    with pytest.raises(Exception, match="no direction"):
        value(spark, G.normalized(F.lit(0.0), F.lit(0.0))[0])


def test_drawing(spark):
    import colorsys

    for i in (0, 1, 42, 999):
        r, g, b = colorsys.hsv_to_rgb((i * 0.618033988749895) % 1, 0.85, 0.95)
        got = value(spark, drawing.colour(F.lit(i)))
        assert (got["b"], got["g"], got["r"]) == tuple(int(v * 255) for v in (b, g, r))
    assert value(spark, drawing.label(F.lit(7), F.lit(2.5))) == "v7  2"
    assert value(spark, drawing.progress(F.lit(3), F.lit(0))) == 0
    assert value(spark, drawing.timecode_seconds(F.lit("01:02:03.5"))) == 3723.5
