"""Vectors, boxes and polygons as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(p: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("int"))


def polygon_box(polygon: Column) -> Column:
    """The box around a polygon of [x, y] points, truncated to whole pixels."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(*(f(v).cast("int").alias(n) for n, f, v in (("x1", F.array_min, xs), ("y1", F.array_min, ys), ("x2", F.array_max, xs), ("y2", F.array_max, ys))))


def edge_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("x1"), top.alias("y1"), (left + width).alias("x2"), (top + height).alias("y2"))


def box_size(box: Column) -> Column:
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"))


def order_points(points: Column) -> Column:
    """Four [x, y] points as [top left, top right, bottom right, bottom left]; of equals, the first."""
    total = F.transform(points, lambda p: p[0] + p[1])
    slope = F.transform(points, lambda p: p[1] - p[0])
    at = lambda values, pick: F.element_at(points, F.array_position(values, pick(values)).cast("int"))
    return F.array(at(total, F.array_min), at(slope, F.array_min), at(total, F.array_max), at(slope, F.array_max))


def confidence(percent: Column) -> Column:
    return percent.cast("int") / F.lit(100.0)


def zipped(a: Column, b: Column) -> Column:
    """An array of (a, b) by position, as long as the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def angle(a: Column, b: Column) -> Column:
    """Of the line from point a to point b, in degrees."""
    return F.degrees(F.atan2(b[1] - a[1], b[0] - a[0]))


def nearly_level(degrees: Column, most: float = 45.0) -> Column:
    return F.abs(degrees) < most
