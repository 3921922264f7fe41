"""Rectangle arithmetic on columns x, y, w, h (with a prefix)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def overlap_area(a: str, b: str) -> Column:
    """Clamped intersection area of rectangles with column prefixes a and b."""
    side = lambda p, s: F.greatest(
        F.lit(0), F.least(_c(a, p) + _c(a, s), _c(b, p) + _c(b, s)) - F.greatest(_c(a, p), _c(b, p))
    )
    return side("x", "w") * side("y", "h")


def overlaps(a: str, b: str, gap: float = 0) -> Column:
    """Do they overlap, or lie within the gap of each other?"""
    near = lambda p, s: (_c(a, p) <= _c(b, p) + _c(b, s) + gap) & (_c(b, p) <= _c(a, p) + _c(a, s) + gap)
    return near("x", "w") & near("y", "h")


def area(a: str) -> Column:
    return _c(a, "w") * _c(a, "h")


def iou(a: str, b: str) -> Column:
    inter = overlap_area(a, b)
    return inter / (area(a) + area(b) - inter)


def covered(inner: str, outer: str) -> Column:
    """Part of inner's area that lies in outer."""
    return overlap_area(inner, outer) / F.greatest(F.lit(1), area(inner))


def bounds(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> list[Column]:
    """Aggregates of the bounding box of a group."""
    return [
        F.min(x).alias("x"), F.min(y).alias("y"), (F.max(F.col(x) + F.col(w)) - F.min(x)).alias("w"), (F.max(F.col(y) + F.col(h)) - F.min(y)).alias("h"),
    ]


def centre_in(point_x: Column, point_y: Column, b: str) -> Column:
    return (point_x >= _c(b, "x")) & (point_x <= _c(b, "x") + _c(b, "w")) & (point_y >= _c(b, "y")) & (point_y <= _c(b, "y") + _c(b, "h"))


def visual_column(x: Column, w: Column, page_width: Column) -> Column:
    """full, right or left by width and centre."""
    return F.when(w > page_width * 0.5, "full").when(x + w / 2 > page_width * 0.5, "right").otherwise("left")


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def page_units(box: Column, width: Column, height: Column) -> list[Column]:
    """A 0..1000 box as page units with two decimals."""
    at = lambda i, size: F.round(F.get(box, F.lit(i)) / 1000 * size, 2)
    return [at(0, width).alias("x"), at(1, height).alias("y"), at(2, width).alias("w"), at(3, height).alias("h")]
