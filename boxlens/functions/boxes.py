"""Columns over boxes x1, y1, x2, y2: pixels, counted from 1, both ends inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def width(p: str = "") -> Column:
    return _c(f"{p}x2") - _c(f"{p}x1") + 1


def height(p: str = "") -> Column:
    return _c(f"{p}y2") - _c(f"{p}y1") + 1


def area(p: str = "") -> Column:
    return width(p) * height(p)


def intersection(p: str, q: str) -> Column:
    """Pixels in both boxes, 0 if they are apart."""
    w = F.least(f"{p}x2", f"{q}x2") - F.greatest(f"{p}x1", f"{q}x1") + 1
    h = F.least(f"{p}y2", f"{q}y2") - F.greatest(f"{p}y1", f"{q}y1") + 1
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def intersects(p: str, q: str) -> Column:
    """As conditions on the sides, which a join can test before any arithmetic."""
    return (_c(f"{p}x1") <= _c(f"{q}x2")) & (_c(f"{q}x1") <= _c(f"{p}x2")) & (_c(f"{p}y1") <= _c(f"{q}y2")) & (_c(f"{q}y1") <= _c(f"{p}y2"))


def iou(p: str, q: str) -> Column:
    """Intersection over union. Whole numbers until the one division."""
    inter = intersection(p, q)
    return inter.cast("double") / (area(p) + area(q) - inter)


def coverage(p: str, q: str) -> Column:
    """The share of box q that box p covers: what suppression compares, not the same as iou."""
    return intersection(p, q).cast("double") / area(q)


def clipped(w: Column | int, h: Column | int) -> list[Column]:
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return [F.greatest("x1", F.lit(1)).alias("x1"), F.greatest("y1", F.lit(1)).alias("y1"), F.least("x2", lit(w)).alias("x2"), F.least("y2", lit(h)).alias("y2")]


def mirrored(w: Column | int) -> list[Column]:
    w = F.lit(w) if isinstance(w, int) else w
    return [(w - F.col("x2") + 1).alias("x1"), F.col("y1"), (w - F.col("x1") + 1).alias("x2"), F.col("y2")]


def sigmoid(x: Column, slope: float = 1.5) -> Column:
    return 1 / (1 + F.exp(-slope * x))
