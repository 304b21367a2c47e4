"""Boxes as column expressions. A box is four columns with a prefix: x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def width(b) -> Column:
    return b[2] - b[0]


def height(b) -> Column:
    return b[3] - b[1]


def area(b) -> Column:
    return width(b).cast("bigint") * height(b)


def overlap_x(a, b) -> Column:
    """Shared width; negative for boxes apart."""
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0])


def overlap_y(a, b) -> Column:
    return F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def overlap_area(a, b) -> Column:
    """Shared area; 0 for boxes apart."""
    zero = F.lit(0)
    return F.greatest(zero, overlap_x(a, b)).cast("bigint") * F.greatest(zero, overlap_y(a, b))


def iou(a, b) -> Column:
    """Shared area over joint area; single areas count 1 at least, so the division is safe wherever it is evaluated."""
    shared = overlap_area(a, b)
    one = F.lit(1).cast("bigint")
    return shared / (F.greatest(one, area(a)) + F.greatest(one, area(b)) - shared).cast("double")


def contains(outer, inner) -> Column:
    """Whether the outer box holds the inner one, edges included."""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def centre_x(b) -> Column:
    return (b[0] + b[2]) / 2


def centre_y(b) -> Column:
    return (b[1] + b[3]) / 2


def gap(a, b) -> Column:
    """Chebyshev distance between two boxes; 0 if they meet."""
    return F.greatest(F.lit(0), b[0] - a[2], a[0] - b[2], b[1] - a[3], a[1] - b[3])


def clamped(b, w: Column, h: Column) -> dict[str, Column]:
    """A box inside a page of w by h, one pixel wide and tall at least."""
    x1 = F.greatest(F.lit(0), F.least(b[0], w - 1))
    y1 = F.greatest(F.lit(0), F.least(b[1], h - 1))
    x2 = F.greatest(x1 + 1, F.least(b[2], w))
    y2 = F.greatest(y1 + 1, F.least(b[3], h))
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "width": x2 - x1, "height": y2 - y1}


def ordered_corners(b) -> dict[str, Column]:
    """Corners swapped where the first lies beyond the second."""
    return {"x1": F.least(b[0], b[2]), "y1": F.least(b[1], b[3]), "x2": F.greatest(b[0], b[2]), "y2": F.greatest(b[1], b[3])}


def quad_box(quad: Column) -> dict[str, Column]:
    """The integer box around an array of points (x, y)."""
    xs = F.transform(quad, lambda p: p["x"])
    ys = F.transform(quad, lambda p: p["y"])
    return {"x1": F.array_min(xs).cast("int"), "y1": F.array_min(ys).cast("int"), "x2": F.array_max(xs).cast("int"), "y2": F.array_max(ys).cast("int")}


def baseline_angle(quad: Column) -> Column:
    """Degrees of the first side of a quad, one decimal."""
    a, b = F.element_at(quad, 1), F.element_at(quad, 2)
    return F.round(F.degrees(F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double"))), 1)
