"""Planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def manhattan(ax, ay, bx, by) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def area(x1, y1, x2, y2) -> Column:
    return (x2 - x1) * (y2 - y1)


def intersection(a, b) -> Column:
    """Common area of two boxes of four columns each."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection(a, b)
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_ratio(box, zone) -> Column:
    """Share of the box that lies in the zone."""
    return F.when(area(*box) > 0, intersection(box, zone) / area(*box)).otherwise(F.lit(0.0))


def project(h, x, y) -> tuple[Column, Column]:
    """Perspective projection by nine coefficients; null where the denominator is zero."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) > 1e-12
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def inverse(h) -> list[Column]:
    """Nine coefficients of the inverse mapping (the adjugate; its scale doesn't matter)."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def roi_radius(elapsed, quality) -> Column:
    """Search radius: it grows with time and with poor quality, between half a unit and ten."""
    q = clamp(F.coalesce(quality, F.lit(1.0)), 0.0, 1.0)
    return clamp((1.5 + 1.5 * F.greatest(F.lit(0.0), elapsed)) * (1 + (1 - q)), 0.5, 10.0)


def match_confidence(kind: Column, dist: Column) -> Column:
    base = F.when(kind == "exact", 0.95).when(kind == "closest", 0.70)
    return F.when(base.isNotNull() & dist.isNotNull(), clamp(base - 0.1 * dist, 0.0, 1.0))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace over two arrays of vertices."""
    n = F.size(xs)
    at = lambda a, i: F.element_at(a, (i % n + 1).cast("int"))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def in_polygon(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""
    n = F.size(xs)
    at = lambda a, i: F.element_at(a, (i % n + 1).cast("int"))

    def crosses(i):
        x1, y1, x2, y2 = at(xs, i), at(ys, i), at(xs, i + 1), at(ys, i + 1)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def quadrant(x: Column, y: Column, width: int, height: int) -> Column:
    top, left = y < height // 2, x < width // 2
    return F.when(top & left, "top_left").when(top, "top_right").when(left, "bottom_left").otherwise("bottom_right")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
