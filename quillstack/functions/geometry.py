"""Boxes in pixels and in shares of the page, polygons, and time budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2, y2)


def to_shares(px: Column, width: Column, height: Column) -> Column:
    """Null where the page has no width or height."""
    return box(*(F.try_divide(px[i], side) for i, side in enumerate((width, height, width, height))))


def to_pixels(shares: Column, width: Column, height: Column) -> Column:
    """Truncates, so going to shares and back may lose a pixel."""
    return box(*((shares[i] * side).cast("int") for i, side in enumerate((width, height, width, height))))


def normal_shares(shares: Column) -> Column:
    """Ordered and inside the page; null for anything not finite or without area."""
    finite = F.forall(shares, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.size(shares) == 4)
    v = [clamp(shares[i], 0.0, 1.0) for i in range(4)]
    x1, x2, y1, y2 = F.least(v[0], v[2]), F.greatest(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[1], v[3])
    return F.when(finite & (x2 - x1 > 1e-6) & (y2 - y1 > 1e-6), box(x1, y1, x2, y2))


def inside_page(px: Column, width: Column, height: Column) -> Column:
    """Clamped to the page and at least a pixel wide and high."""
    def side(a: Column, b: Column, most: Column) -> tuple[Column, Column]:
        a, b = clamp(a, 0, F.greatest(most - 1, F.lit(0))), clamp(b, 0, most)
        flat = b <= a
        start = F.when(flat & (most <= 1), F.lit(0)).when(flat, F.least(a, most - 1)).otherwise(a)
        end = F.when(flat & (most <= 1), most).when(flat, F.least(most, F.least(a, most - 1) + 1)).otherwise(b)
        return start, end

    (x1, x2), (y1, y2) = side(px[0], px[2], width), side(px[1], px[3], height)
    return box(x1, y1, x2, y2)


def points_inside(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.struct(clamp(p["x"], 0, F.greatest(width - 1, F.lit(0))).alias("x"), clamp(p["y"], 0, F.greatest(height - 1, F.lit(0))).alias("y")))


def box_of_points(points: Column, width: Column, height: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return inside_page(box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), width, height)


def rescaled_points(points: Column, old: Column, new: Column, width: Column, height: Column) -> Column:
    """Points carried from one box to another, truncated and clamped to the page."""
    at = lambda v, i: (new[i] + (v - old[i]) / F.greatest(old[i + 2] - old[i], F.lit(1)) * F.greatest(new[i + 2] - new[i], F.lit(1))).cast("int")
    return points_inside(F.transform(points, lambda p: F.struct(at(p["x"], 0).alias("x"), at(p["y"], 1).alias("y"))), width, height)


def meets(a: Column, x1, y1, x2, y2) -> Column:
    """Whether a box and a rectangle overlap."""
    return (a[0] < x2) & (a[2] > x1) & (a[1] < y2) & (a[3] > y1)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(clamp(F.try_divide((px - ax) * dx + (py - ay) * dy, length), 0.0, 1.0))
    return F.sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))


def timeouts(blocks: Column, base: int = 300, each: int = 30, least: int = 600, most: int = 14_400, verify: int = 30 * 60) -> Column:
    """Soft and hard limits in seconds for a job of so many blocks."""
    soft = clamp(base + blocks * each + F.least(blocks * 5, F.lit(verify)), least, most)
    return F.struct(soft.alias("soft"), (soft + 600).alias("hard"))
