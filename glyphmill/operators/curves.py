"""Polylines as rows of vertices (key, i, x, y): arc lengths, resampling, residuals, and contours of rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arc_lengths(rows: DataFrame, key: str) -> DataFrame:
    """rows with s, the length of the polyline up to the vertex, and t, its share of the whole (0 for a line without length)."""
    w = Window.partitionBy(key).orderBy("i")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    out = rows.withColumn("_d", step).withColumn("s", F.sum("_d").over(w)).withColumn("_l", F.sum("_d").over(Window.partitionBy(key)))
    return out.withColumn("t", F.when(F.col("_l") > 0, F.col("s") / F.col("_l")).otherwise(0.0)).drop("_d", "_l")


def resampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, k, x, y: n points at equal distances along the polyline, both ends included; a line without length gives none.

    Each segment makes the points that fall on it, so nothing is joined.
    """
    w = Window.partitionBy(key).orderBy("i")
    ends = arc_lengths(rows, key).select(key, "i", "x", "y", "t", *[F.lead(c).over(w).alias(f"{c}1") for c in ("x", "y", "t")])
    place = lambda c: F.ceil(F.round(F.col(c) * (n - 1), 9)).cast("int")
    last = F.when(F.col("t1") >= 1, F.lit(n - 1)).otherwise(place("t1") - 1)
    on = ends.filter("t1 > t").withColumn("_a", place("t")).withColumn("_b", last).filter("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    share = (F.col("k") / (n - 1) - F.col("t")) / (F.col("t1") - F.col("t"))
    at = lambda c: (F.col(c) + (F.col(f"{c}1") - F.col(c)) * share).alias(c)
    # A rounded place may fall on the end of two segments: the earlier one keeps it.
    return on.select(key, "k", "i", at("x"), at("y")).groupBy(key, "k").agg(F.min_by("x", "i").alias("x"), F.min_by("y", "i").alias("y"))


def residual(points: Column, samples: Column) -> Column:
    """Directed Hausdorff distance: the farthest that a point lies from its nearest sample."""
    d2 = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    return F.sqrt(F.array_max(F.transform(points, lambda a: F.array_min(F.transform(samples, lambda b: d2(a, b))))))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its end where the segment has no length."""
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / sq))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def split_count(radius: Column, tol: float) -> Column:
    """How many cubics approximate a circle within tol: 4 to 32."""
    k = F.ceil(2 * math.pi / F.pow(F.lit(16384.0) * tol / radius, F.lit(0.25)))
    return F.greatest(F.lit(4), F.least(F.lit(32), F.when(radius > 0, k).otherwise(4))).cast("int")


def contour_segments(values: Column, w: int, h: int, level: float) -> Column:
    """array<struct<x, y, u, v>>: marching squares over a raster at a level, pixel centres at whole coordinates.

    A corner is inside if it lies over the level. Cells with two opposite corners inside join them if the cell's mean is
    inside too. Oriented with the inside on the right (y down), so a ring around ink has a positive area. Segments without
    length are left out.
    """
    n = (w - 1) * (h - 1)

    def cell(i: Column) -> Column:
        x, y = (i % (w - 1)).cast("int"), F.floor(i / (w - 1)).cast("int")
        at = y * w + x
        tl, tr, bl, br = F.get(values, at), F.get(values, at + 1), F.get(values, at + w), F.get(values, at + w + 1)
        cut = lambda a, b: F.when(a == b, 0.5).otherwise((level - a) / (b - a))
        point = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
        sides = (point(x + cut(tl, tr), y), point(x + 1, y + cut(tr, br)), point(x + cut(bl, br), y + 1), point(x, y + cut(tl, bl)))
        corners = [v > level for v in (tl, tr, br, bl)]
        around = list(zip(sides, corners, corners[1:] + corners[:1]))
        # Clockwise around the cell, the contour leaves by a side from inside to outside and comes back by the opposite kind.
        out = F.array_compact(F.array(*[F.when(a & ~b, side) for side, a, b in around]))
        back = F.array_compact(F.array(*[F.when(~a & b, side) for side, a, b in around]))
        straight = (F.size(out) < 2) | (corners[0] == ((tl + tr + br + bl) / 4 > level))
        line = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v"))
        return F.zip_with(out, F.when(straight, back).otherwise(F.reverse(back)), line)

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell))
    return F.filter(found, lambda s: F.hypot(s["u"] - s["x"], s["v"] - s["y"]) > 1e-9)
