"""Small rasters and closed polylines held as arrays: expressions inside one row, no shuffle."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rescaled(values: Column, width: str = "double") -> Column:
    """Values mapped to [0, 1] by their least and greatest; a flat raster is 0. width: the type in which the range is taken, and to which it is rounded."""
    lo, hi = F.array_min(values), F.array_max(values)
    # Beside each value, so that the range is taken once; a lambda that holds another one's variable can't be an argument of a kernel.
    ends = F.array_repeat(F.struct(lo.alias("lo"), hi.alias("hi"), (hi.cast(width) - lo.cast(width)).alias("range")), F.size(values))
    return F.zip_with(values, ends, lambda v, r: F.when(r["hi"] > r["lo"], (v - r["lo"]) / r["range"]).otherwise(0.0))


def mask(values: Column, level: float = 0.5) -> Column:
    return F.transform(values, lambda v: v >= level)


def shifted(m: Column, w: int, h: int, dx: int, dy: int) -> Column:
    """A mask moved by whole pixels; what enters is false."""
    def pixel(i: Column) -> Column:
        x, y = i % w - dx, F.floor(i / w) - dy
        return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(m, (y * w + x).cast("int"))).otherwise(False)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), pixel)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks; 1 where both are empty."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda v: v))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x | y), lambda v: v))
    return F.when(either == 0, 1.0).otherwise(both / either)


def block_means(values: Column, w: int, h: int) -> Column:
    """Means of 2 x 2 blocks."""
    n = (w // 2) * (h // 2)

    def block(i: Column) -> Column:
        at = (F.floor(i / (w // 2)) * 2 * w + (i % (w // 2)) * 2).cast("int")
        return (F.get(values, at) + F.get(values, at + 1) + F.get(values, at + w) + F.get(values, at + w + 1)) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), block)


def _ring(p: Column, f) -> Column:
    n = F.size(p)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(F.get(p, i), F.get(p, (i + 1) % n)))


def points(values: Column) -> Column:
    """Pairs of values as x, y."""
    whole = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values), F.lit(2))), lambda i: 2 * i + 1 < F.size(values))
    return F.transform(whole, lambda i: F.struct(F.get(values, 2 * i).cast("double").alias("x"), F.get(values, 2 * i + 1).cast("double").alias("y")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(p: Column) -> Column:
    return total(_ring(p, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def perimeter(p: Column) -> Column:
    return total(_ring(p, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))))


def dilated(m: Column, w: int, h: int) -> Column:
    """A mask and its four neighbours; the edges wrap around."""
    at = lambda x, y: F.get(m, (F.pmod(y, F.lit(h)) * w + F.pmod(x, F.lit(w))).cast("int"))

    def pixel(i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        return at(x, y) | at(x - 1, y) | at(x + 1, y) | at(x, y - 1) | at(x, y + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), pixel)


def padded(values: Column, w: int, h: int) -> Column:
    """A raster with a border of one pixel of zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.concat(zeros(1), F.slice(values, y * w + 1, F.lit(w)), zeros(1)))
    return F.concat(zeros(w + 2), F.flatten(rows), zeros(w + 2))


def _centre(m: Column, w: int) -> Column:
    """struct<n, x, y>: set pixels and their mean place."""
    at = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i))
    mean = lambda f: F.try_divide(F.aggregate(at, F.lit(0).cast("bigint"), lambda a, i: a + f(i)), F.size(at))
    return F.struct(F.size(at).alias("n"), mean(lambda i: i % w).alias("x"), mean(lambda i: F.floor(i / w)).alias("y"))


#: Shifts tried on either side of the one that brings the centres together.
REACH = 4


def aligned(ref: Column, other: Column, w: int, h: int) -> Column:
    """struct<dx, dy, score>: the shift of mask `other` with the greatest intersection over union with mask ref.

    Of the 81 shifts around the difference of both centres (rounded half to even) the best, among equals the least dy, then
    the least dx. (0, 0, 0) where either mask is empty. The kernel only counts; the choice is an expression.
    """

    @F.pandas_udf("array<struct<dy:int,dx:int,both:int,either:int>>")
    def counts(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(a, b, x0, y0):
            if a is None or b is None or pd.isna(x0) or pd.isna(y0):
                return None
            a, b, out = np.asarray(a, bool).reshape(h, w), np.asarray(b, bool).reshape(h, w), []
            for dy in range(int(y0) - REACH, int(y0) + REACH + 1):
                for dx in range(int(x0) - REACH, int(x0) + REACH + 1):
                    moved = b[max(0, -dy) : max(0, h - dy), max(0, -dx) : max(0, w - dx)]
                    under = a[max(0, dy) : max(0, h + dy), max(0, dx) : max(0, w + dx)]
                    both = int((moved & under).sum())
                    out.append({"dy": dy, "dx": dx, "both": both, "either": int(a.sum()) + int(moved.sum()) - both})
            return out

        return pd.Series([one(*r) for r in zip(a, b, x, y)])

    p, q = _centre(ref, w), _centre(other, w)
    table = counts(ref, other, F.rint(p["x"] - q["x"]), F.rint(p["y"] - q["y"]))
    scored = F.transform(table, lambda s: F.struct(F.when(s["either"] > 0, s["both"] / s["either"]).otherwise(0.0).alias("score"), (-s["dy"]).alias("up"), (-s["dx"]).alias("left")))
    best = F.array_max(scored)
    found = F.struct((-best["left"]).alias("dx"), (-best["up"]).alias("dy"), best["score"].alias("score"))
    none = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0.0).alias("score"))
    return F.when((p["n"] > 0) & (q["n"] > 0), found).otherwise(none)


def merged(observations, key: str, w: int, h: int):
    """key, alpha: the mean by pixel of observations (key, alpha, w, h, dx, dy) placed at (dx, dy) on a canvas of w x h; 0 where none covers.

    Pixels are grouped with partial means before the shuffle; a canvas comes back as one array.
    """
    pixels = observations.select(key, F.col("w").alias("_w"), "dx", "dy", F.posexplode("alpha").alias("_i", "_v"))
    x, y = F.col("_i") % F.col("_w") + F.col("dx"), F.floor(F.col("_i") / F.col("_w")) + F.col("dy")
    placed = pixels.filter((x >= 0) & (x < w) & (y >= 0) & (y < h)).select(key, (y * w + x).cast("int").alias("_i"), F.col("_v").cast("double").alias("_v"))
    empty = observations.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("_i"), F.lit(None).cast("double").alias("_v"))
    means = placed.unionByName(empty).groupBy(key, "_i").agg(F.coalesce(F.avg("_v"), F.lit(0.0)).alias("_v"))
    return means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_p")).select(key, F.transform("_p", lambda p: p["_v"]).alias("alpha"))


def chamfer(m: Column, w: int, h: int) -> Column:
    """3-4 distance of each pixel to the nearest set one; (w + h) * 8 where none is set.

    Two sweeps over the rows. As nested lambdas the distances to all set pixels took 20 s for 500 cells of 64, so this is
    a pandas UDF, with the mask as the only column it moves.
    """
    far = (w + h) * 8

    def sweep(d: np.ndarray) -> np.ndarray:
        steps = 3 * np.arange(w)
        for r in range(h):
            if r:
                above = d[r - 1]
                d[r] = np.minimum(d[r], above + 3)
                d[r, 1:] = np.minimum(d[r, 1:], above[:-1] + 4)
                d[r, :-1] = np.minimum(d[r, :-1], above[1:] + 4)
            d[r] = np.minimum.accumulate(d[r] - steps) + steps
            d[r] = (np.minimum.accumulate((d[r] + steps)[::-1]))[::-1] - steps
        return d

    def distances(masks: pd.Series) -> pd.Series:
        def one(mask):
            if mask is None:
                return None
            ink = np.asarray(mask, bool).reshape(h, w)
            return np.minimum(sweep(sweep(np.where(ink, 0, far * 8))[::-1])[::-1], far).ravel().astype(np.int32)

        return masks.map(one)

    return F.pandas_udf(distances, T.ArrayType(T.IntegerType()))(m)


def rasterized(p: Column, w: int, h: int) -> Column:
    """Even-odd mask of a closed polyline (pixel units) at pixel centres: edges count half-open in y."""
    def pixel(i: Column) -> Column:
        x, y = i % w + 0.5, F.floor(i / w) + 0.5
        cuts = _ring(p, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
        return F.size(F.filter(cuts, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), pixel)


def smoothed(values: Column, passes: int = 3) -> Column:
    """Means of three neighbours on a ring, `passes` times: one weighted mean, as the passes are a convolution."""
    weights = functools.reduce(lambda k, _: [sum(k[max(0, j - 2) : j + 1]) for j in range(len(k) + 2)], range(passes), [1])
    n = F.size(values)
    near = lambda i: functools.reduce(operator.add, [F.get(values, F.pmod(i + j - passes, n)) * k for j, k in enumerate(weights)])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: near(i) / 3**passes)


def turns(p: Column) -> Column:
    """Turning angle in degrees at each vertex of a closed polyline; 0 beside an edge without length."""
    n = F.size(p)

    def angle(i: Column) -> Column:
        a, b, c = F.get(p, F.pmod(i - 1, n)), F.get(p, i), F.get(p, F.pmod(i + 1, n))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        return F.abs(F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))

    return F.transform(F.sequence(F.lit(0), n - 1), angle)


def crossings(edges, key: str, cell: float):
    """key -> number of proper crossings among its edges (key, i, n, x, y, u, v), neighbours on the ring left out.

    A spatial grid join: an edge goes to each cell its box touches, edges meet by cell, and a pair counts in one cell
    alone, the first that both boxes touch, so that nothing needs a distinct.
    """
    lo = lambda a, b: F.floor(F.least(a, b) / cell)
    hi = lambda a, b: F.floor(F.greatest(a, b) / cell)
    boxed = edges.withColumns({"x0": lo("x", "u"), "x1": hi("x", "u"), "y0": lo("y", "v"), "y1": hi("y", "v")})
    boxed = boxed.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    a, b = boxed.alias("a"), boxed.alias("b")
    c = lambda side, name: F.col(f"{side}.{name}")
    pairs = a.join(b, (c("a", key) == c("b", key)) & (c("a", "cx") == c("b", "cx")) & (c("a", "cy") == c("b", "cy")) & (c("a", "i") < c("b", "i")))
    pairs = pairs.filter((c("a", "cx") == F.greatest("a.x0", "b.x0")) & (c("a", "cy") == F.greatest("a.y0", "b.y0")))
    pairs = pairs.filter((c("b", "i") - c("a", "i") > 1) & (c("b", "i") - c("a", "i") < c("a", "n") - 1))

    def side(e: str, x: Column, y: Column) -> Column:
        return (c(e, "u") - c(e, "x")) * (y - c(e, "y")) - (c(e, "v") - c(e, "y")) * (x - c(e, "x"))

    apart = lambda e, o: side(e, c(o, "x"), c(o, "y")) * side(e, c(o, "u"), c(o, "v")) < -1e-12
    return pairs.filter(apart("a", "b") & apart("b", "a")).groupBy(c("a", key).alias(key)).agg(F.count("*").alias("n"))


def spans(edges, key: str, w: int, h: int):
    """key, y, x0, x1: runs of set pixels (x1 exclusive) of even-odd fills of closed polylines given as edges (key, x, y, u, v).

    An edge meets the rows whose pixel centres it crosses, half-open in y; a row's crossings in order bound its runs. Work and rows
    grow with the crossings, not with pixels times edges. Runs are cut to the canvas; empty ones are left out.
    """
    row = lambda c: F.ceil(c - 0.5)
    lo, hi = F.greatest(row(F.least("y", "v")), F.lit(0)), F.least(row(F.greatest("y", "v")), F.lit(h)) - 1
    met = edges.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("_r", F.explode(F.sequence("_lo", "_hi")))
    cut = met.select(key, F.col("_r").alias("y"), ((F.col("u") - F.col("x")) * (F.col("_r") + 0.5 - F.col("y")) / (F.col("v") - F.col("y")) + F.col("x")).alias("_x"))
    order = Window.partitionBy(key, "y").orderBy("_x")
    pairs = cut.withColumns({"_n": F.row_number().over(order), "_to": F.lead("_x").over(order)}).filter("_n % 2 = 1 AND _to IS NOT NULL")
    edge = lambda c: F.least(F.greatest(F.ceil(F.col(c) - 0.5), F.lit(0)), F.lit(w)).cast("int")
    return pairs.select(key, F.col("y").cast("int").alias("y"), edge("_x").alias("x0"), edge("_to").alias("x1")).filter("x0 < x1")


def crossings_on_grid(edges, key: str):
    """As crossings, with the cell of each key from its own edges: twice the median length, 1 at least.

    An edge goes to the cells along it, column by column, not to its whole box, so one long edge makes as many rows as it
    is long. A pair that meets in several cells counts once: only pairs that cross are made distinct.
    """
    size = F.hypot(F.col("u") - F.col("x"), F.col("v") - F.col("y"))
    cells = edges.groupBy(key).agg(F.greatest(F.lit(1.0), 2 * F.median(size)).alias("cell"))
    df = edges.join(cells, key)
    column = F.sequence(F.floor(F.least("x", "u") / F.col("cell")), F.floor(F.greatest("x", "u") / F.col("cell")))
    df = df.withColumn("cx", F.explode(column))
    flat = F.abs(F.col("u") - F.col("x")) < 1e-12
    at = lambda c: F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.col("x")) / F.when(flat, 1.0).otherwise(F.col("u") - F.col("x")))))
    height = lambda t: F.col("y") + (F.col("v") - F.col("y")) * t
    a, b = height(at(F.col("cx") * F.col("cell"))), F.when(flat, F.col("v")).otherwise(height(at((F.col("cx") + 1) * F.col("cell"))))
    df = df.withColumns({"_a": a, "_b": b})
    rows = F.sequence(F.floor(F.least("_a", "_b") / F.col("cell") - 1e-9), F.floor(F.greatest("_a", "_b") / F.col("cell") + 1e-9))
    df = df.withColumn("cy", F.explode(rows)).select(key, "i", "n", "x", "y", "u", "v", "cx", "cy")
    p, q = df.alias("p"), df.alias("q")
    c = lambda e, name: F.col(f"{e}.{name}")
    pairs = p.join(q, (c("p", key) == c("q", key)) & (c("p", "cx") == c("q", "cx")) & (c("p", "cy") == c("q", "cy")) & (c("q", "i") - c("p", "i") > 1) & (c("q", "i") - c("p", "i") < c("p", "n") - 1))

    def side(e: str, x: Column, y: Column) -> Column:
        return (c(e, "u") - c(e, "x")) * (y - c(e, "y")) - (c(e, "v") - c(e, "y")) * (x - c(e, "x"))

    apart = lambda e, o: side(e, c(o, "x"), c(o, "y")) * side(e, c(o, "u"), c(o, "v")) < -1e-12
    met = pairs.filter(apart("p", "q") & apart("q", "p")).select(c("p", key).alias(key), c("p", "i").alias("i"), c("q", "i").alias("j")).distinct()
    return met.groupBy(key).agg(F.count("*").alias("n"))


#: Share of the em square above the baseline, and units of the em square.
ASCENT, UPEM = 0.80, 1000


def baseline(size: Column, ascent: float = ASCENT) -> Column:
    """The baseline's y in a cell of `size` pixels, from its top."""
    return size * F.lit(ascent)


def to_units(x: Column, y: Column, size: Column, base: Column, upem: int = UPEM) -> Column:
    """struct<x, y>: pixels (y down from the top) as font units (y up from the baseline)."""
    scale = F.lit(float(upem)) / size
    return F.struct((x * scale).alias("x"), ((base - y) * scale).alias("y"))


def to_pixels(x: Column, y: Column, size: Column, base: Column, upem: int = UPEM) -> Column:
    """struct<x, y>: font units as pixels, the inverse of to_units."""
    scale = size / F.lit(float(upem))
    return F.struct((x * scale).alias("x"), (base - y * scale).alias("y"))


def nudged(values: Column, w: int, h: int, delta: Column, axis: str) -> Column:
    """A raster moved by a fraction of pixels along axis x or y: linear between neighbours, zeros come in. values and delta should be columns."""

    def pixel(i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        place, n = (x, w) if axis == "x" else (y, h)
        lo = F.floor(place - delta).cast("int")
        share = place - delta - lo
        at = lambda k: F.when((k >= 0) & (k < n), F.get(values, y * w + k if axis == "x" else k * w + x)).otherwise(0.0)
        return at(lo) * (1 - share) + at(lo + 1) * share

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), pixel)
