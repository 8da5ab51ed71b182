"""Glyph work in which a broken glyph becomes a row with an error class, and the rest of its task goes on.

What can be judged before any work is an expression; what only shows while rings are fitted is caught row by row inside
the kernel.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators import contours

#: Classes of failures, in the order in which they are looked for.
CLASSES = ("NO_OBSERVATIONS", "BAD_SHAPE", "NOT_FINITE", "EMPTY", "NO_CONTOURS", "FIT_FAILED")


def attempt(f: Callable, returns: T.DataType) -> Callable[[Column], Column]:
    """A function of a column -> struct<value, error>: f of each row's value, or the type of the exception that it raised.

    A null value isn't tried. Nothing that f raises ends the task.
    """

    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append({"value": None if v is None else f(v), "error": None})
            except Exception as e:  # noqa: BLE001 - whatever a row raises is that row's result
                out.append({"value": None, "error": type(e).__name__})
        return pa.array(out, pa.struct([("value", _arrow(returns)), ("error", pa.string())]))

    return F.arrow_udf(run, T.StructType().add("value", returns).add("error", "string"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def judged(alpha: Column, w: Column, h: Column) -> Column:
    """The first class of failure that a raster shows by itself, else null."""
    finite = F.forall(alpha, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(alpha.isNull(), "NO_OBSERVATIONS").when((F.size(alpha) != w * h) | (w < 2) | (h < 2), "BAD_SHAPE").when(~finite, "NOT_FINITE").when(~F.exists(alpha, lambda v: v > 0.5), "EMPTY")


def outlines(glyphs: DataFrame, key: str, least_area: float = contours.LEAST_AREA, least_perimeter: float = contours.LEAST_PERIMETER) -> DataFrame:
    """glyphs (key, alpha, w, h) -> key, error, contours: the fast pass from raster to cubics, one row for every glyph.

    contours is an array of rings, each an array of cubics; null where error is set, a class of CLASSES. A glyph fails whole:
    rings that could be fitted don't count if another could not. All glyphs of one call have rasters of equal size. Rings below
    least_area or least_perimeter are noise: a glyph that has no others is NO_CONTOURS. All work on a glyph is done within its
    row, so nothing is shuffled.
    """
    w, h = (glyphs.agg(F.max("w"), F.max("h")).first() or (0, 0))
    seen = glyphs.select(key, judged(F.col("alpha"), F.lit(w), F.lit(h)).alias("error"), "alpha")
    whole = F.when(F.col("error").isNull(), F.col("alpha").cast("array<double>"))
    out = seen.select(key, "error", contours.outlined(whole, w or 2, h or 2, 0.5, least_area, least_perimeter).alias("t"))
    error = F.coalesce("error", F.when(F.col("t.failed").isNotNull(), "FIT_FAILED").when(F.size("t.contours") == 0, "NO_CONTOURS"))
    return out.select(key, error.alias("error"), F.when(error.isNull(), F.col("t.contours")).alias("contours"))
