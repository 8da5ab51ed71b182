"""Glyph metrics and checks as expressions: advances, vertical extents, bounds, gate."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Design units of the em, share of the cell above the baseline, advance for a unit of ink, defaults and bounds.
UPEM, BASELINE, INK_FACTOR = 1000, 0.80, 1.18
FALLBACK, ASCENDER, DESCENDER = 500.0, 800, -200
ASC_RANGE, DESC_RANGE = (600, 1000), (-400, -50)


def advance(meta_advance: Column, meta_adv: Column, left: Column, right: Column, size: Column) -> Column:
    """struct<advance, via>: from the metadata, the ink or the default.

    A metadata advance that isn't null is the only one looked at, even if it is no positive number.
    """
    meta = F.coalesce(meta_advance, meta_adv)
    ink = F.bround((right - left) * UPEM / size * INK_FACTOR, 1)
    via = F.when(meta > 0, "meta").when((right > left) & (size > 0), "ink").otherwise("fallback")
    return F.struct(F.when(meta > 0, meta).when((right > left) & (size > 0), ink).otherwise(FALLBACK).alias("advance"), via.alias("via"))


def extents(rows: DataFrame, key: str, top: Column, bottom: Column, size: Column) -> DataFrame:
    """key -> ascender, descender in units, clamped; defaults where nothing is observed."""
    up = lambda row: (size * BASELINE - row) * UPEM / size
    agg = rows.groupBy(key).agg(F.max(up(top)).alias("a"), F.min(up(bottom)).alias("d"))
    clamp = lambda c, r: F.when(c.isNotNull(), F.greatest(F.lit(float(r[0])), F.least(F.lit(float(r[1])), c)))
    return agg.select(key, F.coalesce(clamp(F.col("a"), ASC_RANGE), F.lit(float(ASCENDER))).alias("ascender"), F.coalesce(clamp(F.col("d"), DESC_RANGE), F.lit(float(DESCENDER))).alias("descender"))


def bernstein(p: Sequence[Column], t: float) -> Column:
    """A cubic with control values p at t."""
    s = 1 - t
    return p[0] * (s * s * s) + p[1] * (3 * s * s * t) + p[2] * (3 * s * t * t) + p[3] * (t * t * t)


def cubic_bounds(p: Sequence[Column]) -> tuple[Column, Column]:
    """Least and greatest of the control values and of samples at eighths, as half-even integers."""
    values = F.array(*p, *[bernstein(p, k / 8) for k in range(1, 8)])
    return F.rint(F.array_min(values)).cast("int"), F.rint(F.array_max(values)).cast("int")


def failures(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that fail, in the given order; a null rule doesn't."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def gate_rules(gap: Column, y_min: Column, y_max: Column, adv: Column, is_space: Column, residual: Column, tol: Column, chord: Column, crossings: Column, agreement: Column) -> list[tuple[str, Column]]:
    """The confidence gate over measures of a glyph, in its fixed order."""
    bad = functools.reduce(lambda a, b: a | b, [F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")) for c in (gap, y_min, y_max)])
    return [
        ("non_finite", bad), ("not_closed", gap > 1e-6), ("bbox_guard", ~bad & ((y_min < -250) | (y_max > 1250))),
        ("advance_range", F.when(is_space, adv < 100).otherwise(~adv.between(15, 2000))), ("bezier_residual", residual > tol * 2),
        ("degenerate_segment", chord <= 1e-3), ("self_intersection", crossings > 0), ("edge_agreement", agreement < 0.80),
    ]


def with_mandatory(glyphs: DataFrame, key: str, name: str, adv: str, space: Column) -> DataFrame:
    """glyphs (key, name, adv) and for each key the mandatory ones it lacks: .notdef and space, whose advance is clamped to 100..600."""
    wanted = glyphs.groupBy(key).agg(F.max(F.when(F.col(name) == ".notdef", 1)).alias("n"), F.max(F.when(F.col(name) == "space", 1)).alias("s"), F.coalesce(F.max(space), F.lit(250.0)).alias("w"))
    wide = F.greatest(F.lit(100.0), F.least(F.lit(600.0), F.col("w")))
    lacks = F.array_compact(F.array(F.when(F.col("n").isNull(), F.struct(F.lit(".notdef").alias("g"), F.lit(500.0).alias("a"))), F.when(F.col("s").isNull(), F.struct(F.lit("space").alias("g"), wide.alias("a")))))
    more = wanted.select(key, F.explode(lacks).alias("x")).select(key, F.col("x.g").alias(name), F.col("x.a").alias(adv))
    return glyphs.select(key, name, adv).unionByName(more)


def uncovered(texts: DataFrame, text: str, group: str, cmap: DataFrame) -> DataFrame:
    """group, cp, n: code points of the texts that the cmap (cp) lacks, with the number of texts; distinct within a text before the shuffle."""
    chars = texts.select(group, F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), ""))).alias("c")).filter("c <> ''")
    counts = chars.groupBy(group, "c").agg(F.count("*").alias("n"))
    # ascii() gives the code point of the first character, beyond ASCII too.
    return counts.withColumn("cp", F.ascii("c")).join(cmap, "cp", "left_anti").select(group, "cp", "n")


def ladder(rows: DataFrame, key: str, levels: Sequence[Callable[[DataFrame], Column]]) -> DataFrame:
    """key, level: the first level whose gate passes a row, 0 for none.

    The gates are expressions, so the ladder is one lazy pass: Spark evaluates a later gate only where the earlier fail.
    """
    out = F.lit(0)
    for i in range(len(levels), 0, -1):
        out = F.when(F.coalesce(levels[i - 1](rows), F.lit(False)), i).otherwise(out)
    return rows.select(key, out.alias("level"))


def all_engines(passed: Sequence[Column]) -> Column:
    """Whether all engines pass; one that was skipped (null) counts as passed."""
    return functools.reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(True)) for p in passed])


def structural(glyphs: DataFrame, cmap: DataFrame, model: str) -> DataFrame:
    """model, glyphs, mapped, errors, passed of every model in glyphs (name, advance, loads): what can be judged on tables.

    errors, in this order: EMPTY_CMAP, DANGLING_CMAP (a code point of cmap (cp, name) whose glyph the model lacks), TOO_FEW_GLYPHS (below
    two), OUTLINE (a glyph that doesn't load), NEGATIVE_ADVANCE.
    """
    own = glyphs.groupBy(model).agg(F.count("*").alias("glyphs"), F.max(~F.col("loads")).alias("_broken"), F.max(F.col("advance") < 0).alias("_negative"))
    held = cmap.join(glyphs.select(model, "name").distinct().withColumn("_has", F.lit(True)), [model, "name"], "left")
    mapped = held.groupBy(model).agg(F.count_distinct("cp").alias("mapped"), F.max(F.col("_has").isNull()).alias("_dangling"))
    df = own.join(mapped, model, "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [("EMPTY_CMAP", F.col("mapped") == 0), ("DANGLING_CMAP", yes("_dangling")), ("TOO_FEW_GLYPHS", F.col("glyphs") < 2), ("OUTLINE", yes("_broken")), ("NEGATIVE_ADVANCE", yes("_negative"))]
    return df.select(model, "glyphs", "mapped", failures(rules).alias("errors")).withColumn("passed", F.size("errors") == 0)


#: Letters that one column of bits holds.
_BITS = 60


def rendered(models: DataFrame, inks: DataFrame, model: str, sample: str, least: float = 0.8) -> DataFrame:
    """model, total, empty, passed of every different model: how many different letters and digits of a sample text leave no ink.

    inks (model, cp, ink): set pixels of a code point's glyph; one that isn't there is empty. Passed with over `least` of them
    inked, or none to look at. The inked letters of a model are bits, put together before the only shuffle, so a task holds a
    few numbers for each of its models and nothing is joined or sorted.
    """
    letters = sorted({ord(c) for c in sample if unicodedata.category(c)[0] in "LN"})
    parts = {f"_bits{k // _BITS}": letters[k : k + _BITS] for k in range(0, len(letters), _BITS)}
    bit = lambda part: functools.reduce(lambda out, i: F.when(F.col("cp") == part[i], F.lit(1 << i)).otherwise(out), range(len(part)), F.lit(0)).cast("long")
    inked = inks.filter((F.col("ink") > 0) & F.col("cp").isin(letters)).select(model, F.lit(False).alias("_here"), *[bit(p).alias(n) for n, p in parts.items()])
    rows = models.select(model, F.lit(True).alias("_here"), *[F.lit(0).cast("long").alias(n) for n in parts]).unionByName(inked)
    found = rows.groupBy(model).agg(F.max("_here").alias("_here"), *[F.bit_or(n).alias(n) for n in parts]).filter("_here")
    total = F.lit(len(letters)).cast("long")
    out = found.select(model, total.alias("total"), (total - sum((F.bit_count(n) for n in parts), F.lit(0))).cast("long").alias("empty"))
    return out.withColumn("passed", F.when(F.col("total") > 0, (F.col("total") - F.col("empty")) / F.greatest("total", F.lit(1)) > least).otherwise(True))
