"""Landed files as tables: tolerant JSON lines, gray images, sizes, and paged layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings in an entry's metadata up to this length; longer ones are images and the like.
META_CHARS = 128
ID_FIELDS, CP_FIELDS = ("glyph", "gid"), ("codePoint", "codepoint", "unicode")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines file in the given schema, and for each line `corrupt`: it is no JSON object. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("v"))
    corrupt = F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v"), F.lit("")).startswith("OBJECT")
    return parsed.select("r.*", corrupt.alias("corrupt"))


def alpha(spark: SparkSession, path: str) -> DataFrame:
    """Gray images -> path, width, height, alpha: 1 - gray / 255 by rows. Images with other channels are left out."""
    image = spark.read.format("image").load(path).select("image.*").filter("nChannels = 1")
    return image.select(F.col("origin").alias("path"), "width", "height", _lightness("data").alias("alpha"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lightness(data: pd.Series) -> pd.Series:
    return data.map(lambda x: 1 - np.frombuffer(x, np.uint8) / 255, na_action="ignore")


def folder_sizes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """folder, files, bytes of the files below path; pattern: a regular expression whose group is the folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", pattern, 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def first_truthy(raw: Column, fields: tuple[str, ...]) -> Column:
    """struct<text, kind> of the first field of a JSON object that isn't null, an empty text, list or object, the number 0 or false. The text "0" is one."""
    parsed = F.try_parse_json(raw)

    def value(field: str) -> Column:
        text = F.get_json_object(raw, f"$.{field}")
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
        empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").otherwise(text.isin("[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
        return F.when(~empty, F.struct(text.alias("text"), kind.alias("kind")))

    return F.coalesce(*[value(f) for f in fields])


def layout_entries(pages: DataFrame, key: str, layout: str) -> DataFrame:
    """key, page_no, ord, gid, cp, meta: the entries of JSON layouts {ordinal: object}. What is no object is skipped.

    gid falls back to the entry's key, cp to 0. meta keeps scalars, of the strings only short ones. A layout that is no
    object, or null, has no entries.
    """
    entries = F.map_entries(F.from_json(F.col(layout), "map<string,string>"))
    rows = pages.select(key, "page_no", F.posexplode(entries).alias("ord", "e")).filter(F.trim("e.value").startswith("{"))
    fields = F.from_json("e.value", "map<string,string>")
    scalar = lambda k, v: ~k.isin(*ID_FIELDS, *CP_FIELDS) & (v.isNull() | (~F.trim(v).rlike(r"^[\[{]") & (F.length(v) <= META_CHARS)))
    gid = F.coalesce(first_truthy(F.col("e.value"), ID_FIELDS)["text"], F.col("e.key"))
    code = first_truthy(F.col("e.value"), CP_FIELDS)
    # A number loses its fraction, a text has to be a whole number.
    cp = F.coalesce(F.when(code["kind"] == "STRING", code["text"].try_cast("int")).otherwise(code["text"].try_cast("double").cast("int")), F.lit(0))
    return rows.select(key, "page_no", "ord", gid.alias("gid"), cp.alias("cp"), F.map_filter(fields, scalar).alias("meta"))


def cell_rect(raw: Column) -> Column:
    """struct<x, y, w, h> of a JSON rectangle, or null.

    Each of x, y, w and h may be called left, top, width or height instead; w and h have to be positive. Else a bbox of four
    numbers counts: as two corners if the second lies right of and below the first, or with a positive size as its last two.
    """
    num = lambda f: F.get_json_object(raw, f"$.{f}").try_cast("double")
    box = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, "xywh")])
    x, y, w, h = (F.coalesce(num(a), num(b)) for a, b in (("x", "left"), ("y", "top"), ("w", "width"), ("h", "height")))
    x0, y0, a, b = (num(f"bbox[{i}]") for i in range(4))
    four = F.json_array_length(F.get_json_object(raw, "$.bbox")) == 4
    return (
        F.when(x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0), box(x, y, w, h))
        .when(four & (a > x0) & (b > y0), box(x0, y0, a - x0, b - y0))
        .when(four & x0.isNotNull() & y0.isNotNull() & (a > 0) & (b > 0), box(x0, y0, a, b))
    )
