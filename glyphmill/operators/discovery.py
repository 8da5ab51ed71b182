"""Paged discovery with stop rules, first-wins deduplication and source priority, by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import page_signature, weight_of
from glyphmill.sources.landed import layout_entries


def paginate(pages: DataFrame, key: str, full: int, most: int) -> DataFrame:
    """pages (key, page_no, entries array<string>) -> key, pages, stop_reason, found.

    A page stops its key if it is empty, repeats an earlier page's entries, brings nothing new (not counted further) or is
    short (counted). Each rule looks at earlier pages only, and all pages before the stop are kept, so windows are exact.
    """
    before = Window.partitionBy(key, "signature").orderBy("page_no")
    df = pages.withColumn("n", F.size("entries")).withColumn("signature", F.sha2(F.concat_ws(",", F.array_sort("entries")), 256))
    df = df.withColumn("again", F.row_number().over(before) > 1)
    entry = df.select(key, "page_no", F.explode("entries").alias("e")).groupBy(key, "e").agg(F.min("page_no").alias("page_no"))
    new = entry.groupBy(key, "page_no").agg(F.count("*").alias("new"))
    df = df.join(new, [key, "page_no"], "left")
    reason = F.when(F.col("n") == 0, "empty_layout").when(F.col("again"), "repeated_signature").when(F.col("new").isNull(), "no_new_glyphs").when(F.col("n") < full, "short_page")
    df = df.withColumn("reason", F.coalesce(reason, F.when(F.col("page_no") >= most, "max_pages")))
    stop = df.groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("page_no", "reason"))).alias("s"), F.max("page_no").alias("last"))
    kept = df.join(stop, key).filter(F.col("page_no") <= F.coalesce("s.page_no", "last"))
    return kept.groupBy(key).agg(F.count("*").alias("pages"), F.coalesce(F.first("s.reason"), F.lit("max_pages")).alias("stop_reason"), F.sum(F.when(F.coalesce("reason", F.lit("")).isin("", "short_page", "max_pages"), F.coalesce("new", F.lit(0))).otherwise(0)).alias("found"))


def first_wins(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """One row for each key: its first row's order, and the first name that isn't empty from there on (late fill)."""
    filled = F.nullif(F.trim(F.col(name)), F.lit(""))
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.min_by(filled, F.when(filled.isNotNull(), F.struct(*order))).alias(name))


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Keys wanted but not had: an anti join."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def by_priority(wanted: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The value from the first source that has the key, and that source's name; 'missing' where none has."""
    out = wanted
    for name, source in sources:
        out = out.join(source.select(key, F.col(value).alias(f"_{name}")), key, "left")
    pick = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in sources], F.lit("missing"))
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"_{n}") for n, _ in sources]).alias(value), pick.alias("source"))


def coverage(cp: Column) -> Column:
    """Sorted distinct positive code points."""
    return F.array_sort(F.collect_set(F.when(cp > 0, cp)))


def landed_pages(pages: DataFrame, key: str) -> DataFrame:
    """pages (key, page_no, payload) with failed, layout and image: a payload that is null or no JSON object has failed.

    A layout that is no object is an empty one.
    """
    layout, image = F.get_json_object("payload", "$.layout"), F.get_json_object("payload", "$.image")
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")), F.lit("")).startswith("OBJECT")
    return pages.select(key, "page_no", (~whole).alias("failed"), F.when(F.trim(layout).startswith("{"), layout).otherwise("{}").alias("layout"), F.coalesce(image, F.lit("")).alias("image"))


def _stops(pages: DataFrame, key: str, full: int, most: int) -> DataFrame:
    """Pages up to where each key stops, with n, reason (null on pages before) and counted."""
    df = landed_pages(pages.filter(F.col("page_no").between(1, most)), key)
    df = df.withColumns({"n": F.size(F.json_object_keys("layout")), "signature": page_signature(F.col("layout"), F.col("image"))})
    seen, in_order = Window.partitionBy(key, "signature").orderBy("page_no"), Window.partitionBy(key).orderBy("page_no")
    # Failed pages have the signature of an empty page; they and empty ones stop before it counts.
    df = df.withColumns({"again": F.row_number().over(seen) > 1, "gap": F.row_number().over(in_order) != F.col("page_no"), "last": F.lead("page_no").over(in_order).isNull()})
    first = layout_entries(df.filter("not failed"), key, "layout").groupBy(key, "cp", "gid").agg(F.min("page_no").alias("page_no"))
    df = df.join(first.groupBy(key, "page_no").agg(F.count("*").alias("new")), [key, "page_no"], "left")
    reason = F.when(F.col("gap") | F.col("failed"), "error").when(F.col("n") == 0, "empty_layout").when(F.col("again"), "repeated_signature").when(F.col("new").isNull(), "no_new_glyphs")
    reason = reason.when(F.col("n") < full, "short_page").when(F.col("page_no") == most, "max_pages").when(F.col("last"), "error")
    df = df.withColumn("reason", reason).withColumn("stop", F.min(F.when(F.col("reason").isNotNull(), F.col("page_no"))).over(Window.partitionBy(key)))
    return df.filter(F.col("page_no") <= F.col("stop"))


def discovered(pages: DataFrame, key: str, full: int, most: int = 40) -> DataFrame:
    """Landed pages of JSON (key, page_no, payload) -> key, pages, stop_reason, found: paged discovery with all of its stop rules.

    In order: error (no JSON object, or a page that never landed; not counted), empty_layout, repeated_signature (keys and
    the image's beginning), no_new_glyphs, short_page, max_pages. Entries count once by code point and id; those of the
    page that stops count only with the last two. Pages over `most` aren't looked at. Each rule looks at pages before
    alone, and all of those are kept, so windows over the landed pages are exact.
    """
    kept = _stops(pages, key, full, most)
    adds = F.col("reason").isNull() | F.col("reason").isin("short_page", "max_pages") | ((F.col("reason") == "error") & ~F.col("gap") & ~F.col("failed"))
    counted = ~(F.col("gap") | F.col("failed"))
    return kept.groupBy(key).agg(F.count_if(counted).alias("pages"), F.max("reason").alias("stop_reason"), F.sum(F.when(adds, F.coalesce("new", F.lit(0))).otherwise(0)).alias("found"))


def styles(candidates: DataFrame, page: str, key: str, pos: str, name: str, pattern: str) -> DataFrame:
    """page, index, key, pos, name, weight, name_source, synthesized: the styles of each page in document order.

    The first candidate of a key makes a style; if it has no name, the first later one that has gives name, weight and source.
    A style that stays without a name is 'Style n' with n its index from 1, without a weight, its source the first candidate's.
    """
    filled = F.nullif(F.trim(F.col(name)), F.lit(""))
    named = F.when(filled.isNotNull(), F.col(pos))
    found = candidates.groupBy(page, key).agg(F.min(pos).alias("pos"), F.min_by(filled, named).alias("_name"), F.coalesce(F.min_by(pattern, named), F.min_by(pattern, pos)).alias("name_source"))
    df = found.withColumn("index", F.row_number().over(Window.partitionBy(page).orderBy("pos")))
    given = F.coalesce("_name", F.concat(F.lit("Style "), F.col("index").cast("string")))
    return df.select(page, "index", key, "pos", given.alias("name"), weight_of(F.col("_name")).alias("weight"), "name_source", F.col("_name").isNull().alias("synthesized"))
