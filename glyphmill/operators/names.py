"""Names that are unique within a group: an ordered fold, dealt out by the stem that clashing names share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import slug

#: Length of a safe name; characters of it that stems are taken from (suffixes never reach into them).
SAFE_CHARS, STEM_CHARS = 80, 60


def stem(base: Column, sep: str) -> Column:
    """What a name and all names made from it by suffixes have in common."""
    return F.regexp_replace(F.substring(base, 1, STEM_CHARS), f"({sep}[0-9]*)+$", "")


def _named(sep: str, most: int | None, fold: bool):
    """Rows sorted by _group, _stem and _place; the names taken in one group and stem are all that is held."""

    def shortened(base: str, suffix: str) -> str:
        return (base[: most - len(suffix)].rstrip(sep) if most else base) + suffix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, following = object(), set(), {}
        for batch in batches:
            names = []
            for group, base in zip(zip(batch.column("_group").to_pylist(), batch.column("_stem").to_pylist()), batch.column("_base").to_pylist()):
                if group != at:
                    at, taken, following = group, set(), {}
                seen = base.lower() if fold else base
                name, k = base, following.get(seen, 2)
                while (name.lower() if fold else name) in taken:
                    name, k = shortened(base, f"{sep}{k}"), k + 1
                following[seen] = k  # suffixes below k are taken for good
                taken.add(name.lower() if fold else name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "unique_name"])

    return run


def _unique(rows: DataFrame, group: str, order: list[str], base: Column, sep: str, most: int | None, fold: bool) -> DataFrame:
    keyed = F.lower("_base") if fold else F.col("_base")
    df = rows.withColumns({"_group": F.xxhash64(F.col(group).cast("string")), "_base": base}).withColumn("_stem", stem(keyed, sep))
    dealt = df.repartition("_group", "_stem").sortWithinPartitions("_group", "_stem", *order)
    out = dealt.mapInArrow(_named(sep, most, fold), df.withColumn("unique_name", F.lit("")).schema)
    return out.drop("_group", "_stem", "_base")


def safe(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with unique_name: the slug of name, or, where an earlier row of the group has it in any case, with -2, -3, ... added.

    A name with a suffix may itself be taken and is passed over; at most SAFE_CHARS characters are used, the suffix
    included. Rows of a group go by order, which should be total. Null and empty names are 'unnamed'; a null group is one.
    Columns must not begin with an underscore.
    """
    return _unique(rows, group, order, slug(F.col(name), SAFE_CHARS), "-", SAFE_CHARS, True)


def distinct(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """As safe, for names taken as they are: case counts, nothing is cut, and suffixes are _2, _3, ...; a null name is empty."""
    return _unique(rows, group, order, F.coalesce(F.col(name), F.lit("")), "_", None, False)
