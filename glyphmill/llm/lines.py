"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two successive lines with words sets the boundaries of SETS sets: set k cuts off from their
surroundings the lines whose rolling hash is k modulo SETS (lines of places in a row stay together, unless they are the same).
So boundaries depend on the lines at hand, not on their number from the top, and each place of a text is cut off in one of the
sets. A chunk that stands earlier in the corpus is removed, once its bytes have been compared.

Of a repeated run of two lines or more all lines are found, but for the first or last where it stays together with a line
outside the run: at either end with probability 1 / SETS.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.storage import materialize

SETS = 4096
LAST = (1 << 63) - 1
_TURN = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def chunks(lines: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(hash, numbers of the lines with words) of the chunks of all sets, in order of their beginnings."""
    worded = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
    if len(worded) < 2:
        return
    hashes = [xxhash.xxh3_64_intdigest(lines[i]) for i in worded]
    begin, value, before = 0, 0, None
    for i in range(len(worded) - 1):
        rolled = (hashes[i] * _TURN + hashes[i + 1]) * _TURN & _ALL
        if before is not None and rolled != before and (rolled >> 40) % SETS == (before >> 40) % SETS:
            value = (value * _TURN + rolled) & _ALL
        else:
            if i:
                yield value, worded[begin : i + 1]
            begin, value = i, rolled
        before = rolled
    yield value, worded[begin:]


def without(text: str, places: set[int]) -> str:
    """text without the lines of places: each the first line, shifted left by 32 bits, plus the line after the last."""
    gone = {i for p in places for i in range(p >> 32, p & 0xFFFFFFFF)}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hs, keys = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            mine = [h - (1 << 63) for h, _ in chunks(text.as_py().split("\n"))]
            hs += mine
            keys += [key] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(keys, pa.int64())], names=["h", "key"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, order, text, hs in zip(batch.column("key").to_pylist(), batch.column("ord").to_pylist(), batch.column("text"), batch.column("hs")):
            wanted, lines = set(hs.as_py()), text.as_py().split("\n")
            for h, mine in chunks(lines):
                if h - (1 << 63) in wanted:
                    out.append((h - (1 << 63), "\n".join(lines[i] for i in mine).encode(), order, key, mine[0] << 32 | mine[-1] + 1))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["h", "chunk", "ord", "key", "place"])


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([without(t, {int(x) for x in p}) for t, p in zip(text, places)], dtype=object)


def later(rows: DataFrame) -> DataFrame:
    """Chunks (h, chunk, ord, key, place) -> key, places of those whose bytes have an earlier place. No bytes are joined but those of clashing hashes."""
    # Where all bytes of a hash are the same the hash stands for them; otherwise the bytes tell its chunks apart.
    place = F.struct("ord", "key", "place")
    first = materialize(rows.groupBy("h").agg(F.min(place).alias("lo"), (F.min("chunk") == F.max("chunk")).alias("one")), "first")
    gone = rows.select("h", place.alias("at")).join(first.filter("one").select("h", "lo"), "h").select("at", "lo")
    if first.filter("not one").limit(1).count():  # almost never, and rows with their bytes aren't shuffled for nothing
        mixed = rows.join(first.filter("not one").select("h"), "h", "left_semi")
        apart = mixed.groupBy("h", "chunk").agg(F.min(place).alias("lo"))
        gone = gone.union(mixed.select("h", "chunk", place.alias("at")).join(apart, ["h", "chunk"]).select("at", "lo"))
    return gone.filter("at > lo").groupBy(F.col("at.key").alias("key")).agg(F.collect_set("at.place").alias("places"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with a struct column row and doc_id, text -> row, doc_id, text, old (text before) and n_chunks removed.

    A chunk is two lines with words or more; lines without words between them go with it and aren't compared. Its first place
    (smallest doc_id, null last; of several texts of a doc_id the one with the smallest hash; then the first line) keeps it.
    Chunks may overlap, and each is judged on the input, not on what is left. Rows equal in doc_id and text count as one
    text and get the same result. A text may become empty; no row goes. Null texts stay null.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keyed = docs.withColumn("ord", order).withColumn("key", F.xxhash64(F.col("ord"), F.col("text")))
    # Texts of one line have no chunk.
    found = keyed.select("key", "text").filter(F.contains("text", F.lit("\n"))).mapInArrow(_hashes, "h long, key long")
    shared = materialize(found.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "shared")
    hits = found.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    flagged = materialize(keyed.join(hits, "key", "left"), "flagged", release=True)
    some = flagged.filter("hs is not null")
    rows = materialize(some.select("key", "ord", "text", "hs").mapInArrow(_rows, "h long, chunk binary, ord long, key long, place long"), "chunks")
    gone = later(rows)
    changed = some.join(gone, "key", "left")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.coalesce("places", F.array().cast("array<bigint>"))))
    after = changed.select("row", "doc_id", text.alias("text"), F.col("text").alias("old"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_chunks"))
    same = flagged.filter("hs is null").select("row", "doc_id", "text", F.col("text").alias("old"), F.lit(0).cast("long").alias("n_chunks"))
    return after.union(same)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks and n_lines_removed, kept_sha256 of the text left (UTF-8)."""
    out = dedup(docs.select("doc_id", "text", F.struct("doc_id").alias("row")))
    n = F.when(F.length("old") > 0, F.size(F.split("old", "\n"))).otherwise(0).cast("long")
    left = F.when((F.length("text") > 0) | (F.col("n_chunks") == 0), F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    left = F.when(F.length("old") > 0, left).otherwise(0)
    return out.select("doc_id", n.alias("n_lines"), "n_chunks", (n - left).cast("long").alias("n_lines_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated(docs: DataFrame) -> DataFrame:
    """docs with the texts left and, where the text has changed, its n_chars; the columns of docs."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, own))
    row = F.struct(*[F.col(f"`{c}`").alias(o) for c, o in named.items() if c != "text"])
    out = dedup(docs.select("doc_id", "text", row.alias("row")))
    n_chars = F.when(F.col("n_chunks") > 0, F.length("text").cast("long"))
    value = {c: F.col("text") if c == "text" else F.coalesce(n_chars, F.col(f"row.{o}")) if c == "n_chars" else F.col(f"row.{o}") for c, o in named.items()}
    return out.select(*[v.alias(c) for c, v in value.items()])
