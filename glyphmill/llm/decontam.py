"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

#: Words of a text whose A-Z have become a-z, in UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
#: Bytes of benchmark text that are searched for in one pass, and so the most that is broadcast at once; its tables take about 50 times that.
BLOCK_BYTES = 4_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Patterns:
    """Wu-Manber tables for the windows of one length in words. The block is a pair of words (one word for length 1).

    Words are numbered, so a block is one number and an item an array of numbers; a window is a place in its item.
    """

    def __init__(self, length: int, numbers: dict[bytes, int]):
        self.length, self.numbers = length, numbers
        self.block = min(2, length)
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = {}
        self.items: list[tuple[str | None, array]] = []

    def add(self, item: str | None, words: list[int]) -> None:
        b, m, n = self.block, self.length, len(words)
        keys = words if b == 1 else [x << 32 | y for x, y in zip(words, words[1:])]
        self.items.append((item, array("I", words)))
        for i, key in enumerate(keys):
            # From the end of the first window on, every block ends a window; before, it is so far from that end.
            self.shift[key] = min(self.shift.get(key, m), max(0, m - b - i))
        for i in range(n - m + 1):
            self.bucket.setdefault(keys[i + m - b], []).append((len(self.items) - 1, i))

    def find(self, words: list[bytes], hit: bytearray, items: set[str | None]) -> None:
        m, b, get = self.length, self.block, self.numbers.get
        at, n, shift, free = m, len(words), self.shift, m - b + 1
        while at <= n:
            last = get(words[at - 1])
            before = get(words[at - 2]) if b == 2 and last is not None else 0
            if last is None or before is None:
                at += m if last is None else free
                continue
            key = before << 32 | last if b == 2 else last
            step = shift.get(key, free)
            if step:
                at += step
                continue
            own = None
            for k, i in self.bucket.get(key, ()):
                own = own or [get(w) for w in words[at - m : at]]
                item, numbers = self.items[k]
                if own == numbers[i : i + m].tolist():
                    hit[at - m : at] = b"\x01" * m
                    items.add(item)
            at += 1


def tables(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[Patterns]:
    """One table for each length of window among the items."""
    by_length: dict[int, Patterns] = {}
    numbers: dict[bytes, int] = {}
    for item, text in rows:
        words = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
        if words:
            m = min(window, len(words))
            by_length.setdefault(m, Patterns(m, numbers)).add(item, words)
    return list(by_length.values())


def _runs(hit: bytearray) -> list[int]:
    out: list[int] = []
    at = hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out += [at, end]
        at = hit.find(1, end)
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of bounded size (one item at least), in the order of their rows. Items without text have no windows."""
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, bytes(text)))
        size += len(text)
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    No shuffle: each block of the benchmark is broadcast for one pass over the texts; between the passes for a benchmark
    of several blocks the rows are written, so one block is held at a time. A null or empty text has no words and no hits; a text
    of one very long word is one word. Repeated rows are judged each by itself. An empty benchmark hits nothing. The
    windows of items with a null item_id count; those items are one item without a name in the digest.
    Columns of docs must not begin with an underscore.
    """
    spark = docs.sparkSession
    keep = docs.columns
    df = docs.withColumn("_hit", F.lit(None).cast("array<int>")).withColumn("_items", F.lit(None).cast("array<string>")).withColumn("_n", F.lit(None).cast("long"))
    blocks = 0
    for block in _blocks(benchmark, block_bytes) if benchmark is not None else ():
        df, blocks = _scan(materialize(df, "searched") if blocks else df, spark.sparkContext.broadcast(block)), blocks + 1
    if not blocks:
        df = _scan(df, spark.sparkContext.broadcast([]))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_hit") - 1, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get("_hit", i) - F.get("_hit", i - 1))
    n_hit = F.when(F.size("_hit") > 0, covered).otherwise(F.lit(0)).cast("long")
    out = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(df: DataFrame, block) -> DataFrame:
    schema = df.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables(block.value)
        for batch in batches:
            hits, items, sizes = [], [], []
            texts = batch.column("text").cast(pa.large_binary())
            for text, old, names_ in zip(texts, batch.column("_hit"), batch.column("_items")):
                words = words_of(text.as_py())
                hit, seen = bytearray(len(words)), set(names_.as_py() or ())
                was = old.as_py() or []
                for a, b in zip(was[::2], was[1::2]):
                    hit[a:b] = b"\x01" * (b - a)
                for p in found:
                    p.find(words, hit, seen)
                hits.append(_runs(hit))
                items.append(sorted(seen, key=lambda x: (x is not None, x or "")))
                sizes.append(len(words))
            new = {"_hit": pa.array(hits, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string())), "_n": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return df.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs, whatever their names. Null and empty texts stay."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)]).alias("row"))
    return search(inner, benchmark).filter("not contaminated").select(*[F.col(f"row.{o}").alias(c) for c, o in zip(docs.columns, own)])


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark).drop("text")


def sha_of(items: set[str]) -> str:
    """The digest of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
