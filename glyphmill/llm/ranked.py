"""Ranked lexical search over an inverted index held as a DataFrame.

index: documents are inverted block by block (a shard is a block of documents), so a term's postings are one row for each
shard and no term, however frequent, is one task's. Rows are in term buckets within each file, and a search reads the
buckets of its terms alone. search: items' terms are joined with the postings, each match gets an integer score, the
matches of an item and a document are summed, and row_number picks the best, first within shards, then over all.
"""

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.storage import materialize

#: A term after lower-casing A-Z: in UTF-8 all characters past ASCII consist of bytes from 0x80 on.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same in Java's syntax, over characters.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of terms in the index.
BUCKETS = 4096
#: Postings after which a shard is closed; it has one document at least.
SHARD_POSTINGS = 1 << 18
#: Item terms (rows of the query side) up to which they are broadcast; beyond, the join shuffles by term.
BROADCAST_ROWS = 1 << 20
#: Partitions of one search at most.
MOST_PARTITIONS = 20000
SCHEMA = "shard long, term string, rows array<int>, docs array<long>, sizes array<int>, tfs array<int>, shard_docs long, shard_terms long"


class Index(NamedTuple):
    """Postings by (bucket, term, shard), the documents and terms of the corpus (N and L), and the number of shards."""

    postings: DataFrame
    n_docs: int
    n_terms: int
    n_shards: int


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _block(shard: int, terms: list[bytes], tfs: list[int], distinct: list[int], docs: list, sizes: list[int]) -> pa.RecordBatch:
    """One row for each term of the block, and before them one without a term: the block's documents and terms."""
    codes = pa.array(terms, pa.binary()).dictionary_encode()
    code = codes.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    row = np.repeat(np.arange(len(docs), dtype=np.int32), distinct)[order]
    offsets = np.concatenate([[0, 0], np.cumsum(np.bincount(code, minlength=len(codes.dictionary)))]).astype(np.int32)
    names = pa.concat_arrays([pa.array([None], pa.string()), codes.dictionary.cast(pa.string())])
    n = len(names)
    first = np.arange(n) > 0
    take = pa.array(row)
    columns = [
        pa.array(np.full(n, shard)),
        names,
        _lists(offsets, take),
        _lists(offsets, pa.array(docs, pa.int64()).take(take)),
        _lists(offsets, pa.array(sizes, pa.int32()).take(take)),
        _lists(offsets, pa.array(np.asarray(tfs, np.int32)[order])),
        pa.array(np.full(n, len(docs)), mask=first),
        pa.array(np.full(n, sum(sizes)), mask=first),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "rows", "docs", "sizes", "tfs", "shard_docs", "shard_terms"])


def _invert(shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        terms, tfs, distinct, docs, sizes = [], [], [], [], []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                words = TERM.findall((text.as_py() or b"").lower())
                if not words:
                    continue
                counts = Counter(words)
                terms.extend(counts)
                tfs.extend(counts.values())
                distinct.append(len(counts))
                docs.append(doc)
                sizes.append(len(words))
                if len(terms) >= shard_postings:
                    yield _block(shard, terms, tfs, distinct, docs, sizes)
                    shard += 1
                    terms, tfs, distinct, docs, sizes = [], [], [], [], []
        if docs:
            yield _block(shard, terms, tfs, distinct, docs, sizes)

    return run


def bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int"))


def index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of docs (doc_id, text), written in the shared folder. No shuffle.

    Each row of docs is a document of its own, repeated rows and null or repeated doc_ids too. A null text has no terms,
    and a document without terms is in no posting and not counted.
    """
    inverted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_invert(shard_postings), SCHEMA)
    postings = materialize(inverted.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket", "term"), "postings")
    total = postings.filter("bucket = -1").agg(F.coalesce(F.sum("shard_docs"), F.lit(0)), F.coalesce(F.sum("shard_terms"), F.lit(0)), F.count("*")).first()
    return Index(postings.filter("bucket >= 0").drop("shard_docs", "shard_terms"), *total)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; none of a null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def search(found: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item of items (item_id, text).

    Rows with the same item_id are one item with the terms of all; a null item_id is an item too. Equal scores go by
    doc_id, null last; rows equal in both are alike in the result. Items without terms, or whose terms no document has,
    give no rows.

    Postings of the items' terms are dealt out by shard, so that the sums and the first k of each shard need no further
    shuffle. Between shards at most k rows for each item and shard are moved.
    """
    named = materialize(items.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")), "items")
    wanted = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    wanted = materialize(wanted.join(named, wanted["item_id"].eqNullSafe(named["item_id"])).select("item", "term", bucket(F.col("term")).alias("bucket")), "item-terms")
    rows = wanted.count()
    in_buckets = sorted(r[0] for r in wanted.select("bucket").distinct().collect())  # BUCKETS numbers at most
    postings = found.postings.filter(F.col("bucket").isin(in_buckets)) if in_buckets else found.postings.limit(0)
    vocabulary = wanted.select("bucket", "term").distinct()
    hits = postings.join(_small(vocabulary, rows), ["bucket", "term"], "left_semi")
    df = hits.groupBy("term").agg(F.sum(F.size("rows")).alias("df"))
    w = F.floor(1000 * F.log((2.0 * F.lit(found.n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialize(wanted.join(df.select("term", w.alias("w")), "term").filter("w > 0").select("item", "term", "bucket", "w"), "weights")

    dealt = hits.select("shard", "term", F.arrays_zip("rows", "docs", "sizes", "tfs").alias("p")).repartition(max(1, min(MOST_PARTITIONS, found.n_shards)), "shard")
    matches = dealt.select("shard", "term", F.inline("p")).join(_small(weighed.select("item", "term", "w"), rows), "term")
    m = f"(50 + (50 * cast(sizes as bigint) * {found.n_docs}L) div {max(1, found.n_terms)}L)"
    score = F.expr(f"w * ((1000000000L * tfs) div (1000L * tfs + 20L * {m}))")
    summed = matches.withColumn("s", score).groupBy("shard", "item", "rows", "docs").agg(F.sum("s").alias("score")).filter("score > 0")
    order = [F.col("score").desc(), F.col("docs").asc_nulls_last()]
    local = summed.withColumn("r", F.row_number().over(Window.partitionBy("shard", "item").orderBy(*order))).filter(F.col("r") <= k).drop("r")
    best = local.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(_small(named, rows), "item").select("item_id", "rank", F.col("docs").alias("doc_id"), "score")


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents for each benchmark item."""
    return search(index(docs.select("doc_id", "text")), benchmark.select("item_id", "text"), 50)
