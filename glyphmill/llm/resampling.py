"""Importance resampling towards a target corpus by hashed n-gram features, over bucket-partitioned inverted postings.

Documents and target are inverted together: (bucket, document, count) goes to the partition of its bucket, packed in blocks
of many postings. There, a bucket's counts in both corpora come first in the sort order, so its gain is known before the
first posting is read, and the postings stream past. Each block gives its documents' contributions, which a sum by
document brings together.
"""

from collections.abc import Iterator
from itertools import count, islice
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Hash buckets of features, and the ranges of buckets by which postings are dealt out.
BUCKETS, RANGES = 10000, 32
#: Blocks of one range are dealt to so many partitions in turn, so a bucket with most postings isn't one task's.
SLICES = 8
#: Features after which a block is closed; it has one document at least.
BLOCK_FEATURES = 1 << 20
TOTALS, POSTINGS, DOCUMENTS = 0, 1, 2
PACKED = "key int, kind int, ids array<long>, hashes array<long>, at array<int>, buckets array<int>, counts array<long>, targets array<long>, features long, target_features long"
PARTS = "doc_id long, hash long, part long, copies long, words long"


def features(text: bytes | None) -> tuple[int, np.ndarray]:
    """Words and the feature buckets of a text, repeats included: runs of 1 to 3 words, each hashed on from the one before."""
    words = WORD.findall((text or b"").lower())
    one = list(map(crc32, words))
    more = [b" " + w for w in words[1:]]
    two = list(map(crc32, more, one))
    three = list(map(crc32, islice(more, 1, None), two))
    return len(words), np.array(one + two + three, np.uint32) % BUCKETS


def n_features(words: int) -> int:
    return words + max(words - 1, 0) + max(words - 2, 0)


def gain(s: int, t: int, s_all: int, t_all: int) -> int:
    return math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"ids": pa.list_(pa.int64()), "hashes": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "buckets": pa.list_(pa.int32()), "counts": pa.list_(pa.int64()), "targets": pa.list_(pa.int64())}
    names = [c.split()[0] for c in PACKED.split(", ")]
    scalar = {"key": pa.int32(), "kind": pa.int32(), "features": pa.int64(), "target_features": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n) or scalar[n]) for n in names], names=names)


def _pack(slice_: int, ids: np.ndarray, hashes: np.ndarray, words: list[int], found: list[np.ndarray], here: np.ndarray) -> pa.RecordBatch:
    """A block's documents and, for each range of buckets, its postings sorted by bucket. here: counts by bucket, added to."""
    n = len(ids)
    sizes = [len(x) for x in found]
    codes = np.concatenate(found).astype(np.int64) * n + np.repeat(np.arange(n), sizes)
    pairs, times = np.unique(codes, return_counts=True)
    bucket, at = pairs // n, (pairs % n).astype(np.int32)
    np.add.at(here, bucket, times)
    cuts = np.searchsorted(bucket * RANGES // BUCKETS, np.arange(RANGES + 1))
    plain = lambda x: pa.array(x, from_pandas=True)
    rows = [{"key": (slice_ % RANGES) * SLICES + slice_ // RANGES % SLICES, "kind": DOCUMENTS, "ids": ids, "hashes": hashes, "counts": words}]
    for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            own, place = np.unique(at[a:b], return_inverse=True)
            rows.append({"key": r * SLICES + slice_ % SLICES, "kind": POSTINGS, "ids": ids.take(plain(own)), "hashes": hashes.take(plain(own)), "at": place.astype(np.int32), "buckets": bucket[a:b].astype(np.int32), "counts": times[a:b]})
    return _batch(rows)


def _invert(block_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, there = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        turn = count(TaskContext.get().partitionId())
        ids, hashes, words, found, size = [], [], [], [], 0
        block = lambda: _pack(next(turn), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), words, found, here)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("target", "doc_id", "hash")]
            for target, doc, hash_, text in zip(*columns, batch.column("text").cast(pa.large_binary())):
                n, buckets = features(text.as_py())
                if target:
                    np.add.at(there, buckets, 1)
                    continue
                ids.append(doc)
                hashes.append(hash_)
                words.append(n)
                found.append(buckets)
                size += len(buckets)
                if size >= block_features:
                    yield block()
                    ids, hashes, words, found, size = [], [], [], [], 0
        if ids:
            yield block()
        totals = []
        for r in range(RANGES):
            own = np.arange(-(-r * BUCKETS // RANGES), -(-(r + 1) * BUCKETS // RANGES))
            own = own[(here[own] > 0) | (there[own] > 0)]
            row = {"kind": TOTALS, "buckets": own.astype(np.int32), "counts": here[own], "targets": there[own], "features": int(here.sum()), "target_features": int(there.sum())}
            totals += [row | {"key": r * SLICES + k} for k in range(SLICES)]
        if here.any() or there.any():
            yield _batch(totals)

    return run


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key and kind: totals of the key's buckets first, then postings, then documents."""
    key, gains = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            own = {n: batch.column(n)[row] for n in batch.schema.names}
            flat = lambda name: own[name].values.to_numpy(zero_copy_only=False)
            if own["key"].as_py() != key:
                key, gains = own["key"].as_py(), None
                here, there, s_all, t_all = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0, 0
            kind = own["kind"].as_py()
            if kind == TOTALS:
                here[flat("buckets")] += flat("counts")
                there[flat("buckets")] += flat("targets")
                s_all += own["features"].as_py()
                t_all += own["target_features"].as_py()
                continue
            ids = own["ids"].values
            n = len(ids)
            if kind == POSTINGS:
                if gains is None:
                    gains = np.zeros(BUCKETS, np.int64)
                    for b in np.flatnonzero(here):
                        gains[b] = gain(int(here[b]), int(there[b]), s_all, t_all)
                part = np.zeros(n, np.int64)
                np.add.at(part, flat("at"), gains[flat("buckets")] * flat("counts"))
                copies, words = np.zeros(n, np.int64), np.zeros(n, np.int64)
            else:
                part, copies, words = np.zeros(n, np.int64), np.ones(n, np.int64), flat("counts")
            yield pa.RecordBatch.from_arrays([ids, own["hashes"].values, pa.array(part), pa.array(copies), pa.array(words)], names=[c.split()[0] for c in PARTS.split(", ")])


def weights(docs: DataFrame, target: DataFrame, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """doc_id, words, n_features, weight: the sum of the gains of a document's features, for each row of docs (doc_id, text).

    A bucket's gain is floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))) with its counts s and t in docs and target and
    all counts S and T. Null texts and texts without words have weight 0. Rows equal in doc_id and text are weighed as one
    and all returned; each counts in s and S. An empty target or empty docs are no error.
    """
    text = F.col("text")
    own = docs.select(F.lit(False).alias("target"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), text)
    other = target.select(F.lit(True).alias("target"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("hash"), text)
    packed = own.union(other).mapInArrow(_invert(block_features), PACKED)
    parts = packed.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_contribute, PARTS)
    summed = parts.groupBy("doc_id", "hash").agg(F.sum("part").alias("part"), F.sum("copies").alias("copies"), F.max("words").alias("words"))
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n = F.col("words")
    return each.select("doc_id", n, (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("n_features"), F.expr("part div copies").alias("weight"))


def ranked(df: DataFrame, eligible: str, order: list) -> DataFrame:
    """df with place: 1, 2, 3, ... of the eligible rows in the given order, null for others. No task gets all rows.

    Rows are dealt out by ranges of the order and written; the driver adds up one count for each range.
    """
    spark = df.sparkSession
    by = [F.col(eligible).desc(), *order]
    sorted_ = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sums, before = [], 0
    for p, n in sorted(tuple(r) for r in sorted_.groupBy(part.alias("p")).agg(F.count_if(eligible).alias("n")).collect()):
        sums.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(sums, "_part long, _before long"))
    place = F.when(F.col(eligible), F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    return sorted_.withColumn("_part", part).join(starts, "_part").withColumn("place", place).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long): a draw without replacement by Gumbel keys.

    Of the documents with at least least_words words, percent hundredths (rounded down) with the highest scores are drawn and
    ranked from 1, ties by doc_id, null last; the rest have no rank. The noise comes from the seed and doc_id (a null one
    counts as an empty text), so reruns agree. Repeated rows are drawn each by itself.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights(docs, target, block_features).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("words") >= least_words)
    placed = ranked(materialize(scored, "scored"), "able", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    k = percent * placed.filter("able").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= k, F.col("place")).alias("rank"))


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs.select("doc_id", "text"), benchmark.select("text"))
