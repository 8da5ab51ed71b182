"""Dedup by prefix-free parsing: bytes of 100-byte strings that also start earlier are removed.

Parsing. A position is a trigger if the rolling hash of its 32 bytes is the smallest in some 100 bytes, so every 100-byte
string has a trigger and no stretch goes without, whatever it holds. A phrase is the stretch of positions with
one trigger together with the 99 bytes that its last position still needs; phrases overlap by that much, so every
100-byte string lies in exactly one phrase, and equal strings lie in phrases with the same trigger at the same distance.

Dictionary and parse. The dictionary has each distinct phrase once, with its first place; the parse has the places of
phrases. Phrases whose trigger stands once in the corpus are left out of both: none of their strings repeats.

Order. A position's suffix is the bytes up to its trigger and the bytes from there. For each trigger the dictionary is put
in two orders, of what goes before the trigger (read backwards) and of what follows, with the lengths of common
prefixes; together they give the classes of equal 100-byte strings of all positions at once. Only the first 100 bytes of
suffixes matter here, so the order in the corpus beyond them is that of places: the parse decides it, and all of a class but
its first place go. Triggers with many phrases are split by longer and longer parts that all strings of a range of positions share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import runs
from glyphmill.storage import materialize

K, GRAM = 100, 32
SPEC = runs.Spec("bytes", K, GRAM, within=True)
#: Distances from a position to its trigger.
FAR = K - GRAM
#: Phrases of one key up to which they are sorted in one task; phrases sorted at once (whole keys only, so more at times).
TOGETHER, AT_ONCE = 4000, 12_000


def _triggers(*carried: str) -> Callable:
    """Texts -> a row for each phrase: the hash of its trigger, and columns carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_numpy() for c in carried]
            for r in runs.find(batch.column("text").to_pylist(), SPEC):
                yield pa.RecordBatch.from_arrays([pa.array(r.h), *[pa.array(v[r.row]) for v in values]], names=["h", *carried])

    return run


_PLACE = "p1 long, p2 long, key long, ord long, start long, n int"
_ENTRY = "h long, p1 long, p2 long, ord long, start long, at int, n int, packed binary"


def _phrases(dictionary: bool) -> Callable:
    """Texts with the triggers wanted -> entries of the dictionary or places of the parse. A phrase's name is a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, key = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            wanted = [np.asarray(x.as_py(), np.int64) for x in batch.column("hs")]
            for r in runs.find(batch.column("text").to_pylist(), SPEC):
                mine = np.unique(np.concatenate([wanted[i] for i in np.unique(r.row)]))
                at = np.flatnonzero(np.isin(r.h, mine))
                if not len(at):
                    continue
                strings = [r.data[a:b] for a, b in zip(r.at[at].tolist(), r.to[at].tolist())]
                names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)
                named = [pa.array(names[:, 0]), pa.array(names[:, 1])]
                order_, start = pa.array(order[r.row[at]]), pa.array(r.start[at].astype(np.int64))
                n = pa.array(r.count[at].astype(np.int32))
                if dictionary:
                    columns = {"h": pa.array(r.h[at]), "p1": named[0], "p2": named[1], "ord": order_, "start": start, "at": pa.array(r.place[at].astype(np.int32)), "n": n, "packed": pa.array(strings, pa.binary())}
                else:
                    columns = {"p1": named[0], "p2": named[1], "key": pa.array(key[r.row[at]]), "ord": order_, "start": start, "n": n}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _ordered(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes within equal keys -> the order, and for each row in order what it has in common with the row before (-1: another key)."""
    width = rows.shape[1]
    whole = np.concatenate((keys.astype(">i8").view(np.uint8).reshape(-1, 8), rows), axis=1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"S{width + 8}").ravel(), kind="stable")
    put, other = rows[order], keys[order]
    unlike = put[1:] != put[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), width)
    common[other[1:] != other[:-1]] = -1
    return order, np.concatenate(([-1], common))


def repeats(key: np.ndarray, place: np.ndarray, at: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of phrases that stand earlier in others of the same key -> (phrase, offset in it), by phrase.

    place: ranks of the triggers' first places; lo, hi: the distances to the trigger that count for each phrase.
    """
    m = len(packed)
    sizes = np.fromiter(map(len, packed), np.int64, m)
    data = np.concatenate((np.frombuffer(b"".join(packed), np.uint8), np.zeros(1, np.uint8)))
    trigger = np.cumsum(sizes) - sizes + at
    back, ahead = np.arange(1, FAR + 1), np.arange(K)
    left = np.where(back <= at[:, None], data[np.maximum(trigger[:, None] - back, 0)], 0)
    right = np.where(ahead < (sizes - at)[:, None], data[np.minimum(trigger[:, None] + ahead, len(data) - 1)], 0)
    (by_left, common_left), (by_right, common_right) = _ordered(key, left), _ordered(key, right)
    before, after = np.empty(m, np.int64), np.empty(m, np.int64)
    first, last = np.maximum(lo, at - n + 1), np.minimum(hi, at)
    by_place = np.argsort(place, kind="stable")
    phrases, offsets = [], []
    for a in range(int(first.min()), int(last.max()) + 1):
        mine = by_place[((first <= a) & (a <= last))[by_place]]
        if len(mine) < 2:
            continue
        before[by_left] = np.cumsum(common_left < a)
        after[by_right] = np.cumsum(common_right < K - a)
        name = before[mine] * (m + 1) + after[mine]
        order = np.argsort(name, kind="stable")
        name = name[order]
        head = np.concatenate(([True], name[1:] != name[:-1]))
        p = place[mine[order]]
        later = mine[order[p > p[head][np.cumsum(head) - 1]]]
        phrases.append(later)
        offsets.append(at[later] - a)
    which, where = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (phrases, offsets))
    order = np.lexsort((where, which))
    return which[order], where[order]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the dictionary, those of a key together -> p1, p2, js: the offsets of strings that stand earlier."""

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t.column("h").to_numpy()
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        t = t.filter(pa.array(same[1:] | same[:-1]))
        if not t.num_rows:
            return
        c = {k: t.column(k).to_numpy() for k in ("h", "p1", "p2", "ord", "start", "at", "n", "lo", "hi")}
        place = np.lexsort((c["start"] + c["at"], c["ord"]))
        same = (np.diff(c["ord"][place]) == 0) & (np.diff((c["start"] + c["at"])[place]) == 0)
        rank = np.empty(len(place), np.int64)
        rank[place] = np.concatenate(([0], np.cumsum(~same)))
        which, where = repeats(c["h"], rank, c["at"].astype(np.int64), c["n"], c["lo"], c["hi"], t.column("packed").to_pylist())
        if len(which):
            begin = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            ends = np.append(begin, len(which)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["p1"][which[begin]]), pa.array(c["p2"][which[begin]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(where.astype(np.int32)))], names=["p1", "p2", "js"]
            )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= AT_ONCE:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            turns = np.flatnonzero(h[1:] != h[:-1]) + 1
            if len(turns):  # the last key may go on in the next batch
                a = 0
                for b in [*turns[np.searchsorted(turns, np.arange(AT_ONCE, turns[-1], AT_ONCE))].tolist(), int(turns[-1])]:
                    if b > a:
                        yield from out(t.slice(a, b - a))
                        a = b
                held = t.slice(a).combine_chunks().to_batches()
                size = sum(x.num_rows for x in held)
    if held:
        yield from out(pa.Table.from_batches(held))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries -> two for each half of its distances, with the hash of what all 100-byte strings of that half share as the new key."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            first, last = max(r["lo"], r["at"] - r["n"] + 1), min(r["hi"], r["at"])
            middle = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                if lo <= hi and max(lo, first) <= min(hi, last):
                    # Every entry of this key has the bytes, or no string in the range.
                    a, b = r["at"] - max(lo, 0), r["at"] + K - hi
                    part = r["packed"][max(a, 0) : b] if a >= 0 else b""
                    out.append(r | {"h": xxhash.xxh3_64_intdigest(part, hi + 1) - (1 << 63), "lo": lo, "hi": hi})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _classes(entries: DataFrame) -> DataFrame:
    """p1, p2, js of the dictionary's entries: offsets of strings that also stand at an earlier first place of a phrase."""
    schema = f"{_ENTRY}, lo int, hi int"
    found, width = [], FAR + 1
    level = entries.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(FAR)).select("h", "p1", "p2", "ord", "start", "at", "n", "packed", "lo", "hi")
    while True:
        crowded = level.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > TOGETHER).select(F.col("h").alias("g"))
        crowded = materialize(crowded, "crowded")
        # One shuffle of the dictionary; keys with one phrase are told apart by their neighbours in the sorted task.
        few = level.join(crowded, F.col("h") == F.col("g"), "left_anti").repartition("h").sortWithinPartitions("h")
        found.append(materialize(few.mapInArrow(_sort, "p1 long, p2 long, js array<int>"), "repeats", release=True))
        if not crowded.limit(1).count():
            break
        many = level.join(crowded, F.col("h") == F.col("g"), "left_semi")
        if width == 1:
            # What they share is the whole string: an aggregation to its first place, without sorting.
            each = many.select("p1", "p2", (F.col("at") - F.col("lo")).alias("j"), F.struct("ord", (F.col("start") + F.col("at")).alias("pos")).alias("place"), F.expr(f"substring(packed, at - lo + 1, {K})").alias("s"))
            heads = materialize(each.groupBy("s").agg(F.min("place").alias("head")), "heads", release=True)
            later = each.join(heads, "s").filter(F.col("place") > F.col("head"))
            found.append(materialize(later.select("p1", "p2", F.array("j").alias("js")), "repeats"))
            break
        level, width = materialize(many.mapInArrow(_split, schema), "split", release=True), (width + 1) // 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out if len(found) == 1 else out.groupBy("p1", "p2").agg(F.flatten(F.collect_list("js")).alias("js"))


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as from runs.prepared -> (texts that may hold repeats, marks of their repeated strings), as runs.removed takes them."""
    full = docs.filter("text is not null")
    shared = full.mapInArrow(_triggers(), "h long").groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    shared = materialize(shared, "triggers", release=True)
    hits = full.mapInArrow(_triggers("key"), "h long, key long").join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    texts = materialize(docs.join(hits, "key"), "texts", release=True)
    # One number for a place, and the string among the keys, so that the aggregation needs no sort.
    wide = F.lit(1 << 33).cast("decimal(11,0)")
    place = F.col("ord").cast("decimal(20,0)") * wide + F.col("start")
    entries = texts.mapInArrow(_phrases(True), _ENTRY).groupBy("h", "p1", "p2", "at", "n", "packed").agg(F.min(place).alias("lo"))
    start = F.pmod(F.col("lo"), wide)
    entries = entries.select("h", "p1", "p2", ((F.col("lo") - start) / wide).cast("long").alias("ord"), start.cast("long").alias("start"), "at", "n", "packed")
    entries = materialize(entries, "dictionary", release=True)
    known = entries.select("p1", "p2", F.col("ord").alias("ord0"), F.col("start").alias("start0")).join(_classes(entries), ["p1", "p2"], "left")
    known = materialize(known, "known", release=True)
    parse = texts.mapInArrow(_phrases(False), _PLACE).join(known, ["p1", "p2"])
    later = (F.col("ord") > F.col("ord0")) | ((F.col("ord") == F.col("ord0")) & (F.col("start") > F.col("start0")))
    whole = F.collect_list(F.when(later, F.struct("start", "n"))).alias("full")
    some = F.flatten(F.collect_list(F.when(~later, F.transform("js", lambda j: F.col("start") + j)))).alias("some")
    return texts, parse.filter(later | F.col("js").isNotNull()).groupBy("key").agg(whole, some)


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null where nothing is removed).

    A row for each row. A null text has no bytes. A null doc_id counts as the largest. Rows equal in doc_id and text
    count as one text, as do their places. The bytes left need not be whole characters.
    """
    texts, marks = repeated(runs.prepared(docs))
    changed = materialize(runs.removed(texts, marks, SPEC).dropDuplicates(["key"]), "changed")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(runs.LAST)), F.col("text").cast("binary")).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("sha"),
    )
    out = plain.join(changed, "key", "left")
    none = F.lit(0)
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).cast("long").alias("n_removed"), F.coalesce("n_spans", none).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def op10(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).drop("kept")
