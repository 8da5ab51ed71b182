"""Repeated windows of texts, found through runs of windows that share a minimiser.

A window is k consecutive units (words or bytes) of one text; its minimiser is the smallest hash among its m-unit
parts, so equal windows have equal minimisers wherever they stand. Consecutive windows with one minimiser
form a run, which travels as one packed string. Everything is exact: hashes only decide which strings meet, and
windows are equal if their units are.

Order of the work: minimisers that can't be in two places drop out; the runs left are reduced to distinct strings,
each with its first place; strings that share a minimiser are compared window by window, where few of them do in one
row, and where many do dealt out by window; what this finds is brought back to each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

#: Units hashed at once, and most of one text.
GROUP = 262_144
#: Distinct strings of one minimiser up to which they are compared in one row.
TOGETHER = 400
#: Windows of a block, where more strings share a minimiser.
BLOCK = 8
LAST = (1 << 63) - 1
#: More than any start of a window in its text.
_PLACE = 1 << 33
#: More than the units of a group.
_PLACES = 1 << 20

U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(6)).integers(1, LAST, 256, dtype=np.uint64)
_STEPS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)]
_ODD = 0x5851F42D4C957F2D


class Spec(NamedTuple):
    """unit: 'words' or 'bytes'. within: whether a repeat may be in the same text."""

    unit: str
    k: int
    m: int
    within: bool


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _STEPS[3]
    return x ^ (x >> U(29))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        out = np.full(max(n, 1 << 16), base & ((1 << 64) - 1), dtype=np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words data[start:end] through prefix sums."""
    sums = np.cumsum((data.astype(np.uint64) + U(1)) * _power("up", _ODD, len(data)), dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], U(0))
    return _mix((sums[ends - 1] - before) * _power("down", pow(_ODD, -1, 1 << 64), len(data))[starts])


def _minimisers(units: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the place of the smallest hash of an m-unit part, the last such; the hashes of all parts. m is a power of two.

    As the place is the last one, no two windows of one run are equal.
    """
    x, w, s = units, 1, 0
    while w < m:
        x = x[:-w] * _STEPS[s] + x[w:]
        w, s = 2 * w, s + 1
    x = _mix(x)
    low = U(_PLACES - 1)
    y = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))
    w, width = 1, k - m + 1
    n = len(y) - width + 1
    while 2 * w <= width:
        y = np.minimum(y[:-w], y[w:])
        w *= 2
    return low - (np.minimum(y[:n], y[width - w : width - w + n]) & low), x


class Runs(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    h: np.ndarray
    #: Units from the run's start to its minimiser.
    place: np.ndarray
    #: Byte offsets in data of each run's packed string.
    at: np.ndarray
    to: np.ndarray
    data: bytes


def find(texts: list[bytes | None], spec: Spec) -> Iterator[Runs]:
    """Runs of the texts, in groups of bounded size. Long texts are cut into overlapping pieces; no window is lost."""
    rows, offsets, pieces, sizes, total = [], [], [], [], 0
    for row, text in enumerate(texts):
        units = (text or b"").split() if spec.unit == "words" else (text or b"")
        if len(units) < spec.k:
            continue
        for a in range(0, len(units) - spec.k + 1, GROUP):
            piece = units[a : a + GROUP + spec.k - 1]
            rows.append(row)
            offsets.append(a)
            sizes.append(len(piece))
            pieces.append(b" ".join(piece) if spec.unit == "words" else piece)
            total += len(piece)
            if total >= GROUP:
                yield _runs(rows, offsets, pieces, sizes, spec)
                rows, offsets, pieces, sizes, total = [], [], [], [], 0
    if pieces:
        yield _runs(rows, offsets, pieces, sizes, spec)


def _runs(rows: list[int], offsets: list[int], pieces: list[bytes], sizes: list[int], spec: Spec) -> Runs:
    words = spec.unit == "words"
    data = (b" " if words else b"").join(pieces)
    raw = np.frombuffer(data, np.uint8)
    if words:
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
        units = _word_hashes(raw, starts, ends)
    else:
        units = _BYTE[raw]
        starts = ends = np.arange(len(raw) + 1)
    least, hashes = _minimisers(units, spec.k, spec.m)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    n = len(least)
    whole = piece[:n] == piece[spec.k - 1 :]
    same = np.zeros(n, bool)
    same[1:] = whole[1:] & whole[:-1] & (least[1:] == least[:-1]) & (piece[1:n] == piece[: n - 1])
    begin = np.flatnonzero(whole & ~same)
    last = np.ones(n, bool)
    last[:-1] = ~same[1:]
    end = np.flatnonzero(whole & last)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    p = piece[begin]
    stop = end + spec.k - 1
    return Runs(
        np.asarray(rows)[p], begin - first[p] + np.asarray(offsets)[p], end - begin + 1, hashes[least[begin]].view(np.int64), least[begin].astype(np.int64) - begin,
        starts[begin], ends[stop] if words else stop + 1, data,
    )


def windows(packed: bytes, spec: Spec) -> list[bytes]:
    """The windows of a packed string, in order."""
    if spec.unit == "bytes":
        return [packed[i : i + spec.k] for i in range(len(packed) - spec.k + 1)]
    words = packed.split(b" ")
    return [b" ".join(words[i : i + spec.k]) for i in range(len(words) - spec.k + 1)]


def _minimiser_rows(spec: Spec, *carried: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_numpy() for c in carried]
            for r in find(batch.column("text").to_pylist(), spec):
                yield pa.RecordBatch.from_arrays([pa.array(r.h), *[pa.array(v[r.row]) for v in values]], names=["h", *carried])

    return run


def _run_rows(spec: Spec, packed: bool) -> Callable:
    names = ["h", "p1", "p2", "ord", "key", "start", "n", *["packed"] * packed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, key = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            wanted = [np.asarray(x.as_py(), np.int64) for x in batch.column("hs")]
            sizes = np.array([len(x) for x in wanted])
            for r in find(batch.column("text").to_pylist(), spec):
                # One lookup for the whole group: minimisers wanted by any of its texts.
                mine = np.unique(np.concatenate([wanted[i] for i in np.unique(r.row)])) if sizes.any() else np.empty(0, np.int64)
                at = np.flatnonzero(np.isin(r.h, mine))
                if not len(at):
                    continue
                strings = [r.data[a:b] for a, b in zip(r.at[at].tolist(), r.to[at].tolist())]
                ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)
                columns = [pa.array(r.h[at]), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(order[r.row[at]]), pa.array(key[r.row[at]]), pa.array(r.start[at].astype(np.int64)), pa.array(r.count[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(strings, pa.binary())] if packed else []), names=names)

    return run


_RUN = "h long, p1 long, p2 long, ord long, key long, start long, n int"
_EARLIER = "p1 long, p2 long, js array<int>"


def _compare(spec: Spec) -> Callable:
    """Rows of strings that share a minimiser -> for each string the windows that are elsewhere earlier.

    The strings are sorted by their first places, so the first of equal windows is the earliest: runs of a text don't overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column("strings")
            ends, values = lists.offsets.to_pylist(), lists.values
            rows = list(zip(*[values.field(c).to_pylist() for c in ("ord", "start", "p1", "p2", "packed")]))
            for a, b in zip(ends, ends[1:]):
                strings = sorted(rows[a:b])
                found: dict[int, list[int]] = {}
                heads: dict[bytes, int] = {}
                size = 0
                for s, (order, _, _, _, packed) in enumerate(strings):
                    for j, w in enumerate(windows(packed, spec)):
                        head = heads.setdefault(w, order)
                        if spec.within and len(heads) == size or head < order:
                            found.setdefault(s, []).append(j)
                        size = len(heads)
                out += [(*strings[s][2:4], js) for s, js in found.items()]
            p1, p2, js = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(js, pa.list_(pa.int32()))], names=["p1", "p2", "js"])

    return run


def _deal(spec: Spec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p1, p2, order, start, packed in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "ord", "start", "packed")]):
                w = windows(packed, spec)
                n = len(w)
                js = range(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w, pa.binary()), pa.array([p1] * n), pa.array([p2] * n), pa.array(js, pa.int32()), pa.array([order] * n), pa.array([start + j if spec.within else 0 for j in js], pa.int64())],
                    names=["w", "p1", "p2", "j", "ord", "place"],
                )

    return run


def _blocks(spec: Spec) -> Callable:
    """Strings -> their blocks of BLOCK windows, in step with the minimiser, which all strings of one minimiser have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("p1", "p2", "ord", "start", "packed")
        for batch in batches:
            out = []
            for p1, p2, order, start, packed in zip(*[batch.column(c).to_pylist() for c in names]):
                (r,) = find([packed], spec)
                units, glue = (packed.split(b" "), b" ".join) if spec.unit == "words" else (packed, bytes)
                n = len(units) - spec.k + 1
                j = 0
                while j < n:
                    end = min(n, j + BLOCK - (j - int(r.place[0])) % BLOCK)
                    block = glue(units[j : end + spec.k - 1])
                    b1, b2 = np.frombuffer(xxhash.xxh3_128_digest(block), np.int64).tolist()
                    out.append((p1, p2, j, end - j, b1, b2, order, start + j if spec.within else 0, block))
                    j = end
            columns = list(zip(*out)) if out else [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["p1", "p2", "j", "n", "b1", "b2", "ord", "start", "packed"])

    return run


def _among_many(strings: DataFrame, spec: Spec) -> DataFrame:
    """As _compare, for minimisers with many strings: blocks first, each distinct one once, then the windows of distinct blocks, dealt out."""
    schema = "p1 long, p2 long, j int, n int, b1 long, b2 long, ord long, start long, packed binary"
    blocks = materialize(strings.mapInArrow(_blocks(spec), schema), "blocks", release=True)
    heads = blocks.groupBy("b1", "b2", "packed").agg(F.min(F.struct("ord", "start")).alias("lo"))
    heads = materialize(heads.select(F.col("b1").alias("p1"), F.col("b2").alias("p2"), "lo.ord", "lo.start", "packed"), "heads", release=True)
    each = heads.mapInArrow(_deal(spec), "w binary, p1 long, p2 long, j int, ord long, place long")
    first = each.groupBy("w").agg(F.min(F.struct("ord", "place")).alias("head"), F.count("*").alias("k")).filter("k > 1").select("w", "head")
    later = each.join(first, "w").filter(F.struct("ord", "place") > F.col("head")).groupBy("p1", "p2").agg(F.collect_list("j").alias("within"))
    known = heads.select("p1", "p2", F.struct("ord", "start").alias("lo")).join(later, ["p1", "p2"], "left")
    known = known.select(F.col("p1").alias("b1"), F.col("p2").alias("b2"), "lo", "within")
    placed = blocks.drop("packed").join(known, ["b1", "b2"])
    js = F.when(F.struct("ord", "start") > F.col("lo"), F.sequence(F.col("j"), F.col("j") + F.col("n") - 1)).otherwise(F.transform("within", lambda x: x + F.col("j")))
    found = placed.withColumn("js", js).filter("js is not null")
    return found.groupBy("p1", "p2").agg(F.flatten(F.collect_list("js")).alias("js"))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text -> ord (null ids last), key (equal for equal rows) and text as bytes."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.col("text").cast("binary")
    return docs.select(order.alias("ord"), F.xxhash64(order, text).alias("key"), text.alias("text"))


def repeated(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """docs as from prepared -> (texts with runs that may repeat: key, ord, text; marks: key, full array<struct<start, n>>, some array<long>).

    full: runs of which all n windows from start on stand earlier too; some: starts of single windows that do.
    Rows that are equal in id and text are one text.
    """
    full = docs.filter("text is not null")
    if spec.within:
        shared = full.mapInArrow(_minimiser_rows(spec), "h long").groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    else:
        shared = full.mapInArrow(_minimiser_rows(spec, "ord"), "h long, ord long").groupBy("h").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi")
    shared = materialize(shared.select("h"), "shared", release=True)
    hits = full.mapInArrow(_minimiser_rows(spec, "key"), "h long, key long").join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    texts = materialize(docs.join(hits, "key"), "texts", release=True)
    first = texts.mapInArrow(_run_rows(spec, True), f"{_RUN}, packed binary")
    # One number for a place, and the string among the keys, so that the aggregation needs no sort.
    place = F.col("ord").cast("decimal(20,0)") * F.lit(_PLACE).cast("decimal(11,0)") + F.col("start")
    strings = first.groupBy("h", "p1", "p2", "packed").agg(F.min(place).alias("lo"))
    start = F.pmod(F.col("lo"), F.lit(_PLACE).cast("decimal(11,0)"))
    strings = strings.select("h", "p1", "p2", ((F.col("lo") - start) / F.lit(_PLACE).cast("decimal(11,0)")).cast("long").alias("ord"), start.cast("long").alias("start"), "packed")
    strings = materialize(strings, "strings", release=True)
    sizes = strings.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    sized = strings.join(sizes, "h")
    few = sized.filter(F.col("k") <= TOGETHER).groupBy("h").agg(F.collect_list(F.struct("p1", "p2", "ord", "start", "packed")).alias("strings"))
    few = few.select("strings").mapInArrow(_compare(spec), _EARLIER)
    many = sized.filter(F.col("k") > TOGETHER).select("p1", "p2", "ord", "start", "packed")
    earlier = few.union(_among_many(many, spec))
    known = strings.select("p1", "p2", F.col("ord").alias("ord0"), F.col("start").alias("start0")).join(earlier, ["p1", "p2"], "left")
    known = materialize(known, "known", release=True)
    places = texts.mapInArrow(_run_rows(spec, False), _RUN)
    placed = places.join(known, ["p1", "p2"])
    later = F.col("ord") > F.col("ord0")
    if spec.within:
        later = later | ((F.col("ord") == F.col("ord0")) & (F.col("start") > F.col("start0")))
    full = F.collect_list(F.when(later, F.struct("start", "n"))).alias("full")
    some = F.flatten(F.collect_list(F.when(~later, F.transform("js", lambda j: F.col("start") + j)))).alias("some")
    marks = placed.filter(later | F.col("js").isNotNull()).groupBy("key").agg(full, some)
    return texts, marks


def _covered(n_units: int, starts: np.ndarray, counts: np.ndarray, singles: np.ndarray, k: int) -> np.ndarray:
    """Which units are covered by marked windows."""
    edges = np.bincount(np.concatenate((starts, singles)), minlength=n_units + 1)
    edges -= np.bincount(np.concatenate((starts + counts + k - 1, singles + k)), minlength=n_units + 1)
    return np.cumsum(edges[:-1]) > 0


def removed(texts: DataFrame, marks: DataFrame, spec: Spec) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 and kept (what is left, as bytes) of the texts that have marks; one row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            full, some = batch.column("full"), batch.column("some")
            starts, counts = full.values.field("start").to_numpy(), full.values.field("n").to_numpy()
            singles, at, to = some.values.to_numpy(), full.offsets.to_numpy(), some.offsets.to_numpy()
            for r, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"))):
                text = text.as_py()
                own, ones = slice(at[r], at[r + 1]), slice(to[r], to[r + 1])
                units = text.split() if spec.unit == "words" else text
                gone = _covered(len(units), starts[own], counts[own], singles[ones], spec.k)
                if spec.unit == "words":
                    kept = b" ".join([units[i] for i in np.flatnonzero(~gone)])
                else:
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.select("key", "text").join(marks, "key")
    return joined.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
