"""MinHash near-duplicates with tensored banding.

Two families of ROWS small collections of WIDTH minhashes each; a table key combines one collection of either
family, so ROWS * ROWS tables of 2 * WIDTH minhashes need only 2 * ROWS * WIDTH of them. Texts that share neither
family's collections with any other text drop out before keys are formed. Candidates are confirmed on full sets.

Members of a table key are compared with one pivot of the key at a time, first with the one whose collections are the most
common ones (the middle of its group), then with one chosen by a hash; what lies together is not compared again.
Members still apart after that meet on rarest-first prefixes, which leave out no pair that has the similarity.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

U = np.uint64

#: A pair with similarity 0.8 shares no table with probability 2 * (1 - 0.8 ** WIDTH) ** ROWS = 2e-5.
ROWS, WIDTH = 16, 3
PERCENT = 80
#: Longs of a set's parity bitmap. Each bit that differs between two bitmaps is at least one shingle that only one set has.
LONGS = 8
#: Shingles hashed at once.
STEP = 400_000

_SEED = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, size=(2, 2 * ROWS * WIDTH), dtype=np.uint64)
_MULTIPLY, _ADD = _SEED[0] | np.uint64(1), _SEED[1]


def shingles(text: bytes | None, width: int = 2) -> set[bytes]:
    """Distinct shingles of width words, A-Z as a-z; a text with fewer words is its own shingle."""
    return _shingles(text.lower().split() if text else [], width)


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(p) for p in zip(*(words[k:] for k in range(width)))} if len(words) >= width else {b" ".join(words)} if words else set()


def _hash(sets: list[set[bytes]]) -> np.ndarray:
    """64-bit hashes of all shingles; Python's own hash isn't the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(s) for one in sets for s in one), np.uint64, sum(map(len, sets)))


def _signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(_MULTIPLY)), np.uint64)
    for k in range(len(_MULTIPLY)):
        x = hashes * _MULTIPLY[k] + _ADD[k]
        x ^= x >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x * np.uint64(0x9E3779B97F4A7C15), starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, same (digest of the words, so of the set), bands, bits (parity bitmap)."""
    prime = np.uint64(0x100000001B3)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(ids):
            sets, words, size, begin = [], [], 0, at
            while at < len(ids) and size < STEP:
                words.append((texts[at].as_py() or b"").lower().split())
                sets.append(_shingles(words[-1], width))
                size += len(sets[-1])
                at += 1
            full = [i for i, s in enumerate(sets) if s]
            n = [len(s) for s in sets]
            bands, bits, same = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                counts = np.array([n[i] for i in full])
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                hashes = _hash([sets[i] for i in full])
                sig = _signatures(hashes, starts)
                groups = sig.reshape(len(full), 2 * ROWS, WIDTH)
                key = np.zeros(groups.shape[:2], np.uint64)
                for j in range(WIDTH):
                    key = (key ^ groups[:, :, j]) * prime
                    key ^= key >> np.uint64(29)
                bit, word = U(1) << (hashes & U(63)), (hashes >> U(6)) % U(LONGS)
                odd = np.stack([np.bitwise_xor.reduceat(np.where(word == U(k), bit, U(0)), starts) for k in range(LONGS)], axis=1).view(np.int64)
                key = key.view(np.int64)
                for r, i in enumerate(full):
                    bands[i], bits[i] = key[r], odd[r]
                    same[i] = hashlib.sha256(b" ".join(words[i])).digest()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[begin:at], pa.int64()), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "same", "bands", "bits"],
            )


def _fits(n: str, bits: str, m: str, others: str) -> Column:
    """Whether two sets may be similar enough, by their sizes and bitmaps: never false for a pair that is."""
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    unlike = sum((F.bit_count(F.get(bits, k).bitwiseXOR(F.get(others, k))) for k in range(LONGS)), F.lit(0))
    return sizes & (unlike * (100 + PERCENT) <= (F.col(n) + F.col(m)) * (100 - PERCENT))


def _confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have the similarity: exact, from the texts."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i in range(len(a)):
                # Rows of one left text mostly follow each other.
                if last[0] != a[i]:
                    last = (a[i], shingles(batch.column("text_a")[i].as_py(), width))
                one, two = last[1], shingles(batch.column("text_b")[i].as_py(), width)
                common = len(one & two)
                keep.append(100 * common >= PERCENT * (len(one) + len(two) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for a in range(0, len(nodes), 500):
            sets = [shingles(t.as_py(), width) for t in batch.column("text")[a : a + 500]]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[a : a + 500], n)), pa.array(_hash(sets).view(np.int64))], names=["node", "g"])


def _by_prefix(rest: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of different components among rest that may have the similarity; none that has it is left out.

    In any order of shingles two such sets share one among the first 20 % + 1 of each. The order here is rarest first: in a
    group of near copies these are the words that set a copy apart, so the copies of a large group don't all meet.
    Shingles of a single text come before all others and meet nothing; they are counted, not moved. Of the members of a
    shingle only those outside its largest component look for others, and a pair is made at its first common shingle alone.
    """
    rows = texts.join(rest.select("node"), "node", "left_semi").select("node", "text").mapInArrow(functools.partial(_shingle_rows, width=width), "node long, g long")
    rows = materialize(rows.distinct(), "shingles", release=True)
    common = rows.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    own = rows.join(common, "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    held = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("gs"))
    first = own.join(rest, "node").filter(held > 0).select("node", "n", "bits", "comp", F.slice("gs.g", F.lit(1), F.greatest(held, F.lit(0)).cast("int")).alias("gs"))
    first = first.select(F.posexplode("gs").alias("at", "g"), F.struct("node", "n", "bits").alias("x"), "comp", "gs")
    first = materialize(first.withColumn("gs", F.slice("gs", F.lit(1), F.col("at"))).drop("at"), "prefixes")
    sizes = first.groupBy("g", "comp").agg(F.count("*").alias("k"))
    main = materialize(sizes.groupBy("g").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("c")).filter("c > 1").select(F.col("g").alias("m"), "main"), "main")
    minor = first.join(main, F.col("g") == F.col("m")).filter("comp <> main").drop("m")
    again = first.select(F.col("g").alias("h"), F.col("x").alias("y"), F.col("comp").alias("other"), F.col("gs").alias("earlier"))
    fits = _fits("x.n", "x.bits", "y.n", "y.bits")
    apart = (F.col("comp") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
    pairs = minor.join(again, (F.col("g") == F.col("h")) & apart & fits & ~F.arrays_overlap("gs", "earlier"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node -> comp, the smallest node reachable, for the nodes of edges (a, b). Labels spread and jump until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = materialize(spread.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "old"), "labels")
        changed = new.filter("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def _keys(classes: DataFrame) -> DataFrame:
    """Table keys of the classes that share one: key, node, n and weight, the number of members of the node's collections."""
    bands = classes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    # A collection that nobody shares makes no table key.
    common = bands.groupBy("place", "band").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("place").alias("p"), F.col("band").alias("g"), "k")
    shared = bands.join(common, (F.col("place") == F.col("p")) & (F.col("band") == F.col("g")))
    shared = shared.groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("place") < ROWS, F.struct("place", "band"))).alias("first"),
        F.collect_list(F.when(F.col("place") >= ROWS, F.struct("place", "band"))).alias("second"),
        F.sum("k").alias("weight"),
    )
    keys = shared.withColumn("first", F.explode("first")).withColumn("second", F.explode("second"))
    keys = materialize(keys.select(F.xxhash64("first", "second").alias("key"), "node", "n", "weight"), "keys", release=True)
    met = keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("key").alias("k"))
    return materialize(keys.join(met, F.col("key") == F.col("k"), "left_semi"), "keys", release=True)


def _star(keys: DataFrame, order: Column, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of members -> (pairs (a, b) of each key's members with its pivot, the greatest by order; keys without pivots).

    A key's row holds comp, the component of its node so far; pairs within a component are left out, as are those whose
    sizes or bitmaps rule the similarity out.
    """
    pivots = keys.groupBy("key").agg(F.max_by(F.struct("node", "n", "comp"), order).alias("y")).select(F.col("key").alias("k"), "y")
    met = keys.join(materialize(pivots, "pivots"), F.col("key") == F.col("k")).filter(F.col("node") != F.col("y.node")).drop("k")
    apart = (F.col("comp") != F.col("y.comp")) & (F.least("n", "y.n") * 100 >= F.greatest("n", "y.n") * PERCENT)
    pairs = materialize(met.filter(apart).select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct(), "met")
    left, right = sets.select(F.col("node").alias("a"), "n", "bits"), sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"))
    fitting = pairs.join(left, "a").join(right, "b").filter(_fits("n", "bits", "m", "others")).select("a", "b").distinct()
    return materialize(fitting, "pairs"), met.drop("y")


def _apart(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of keys whose members are in several components, with their comp."""
    placed = keys.drop("comp").join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("_n")
    placed = materialize(placed, "placed")
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(F.col("key").alias("k"))
    return materialize(placed.join(several, F.col("key") == F.col("k"), "left_semi"), "apart")


def near_duplicates(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row. width: words of a shingle.

    Texts with equal words (by a SHA-256 digest of all of them) are one class, represented by its smallest doc_id; only
    classes are compared. Rows that repeat a doc_id share its component. A row with a null doc_id, or without words, is
    linked with nothing: its component is its own doc_id and it is kept. Large groups never become all pairs: see the module.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = base.mapInArrow(functools.partial(_sign, width=width), "doc_id long, n_shingles long, same binary, bands array<long>, bits array<long>")
    signed = materialize(signed, "signed")
    filled = signed.filter("doc_id is not null and same is not null")
    heads = materialize(filled.groupBy("same").agg(F.min("doc_id").alias("node")), "heads")
    classed = materialize(filled.join(heads, "same").select("node", "doc_id", F.col("n_shingles").alias("n"), "bands", "bits", "same"), "classed", release=True)
    classes = classed.filter("doc_id = node").dropDuplicates(["node", "same"])
    sets = classes.select("node", "n", "bits")
    members = classed.filter("doc_id <> node").select("doc_id", "node").distinct()
    keys = _keys(classes).withColumn("comp", F.col("node"))
    # The texts of nodes that have candidates at all; every comparison reads only these.
    texts = materialize(base.withColumnRenamed("doc_id", "node").join(keys.select("node").distinct(), "node", "left_semi"), "texts", release=True)
    pairs, rest = _star(keys, F.struct("weight", -F.col("node")), sets)
    links = materialize(_confirm(pairs, texts, width), "links")
    comp = components(links)
    more, rest = _star(_apart(rest, comp), F.xxhash64("key", "node"), sets)
    more = more.join(pairs, ["a", "b"], "left_anti")
    found = materialize(_confirm(more, texts, width), "links")
    links, pairs = links.union(found), pairs.union(more)
    comp = components(links)
    rest = _apart(rest, comp).select("node", "comp").distinct().join(sets, "node")
    more = _by_prefix(materialize(rest, "rest"), texts, width).join(pairs, ["a", "b"], "left_anti")
    found = materialize(_confirm(materialize(more, "pairs"), texts, width), "links")
    comp = components(links.union(found).union(members.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))))
    out = signed.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    comp_id = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"))


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), width=2)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept: of each group the document with the smallest doc_id (all its rows, if they repeat).

    Groups are those of five-word shingles; the two words of op4 are that query's own contract. Rows with a null doc_id or a
    text without words stay. Columns of any name pass unchanged; an empty table gives an empty table.
    """
    dropped = near_duplicates(docs.select("doc_id", "text"), width=5).filter("not kept").select(F.struct("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.struct("doc_id").alias("id"))
    left = own.join(dropped, F.col("id.doc_id") == F.col("gone.doc_id"), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
