"""Token ids as wavelet matrices, one compressed file for each shard.

A shard holds the ids of consecutive documents as bit planes, highest bit first; in each plane the ids stand in the order
that a stable partition by all higher bits gives. With the ones before every 512th bit kept beside a plane, any id can be
read, and any token counted and its places listed, without decoding the shard.
"""

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32
from array import array
from itertools import islice
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.storage import scratch_root

TOKENIZER = "byte_bpe_50k.json"
#: Id that ends each document.
END = 2
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 22
#: Pieces of text that a Python worker remembers with their ids, and bytes of text encoded at a time.
REMEMBERED, PORTION = 1 << 20, 1 << 24
#: Bits between two entries of a plane's rank directory.
STEP = 512
FILE = "part int, shard int, before long, n_tokens long, docs array<long>, ends array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
#: A white space before a space: the space is not where a piece may begin.
_RUN = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: A Latin word and ASCII punctuation without apostrophe: two pre-tokens; perhaps another such pair on the next line.
_PAIR = r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)"
_WORD = re.compile(f"{_PAIR}(?:\n{_PAIR})?")


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library; strings of special tokens are ordinary text.

    Its pre-tokenizer never joins what stands on both sides of a space that follows other than white space, so texts are
    cut there and each different piece is encoded once: Latin words by the library's model, others by all of the library.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.width, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        # How the library writes each byte of Latin text, read off it.
        latin = [chr(c) for c in range(0x250)]
        self.written = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in latin}
        self.table = str.maketrans(self.written)
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, pretoken: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(pretoken.translate(self.table))]).tobytes()

    def _plain(self, pretoken: str) -> bytes:
        """Ids of a pre-token without a space before it."""
        if (ids := self.bare.get(pretoken)) is None:
            ids = self.bare[pretoken] = self._model(pretoken)
        return ids

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces; each of them stands after a space."""
        rest, known, space = [], self.known, self.written[" "]
        line = self._plain("\n")
        for p in pieces:
            if not (m := _WORD.fullmatch(p)):
                rest.append(p)
                continue
            word, mark, below, end = m.groups()
            if (ids := known.get(word)) is None:
                written = word if word.isascii() else word.translate(self.table)
                ids = known[word] = array(self.code, [t.id for t in self.model.tokenize(space + written)]).tobytes()
            if below:
                known[p] = ids + self._plain(mark) + line + self._plain(below) + self._plain(end)
            elif mark:
                known[p] = ids + self._plain(mark)
        known.update(zip(rest, self._library([" " + p for p in rest])))

    def _heads(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin a text."""
        other = {p for p in pieces if not (m := _WORD.fullmatch(p)) or m[3]}
        found = dict(zip(other, self._library(list(other))))
        return [found[p] if p in found else b"".join(map(self._plain, _WORD.fullmatch(p).groups()[:2])) for p in pieces]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, with end after each, and where each text ends."""
        if not len(texts):
            return np.zeros(0, self.width), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        if pc.any(pc.match_substring_regex(texts, _RUN)).as_py():
            cut = pa.array([_merged(c) for c in cut.to_pylist()], pa.list_(pa.string()))
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        heads = self._heads(cut.flatten().take(pa.array(first)).to_pylist())
        codes = cut.flatten().dictionary_encode()
        pieces = codes.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:  # the half learned first goes
            self.known = dict(islice(self.known.items(), REMEMBERED // 2, None))
        if len(self.bare) > REMEMBERED // 4:
            self.bare = {"": b""}
        self._learn([p for p in pieces if p not in self.known])
        table = [*map(self.known.__getitem__, pieces), *heads, np.array([end], self.width).tobytes()]
        step = np.dtype(self.width).itemsize
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // step
        begins = np.cumsum(sizes) - sizes
        code = codes.indices.to_numpy().astype(np.int64)
        code[first] = len(pieces) + np.arange(len(first))
        last = np.append(first[1:], len(code))
        code = np.insert(code, last, len(table) - 1)
        n = sizes[code]
        stop = np.cumsum(n)
        at = np.repeat(begins[code] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)
        return np.frombuffer(b"".join(table), self.width)[at], stop[last + np.arange(len(last))]


def _merged(pieces: list[str]) -> list[str]:
    """Pieces whose predecessor is empty or ends in white space are put back to it."""
    merged = pieces[:1]
    for p in pieces[1:]:
        if not merged[-1] or merged[-1][-1].isspace():
            merged[-1] += " " + p
        else:
            merged.append(p)
    return merged


class Matrix:
    """A wavelet matrix over the ids of one shard."""

    def __init__(self, n: int, zeros, planes, ranks):
        self.n, self.zeros = n, [int(z) for z in zeros]
        self.planes = [np.frombuffer(p, np.uint64) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32).astype(np.int64) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> "Matrix":
        zeros, planes, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << level)) != 0
            padded = np.zeros(-(-max(1, len(bits)) // STEP) * STEP, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            planes.append(words.tobytes())
            ones = np.bitwise_count(words).reshape(-1, STEP // 64).sum(1)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32).tobytes())
            zero, one = np.flatnonzero(~bits), np.flatnonzero(bits)
            ids = np.concatenate([ids.take(zero), ids.take(one)])
            zeros.append(len(zero))
        return cls(len(ids), zeros, planes, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each stable partition is undone."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits, above = self._bits(level), np.empty_like(out)
            out[self.zeros[level] :] |= out.dtype.type(1 << (len(self.planes) - 1 - level))
            above[np.flatnonzero(~bits)] = out[: self.zeros[level]]
            above[np.flatnonzero(bits)] = out[self.zeros[level] :]
            out = above
        return out

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each of the places at."""
        words, block = self.planes[level], at // STEP
        inside = block[:, None] * (STEP // 64) + np.arange(STEP // 64)
        left = np.clip(at[:, None] - inside * 64, 0, 64)
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
        taken = words[np.minimum(inside, len(words) - 1)] & mask
        return self.ranks[level][block] + np.bitwise_count(np.where(left > 0, taken, np.uint64(0))).sum(1, dtype=np.int64)

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks)) * STEP - ranks
        block = np.searchsorted(before, k, "right") - 1
        words = self.planes[level].reshape(-1, STEP // 64)[block]
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little").reshape(-1, STEP) == bit
        return block * STEP + (np.cumsum(bits, 1) > (k - before[block])[:, None]).argmax(1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level, words in enumerate(self.planes):
            bit = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            ones = self.rank(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def range(self, token: int, begin: int = 0, end: int | None = None) -> tuple[int, int]:
        """Where the occurrences of a token in [begin, end) stand below the last plane."""
        a = np.array([begin, self.n if end is None else end], np.int64)
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            ones = self.rank(level, a)
            a = self.zeros[level] + ones if token >> (len(self.planes) - 1 - level) & 1 else a - ones
        return int(a[0]), int(a[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self.range(token, begin, end)
        return b - a

    def places(self, token: int) -> np.ndarray:
        """Places of a token in ascending order: up from the last plane by select."""
        a, b = self.range(token)
        at = np.arange(a, b)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at


class Store(NamedTuple):
    """Shards as written (FILE), and the tokens before each range of documents (part)."""

    shards: DataFrame
    starts: dict[int, int]


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One for each Python worker."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def _portions(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts, about portion bytes at a time; one text at least."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
        docs = batch.column("doc_id").to_pylist()
        size = np.cumsum(pc.binary_length(texts).to_numpy()) if len(docs) else []
        a = 0
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + portion)))
            yield docs[a:b], texts[a:b]
            a = b


def _shards(definition, levels: int, shard_tokens: int, portion: int):
    """definition: broadcast JSON of a tokenizer. Sorted texts in, shards out."""

    def row(shard: int, before: int, docs: list, ids: list[np.ndarray], ends: list[np.ndarray]) -> pa.RecordBatch:
        m = Matrix.build(np.concatenate(ids), levels)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.binary())] * 2]
        values = [TaskContext.get().partitionId(), shard, before, m.n, docs, np.concatenate(ends), m.zeros, [p.tobytes() for p in m.planes], [r.astype(np.uint32).tobytes() for r in m.ranks]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in FILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        shard, before, docs, ids, ends, size = 0, 0, [], [], [], 0
        for some, texts in _portions(batches, portion):
            found, stops = encoder.encode(texts, END)
            docs += some
            ids.append(found)
            ends.append(stops + size)
            size += len(found)
            if size >= shard_tokens:
                yield row(shard, before, docs, ids, ends)
                shard, before, docs, ids, ends, size = shard + 1, before + size, [], [], [], 0
        if docs:
            yield row(shard, before, docs, ids, ends)

    return run


def write(docs: DataFrame, definition: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS, portion: int = PORTION) -> Store:
    """Encode docs (doc_id, text) and write them in ascending doc_id order, null last, as one Parquet file a shard.

    definition: JSON of the tokenizer, broadcast; its size doesn't grow with the data. path: a folder that Spark can write, by
    default a new one in the shared folder. A null or empty text is its end id alone; equal doc_ids stand in a fixed order
    of their texts. One shuffle, of the texts, by ranges of doc_id; a task holds one shard at a time.
    """
    spark = docs.sparkSession
    vocabulary = Encoder(definition).tokenizer.get_vocab_size()
    levels = max(vocabulary - 1, END).bit_length()
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    path = path or f"{scratch_root(spark)}/glyphmill/shards-{uuid.uuid4().hex}"
    shards = dealt.mapInArrow(_shards(spark.sparkContext.broadcast(definition), levels, shard_tokens, portion), FILE)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> Store:
    """A store written before. The driver gets one sum for each range of documents."""
    shards = spark.read.schema(FILE).parquet(path)
    starts, before = {}, 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part] = before
        before += n
    return Store(shards, starts)


def _each(store: Store, schema: str, f) -> DataFrame:
    """The columns that f(matrix, start, docs, ends) gives for every shard."""
    starts = store.starts
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = Matrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"])
                columns = f(m, starts[r["part"]] + r["before"], r["docs"], r["ends"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return store.shards.mapInArrow(run, schema)


def documents(store: Store) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids (little-endian unsigned 32-bit) read back from the files."""

    def rows(m: Matrix, start: int, docs: list, ends: list):
        ids, begins = m.decode().astype("<u4"), [0, *ends]
        return docs, [start + b for b in begins[:-1]], [b - a for a, b in zip(begins, ends)], [ids[a:b].tobytes() for a, b in zip(begins, ends)]

    return _each(store, "doc_id long, start long, n_tokens long, ids binary", rows)


def counts(store: Store, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the given tokens stands in the store; 16 steps of rank a shard, nothing is decoded."""
    some = _each(store, "token long, n long", lambda m, *_: (tokens, [m.count(t) for t in tokens]))
    return some.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(store: Store, tokens: list[int]) -> DataFrame:
    """token, position, doc_id of every occurrence of the given tokens."""

    def rows(m: Matrix, start: int, docs: list, ends: list):
        found = [(t, p) for t in tokens for p in m.places(t).tolist()]
        owner = np.searchsorted(ends, [p for _, p in found], "right")
        return [t for t, _ in found], [start + p for _, p in found], [docs[i] for i in owner]

    return _each(store, "token long, position long, doc_id long", rows)


def tokens_at(store: Store, positions: list[int]) -> DataFrame:
    """position, token for the given positions; those past the end give no row."""
    wanted = np.array(sorted(set(positions)), np.int64)

    def rows(m: Matrix, start: int, *_):
        own = wanted[(wanted >= start) & (wanted < start + m.n)]
        return own.tolist(), m.access(own - start).tolist()

    return _each(store, "position long, token long", rows)


def op12(docs: DataFrame, definition: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written."""
    if definition is None:
        import public_tokenizers

        with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            definition = f.read()
    store = write(docs, definition)

    def rows(m: Matrix, start: int, docs: list, ends: list):
        ids, begins = m.decode().astype("<u4"), [0, *ends]
        return docs, [start + b for b in begins[:-1]], [b - a for a, b in zip(begins, ends)], [crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]

    return _each(store, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)
