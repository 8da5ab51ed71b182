"""Language model: a hidden Markov model over word classes, with exact likelihoods.

A token has a class: one of its own if it is among the most frequent, else one from its ending. The model's probability of a
token is that of its class in the state times that of the token in its class, both learned from all training texts.
Baum-Welch counts are summed over partitions; a score is the scaled forward recursion over the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

STATES = 6
#: Tokens that tasks hold in memory, at most; those of them with a class of their own; classes by ending.
HEAD, OWN, ENDINGS = 100_000, 6000, 2048
ROUNDS = 6
#: Positions of a block at most; what lies before the last block may be computed again.
SPAN = 1024
#: Texts of a batch are joined until they have so many tokens; tokens of a block; tokens whose forward values are all held.
TOKENS, BLOCK, HELD = 2_000_000, 65_536, 3_000_000
FOLDS, HELD_OUT = 5, 1
END = b""
_TRAIL = b".,;:!?#*$%&|\"')"


class Head(NamedTuple):
    """What tasks know of the vocabulary: counts of frequent tokens and their classes."""

    counts: dict[bytes, int]
    classes: dict[bytes, int]


def class_of(token: bytes, own: dict[bytes, int]) -> int:
    c = own.get(token)
    if c is not None:
        return c
    core = token.rstrip(_TRAIL)
    digit = any(48 <= x < 58 for x in core[:8])
    return OWN + xxhash.xxh32_intdigest(core[-4:] + b"\0" + token[len(core) : len(core) + 1] + (b"9" if digit else b"")) % ENDINGS


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text"):
            counts.update(tokens_of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])


def vocabulary(train: DataFrame) -> DataFrame:
    """token, c over all training texts; the end of a text is the empty token."""
    return materialize(train.select("text").mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "vocabulary")


def head_of(vocab: DataFrame) -> Head:
    """The most frequent tokens, HEAD at most: those above the smallest bound of counts that so few reach."""
    bucket = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 1024 - 640).cast("long")
    levels = sorted((r[0], r[1]) for r in vocab.groupBy(bucket.alias("b")).count().collect())
    total, least = 0, None
    for b, n in reversed(levels):
        total += n
        if total > HEAD:
            break
        least = b
    if least is None:
        return Head({}, {})
    rows = sorted(((r["c"], bytes(r["token"])) for r in vocab.filter(bucket >= least).collect()), key=lambda x: (-x[0], x[1]))
    return Head({t: c for c, t in rows}, {t: i for i, (_, t) in enumerate(rows[:OWN])})


def _class_rows(own: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([class_of(t, own) for t in batch.column("token").to_pylist()], pa.int32()), batch.column("c")], names=["cls", "c"])

    return run


class _Places(dict):
    """token -> its place: that of a frequent token among them, else their number plus the token's class."""

    def __init__(self, head: Head):
        super().__init__((t, i) for i, t in enumerate(head.counts))
        self.own, self.frequent = head.classes, len(head.counts)

    def __missing__(self, token: bytes) -> int:
        place = self.frequent + class_of(token, self.own)
        if len(self) < self.frequent + 400_000:
            self[token] = place
        return place


def _encode(shared):
    """Rows of texts -> classes of their tokens, and sums over frequent tokens; the others go to rare, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(*shared.value)
        places, frequent = _Places(head), len(head.counts)
        codes_at = np.concatenate((np.fromiter((class_of(t, head.classes) for t in head.counts), np.uint16, frequent), np.arange(OWN + ENDINGS, dtype=np.uint16)))
        value_at = np.concatenate((np.log10(np.fromiter(head.counts.values(), np.float64, frequent) + 0.5), np.zeros(OWN + ENDINGS)))
        for batch in batches:
            codes, sums, n, n_known, rare, rare_n = [], [], [], [], [], []
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py())
                at = np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens))
                seldom = np.flatnonzero(at >= frequent)
                met = Counter([tokens[i] for i in seldom.tolist()])
                codes.append(codes_at[at].tobytes())
                sums.append(float(value_at[at].sum()))
                n.append(len(tokens))
                n_known.append(len(tokens) - len(seldom))
                rare.append(list(met))
                rare_n.append(list(met.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "codes", "rare", "rare_n"],
            )

    return run


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states
    within: np.ndarray  # log10 of the denominators of tokens in their classes


def first_model(by_class: np.ndarray, within: np.ndarray) -> Model:
    """Sticky states whose emissions are the corpus' with seeded noise."""
    rng = np.random.Generator(np.random.PCG64(7))
    emit = (by_class + 0.5)[:, None] * rng.gamma(2.0, 0.5, (len(by_class), STATES))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0), within)


def _by_place(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by position (those of all texts, the longest first, at the first, at the second, ...), how many texts are so long, and where each position begins."""
    lengths = np.array([len(c) for c in texts])
    active = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begin = np.cumsum(active) - active
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.empty(len(place), np.uint16)
    flat[begin[place] + np.repeat(np.arange(len(texts)), lengths)] = np.concatenate(texts)
    return flat, active, np.append(begin, len(flat))


def _blocks(begin: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of positions with about BLOCK tokens each: one position at least, SPAN at most."""
    cuts, last = [0], len(begin) - 1
    while cuts[-1] < last:
        full = int(np.searchsorted(begin, begin[cuts[-1]] + BLOCK, side="right")) - 1
        cuts.append(min(max(cuts[-1] + 1, full), cuts[-1] + SPAN, last))
    return list(zip(cuts, cuts[1:]))


def _ahead(model: Model, seen: np.ndarray, active: list[int], a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values (states x tokens) of a block of positions and their scales, from the values before it."""
    out, scales = np.empty_like(seen), np.empty(seen.shape[1])
    back, to = model.move.T, 0
    for n in active:
        here = slice(to, to + n)
        now, scale = out[:, here], scales[here]
        if a is None:
            np.multiply(model.start[:, None], seen[:, here], out=now)
        else:
            np.matmul(back, a[:, :n], out=now)
            now *= seen[:, here]
        np.add.reduce(now, 0, out=scale)
        now /= scale
        a, to = now, to + n
    return out, scales


def expect(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of whole texts: rows of classes, then of moves from each state, then of starts.

    All texts move in step, the longest first, by blocks of positions; a row of an array is a state. Forward values are held
    for all blocks if the texts have HELD tokens at most, else the last of each block is held and the block computed again
    on the way back, so memory doesn't grow with the texts.
    """
    size = len(model.emit)
    counts = np.zeros((size + STATES + 1, STATES))
    texts = sorted((c for c in codes if len(c)), key=len, reverse=True)
    if not texts:
        return counts
    flat, active, begin = _by_place(texts)
    emit, blocks, hold = np.ascontiguousarray(model.emit.T), _blocks(begin), len(flat) <= HELD
    many = active.tolist()
    seen_in = lambda first, last: np.take(emit, flat[begin[first] : begin[last]], axis=1)
    held, marks, a = [], [None], None
    for first, last in blocks:
        if not hold and last == len(many):
            break
        alphas, scales = _ahead(model, seen_in(first, last), many[first:last], a)
        a = alphas[:, len(alphas[0]) - many[last - 1] :]
        if hold:
            held.append((alphas, scales))
        else:
            a = a[:, : many[last]].copy()
        marks.append(a)
    back, moves = np.ones((STATES, len(texts))), np.zeros((STATES, STATES))
    for i in range(len(blocks) - 1, -1, -1):
        first, last = blocks[i]
        before, seen = marks[i], seen_in(first, last)
        alphas, scales = held.pop() if hold else _ahead(model, seen, many[first:last], before)
        to = seen.shape[1]
        for t in range(last - 1, first - 1, -1):
            # Texts that end here begin their way back with ones. The values are replaced by those of both ways as soon as they have been read.
            n = many[t]
            here, beta = slice(to - n, to), back[:, :n]
            to -= n
            alphas[:, here] *= beta
            if t:
                ahead = seen[:, here]
                ahead *= beta
                ahead /= scales[here]
                previous = alphas[:, to - many[t - 1] : to - many[t - 1] + n] if t > first else before[:, :n]
                moves += previous @ ahead.T
                np.matmul(model.move, ahead, out=beta)
        which = flat[begin[first] : begin[last]].astype(np.intp)
        for k in range(STATES):
            counts[:size, k] += np.bincount(which, alphas[k], size)
        if not first:
            counts[-1] += alphas[:, : many[0]].sum(1)
    counts[size:-1] += model.move * moves
    return counts


def _groups(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Classes of a batch's texts, so many at once that they have about TOKENS."""
    held, size = [], 0
    for x in column:
        held.append(np.frombuffer(x.as_py(), np.uint16))
        size += len(held[-1])
        if size >= TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expect_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        for batch in batches:
            for held in _groups(batch.column("codes")):
                total = expect(model, held) + (0 if total is None else total)
        if total is not None:
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, k]) for k in range(STATES)]], names=["at", *[f"s{k}" for k in range(STATES)]])

    return run


def train(encoded: DataFrame, by_class: np.ndarray, within: np.ndarray) -> Model:
    """ROUNDS of Baum-Welch over all training texts. What a round sends to the driver is one row for each class, whatever the input."""
    spark = encoded.sparkSession
    model = first_model(by_class, within)
    shares = (by_class + 0.5) / (by_class + 0.5).sum()
    schema = ", ".join(["at int", *[f"s{k} double" for k in range(STATES)]])
    for _ in range(ROUNDS):
        rows = encoded.filter("not held_out").select("codes").mapInArrow(_expect_rows(spark.sparkContext.broadcast(model)), schema)
        counts = np.zeros((len(by_class) + STATES + 1, STATES))
        for r in rows.groupBy("at").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).collect():
            counts[r[0]] = r[1:]
        emit = counts[: len(by_class)] + 20.0 * shares[:, None]
        move = counts[len(by_class) : -1] + 1.0
        start = counts[-1] + 1.0
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), within)
    return model


def forward(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of classes, by the scaled forward recursion over its whole length."""
    order = [i for i in sorted(range(len(codes)), key=lambda i: -len(codes[i])) if len(codes[i])]
    out, a = np.zeros(len(codes)), None
    if not order:
        return out
    flat, active, begin = _by_place([codes[i] for i in order])
    emit, many, sums = np.ascontiguousarray(model.emit.T), active.tolist(), np.zeros(len(order))
    for first, last in _blocks(begin):
        alphas, scales = _ahead(model, np.take(emit, flat[begin[first] : begin[last]], axis=1), many[first:last], a)
        a, to = alphas[:, len(scales) - many[last - 1] :], 0
        logs = np.log10(scales)
        for n in many[first:last]:
            sums[:n] += logs[to : to + n]
            to += n
    out[order] = sums
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            likely = np.concatenate([np.zeros(0), *[forward(model, codes) - np.array([model.within[c].sum() for c in codes]) for codes in _groups(batch.column("codes"))]])
            keep = ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_sum"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(likely, pa.float64())], names=[*keep, "likely"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    Null and empty texts are one end token. A null doc_id isn't held out. Repeated rows each count in training. Without
    training texts every token is unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    vocab = vocabulary(base.filter("not held_out"))
    size = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = head_of(vocab)
    by_class, kinds = np.zeros(OWN + ENDINGS), np.zeros(OWN + ENDINGS)
    for cls, c, n in vocab.mapInArrow(_class_rows(head.classes), "cls int, c long").groupBy("cls").agg(F.sum("c"), F.count("*")).collect():
        by_class[cls], kinds[cls] = c, n
    within = np.log10(by_class + 0.5 * (kinds + 1))
    encoded = base.mapInArrow(_encode(spark.sparkContext.broadcast(tuple(head))), "doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, codes binary, rare array<binary>, rare_n array<int>")
    encoded = materialize(encoded.withColumn("rid", F.monotonically_increasing_id()), "encoded")
    model = train(encoded, by_class, within)
    scored = encoded.select("rid", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "codes").mapInArrow(
        _score(spark.sparkContext.broadcast(model)), "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, likely double"
    )
    # Rare tokens meet their counts in a join; frequent ones are summed already.
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("rid", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("n"))
    met = rare.join(vocab, "token", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    total = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(met, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(size[0])).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * float(np.log10(size[0] + 0.5 * (size[1] + 1)))).alias("base_score"),
        (total + F.col("likely")).alias("score"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
