"""Wavelet matrices against plain arrays, and files against the tokenizer's own ids."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from glyphmill.llm import wavelet


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path(wavelet.TOKENIZER), encoding="utf-8") as f:
        return f.read()


def texts():
    rng = random.Random(3)
    words = ["the", "Été,", "x1", "don't", "a--b", "naïve.", "日本語", "9,000", "tab\tbed", "end.\nNew", "<|endoftext|>", " ", "ß　"]
    docs = [(i * 3 % 101, rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", " \n"]).join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(101)]
    return docs + [(200, None), (201, ""), (202, " "), (203, "word" * 50000), (204, "many words " * 20000), (None, "last one"), (7, "second seven"), (7, "second seven")]


@pytest.mark.parametrize("n, high", [(0, 5), (1, 1), (511, 9), (512, 65535), (5000, 300), (70000, 40)])
def test_matrix(n, high):
    ids = np.random.default_rng(n).integers(0, high + 1, n).astype(np.uint16)
    m = wavelet.Matrix.build(ids, 16)
    assert (m.decode() == ids).all()
    at = np.arange(0, n, 7)
    assert (m.access(at) == ids[at]).all()
    for token in {0, high, high // 2, 65535}:
        assert m.places(token).tolist() == np.flatnonzero(ids == token).tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert m.count(token, a, b) == (ids[a:b] == token).sum()
    assert m.count(1 << 16) == m.count(-1) == 0


def test_ids_are_the_library_s(definition):
    encoder = wavelet.Encoder(definition)
    plain = [t or "" for _, t in texts()]
    ids, ends = encoder.encode(pa.array(plain), 2)
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(plain, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
    again, _ = encoder.encode(pa.array(plain[::-1]), 2)
    assert again.tolist() == [i for x in want[::-1] for i in x]
    assert len(encoder.encode(pa.array([], pa.string()), 2)[0]) == 0


def plain_ids(definition):
    """(doc_id, ids) in the order of the files."""
    encoder = wavelet.Encoder(definition).tokenizer
    docs = sorted(texts(), key=lambda d: (d[0] is None, d[0] or 0))
    return [(d, encoder.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs]


def test_round_trip_and_lookups(spark, definition):
    df = spark.createDataFrame([(*d, "x") for d in texts()], "doc_id long, text string, ids string").repartition(3)
    store = wavelet.write(df, definition, shard_tokens=1500, portion=500)
    assert store.shards.count() > 5 and len(store.shards.inputFiles()) == store.shards.count()
    rows = [(r["start"], r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in wavelet.documents(store).collect()]
    rows.sort(key=lambda r: r[0])
    sevens = lambda xs: sorted((str(x[0]), x[1]) for x in xs)
    want = plain_ids(definition)
    assert sevens([(r[1], r[3]) for r in rows]) == sevens(want) and [r[1] for r in rows] == [d for d, _ in want]
    assert [r[0] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
    flat = [i for r in rows for i in r[3]]
    owner = [r[1] for r in rows for _ in r[3]]
    tokens = [flat[0], 2, 49999]
    assert {r["token"]: r["n"] for r in wavelet.counts(store, tokens).collect()} == {t: flat.count(t) for t in tokens}
    places = sorted((r["token"], r["position"], str(r["doc_id"])) for r in wavelet.occurrences(store, tokens).collect())
    assert places == sorted((t, p, str(owner[p])) for t in set(tokens) for p, x in enumerate(flat) if x == t)
    asked = [0, 5, 1499, 1500, len(flat) - 1, len(flat)]
    assert sorted(tuple(r) for r in wavelet.tokens_at(store, asked).collect()) == [(p, flat[p]) for p in asked[:-1]]


def test_query(spark, definition):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    want, start = [], 0
    for d, ids in plain_ids(definition):
        want.append((d, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = wavelet.op12(df).orderBy("start").collect()
    same = lambda rows: [tuple(r) for r in rows if r[0] != 7]
    assert same(got) == same(want) and len(got) == len(want)
    assert wavelet.op12(df.limit(0)).count() == 0
