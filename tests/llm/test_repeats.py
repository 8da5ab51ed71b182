"""Substring and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from glyphmill.llm import runs, substrings, suffixes

LAST = (1 << 63) - 1


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "the", "ofthe", "é", "läng", "x9", "tion", "in"]

    def some(n):
        return rng.choices(words, k=n)

    shared = some(70)
    docs = []
    for i in range(40):
        kind = i % 5
        if kind == 0:
            t = some(rng.randint(0, 120))
        elif kind == 1:
            t = some(rng.randint(1, 20)) + shared + some(rng.randint(0, 30))
        elif kind == 2:
            t = shared[rng.randint(0, 15) :] + some(5)
        elif kind == 3:
            t = (shared[:7] * 20)[: rng.randint(60, 140)]
        else:
            t = some(3) + shared[:51] + some(3)
        docs.append((i if i % 7 else None if i == 7 else i, rng.choice([" ", "\n", "  "]).join(t)))
    return docs + [(3, docs[3][1]), (4, docs[1][1]), (50, None), (51, ""), (None, docs[2][1]), (52, "a" * 700), (53, "ab" * 300)]


def key(d):
    return LAST if d is None else d


def brute_words(docs, k):
    first = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, LAST + 1), key(d))
    out = []
    for d, t in docs:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < key(d):
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(docs, k):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            g = b[i : i + k]
            first[g] = min(first.get(g, (LAST + 1, 0)), (key(d), i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < (key(d), i):
                gone[i : i + k] = [True] * k
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [400, 1])
def test_words(spark, monkeypatch, together):
    monkeypatch.setattr(runs, "TOGETHER", together)
    docs = texts(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, substrings.op6(df).collect()), key=str)
    assert got == sorted(brute_words(docs, 50), key=str)


@pytest.mark.parametrize("together", [400, 1])
def test_bytes(spark, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    docs = texts(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffixes.op10(df).collect()), key=str)
    assert got == sorted(brute_bytes(docs, 100), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_classes_of_equal_strings(seed):
    """The two orders around a trigger give the repeats that a lookup of all strings gives."""
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    texts_ = []
    for _ in range(30):
        a = rng.randrange(200)
        t = bytearray(base[a : a + rng.randint(100, 200)])
        if rng.random() < 0.7:
            t[rng.randrange(len(t))] = rng.choice(b"abc")
        texts_.append(bytes(t))
    entries = {}
    for r in runs.find(texts_, suffixes.SPEC):
        for row, start, n, h, at, a, b in zip(r.row, r.start, r.count, r.h, r.place, r.at, r.to):
            entries.setdefault(r.data[a:b], (int(h), int(row), int(start), int(at), int(n)))
    packed = list(entries)
    h, row, start, at, n = (np.array(x) for x in zip(*entries.values()))
    places = sorted({(x, s + y) for x, s, y in zip(row, start, at)})
    rank = np.array([places.index((x, s + y)) for x, s, y in zip(row, start, at)])
    which, where = suffixes.repeats(h, rank, at, n, np.zeros(len(h), int), np.full(len(h), suffixes.FAR), packed)
    first = {}
    for i, t in enumerate(packed):
        for j in range(n[i]):
            p = (row[i], start[i] + j)
            first[t[j : j + 100]] = min(first.get(t[j : j + 100], p), p)
    want = [(i, j) for i, t in enumerate(packed) for j in range(n[i]) if first[t[j : j + 100]] < (row[i], start[i] + j)]
    assert want and list(zip(which.tolist(), where.tolist())) == want


def test_pieces(monkeypatch):
    """Texts longer than a group lose no window."""
    monkeypatch.setattr(runs, "GROUP", 64)
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc") for _ in range(1000))
    spec = runs.Spec("bytes", 20, 8, True)
    got = []
    for r in runs.find([text, b"", None, text[:19]], spec):
        for start, n, a, b in zip(r.start, r.count, r.at, r.to):
            assert runs.windows(r.data[a:b], spec) == [text[i : i + 20] for i in range(start, start + n)]
            got += range(start, start + n)
    assert got == list(range(len(text) - 19))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.op6(df).count() == 0 and suffixes.op10(df).count() == 0
