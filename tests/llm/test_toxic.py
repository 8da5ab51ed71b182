"""Weak supervision against a plain version, and toxic words learned from labels, by language."""

import random

import pytest

from glyphmill.llm import quality


def plain_fit(patterns, names, rounds):
    """Expectation-maximisation over (votes, label, n) in plain Python."""
    m = quality.Model(names)
    known = sum(n for _, y, n in patterns if y is not None)
    weight = max(1.0, sum(n for _, y, n in patterns if y is None) / known) if known else 1.0
    for _ in range(rounds):
        sums = {}
        for votes, y, n in patterns:
            p = {c: m.prior[c] for c in m.classes}
            for c in p:
                for r, v in zip(names, votes):
                    p[c] *= m.shares[c][r][v]
                if y is not None and (y == 1) != (c == "good"):
                    p[c] = 0.0
            for c in p:
                for r, v in zip(names, votes):
                    sums[c, r, v] = sums.get((c, r, v), 0.0) + n * (weight if y is not None else 1) * p[c] / sum(p.values())
        before = m.prior["good"]
        m.update(sums)
        if abs(m.prior["good"] - before) < 1e-5:
            break
    return m


@pytest.mark.parametrize("labelled", [True, False])
def test_fit_against_a_plain_version(spark, labelled):
    rng, names = random.Random(6), ["a", "b", "c"]
    rows = {}
    for _ in range(400):
        kind = rng.choice(["good"] * 7 + ["a", "b"])
        votes = tuple(rng.choices((-1, 0, 1), (8, 1, 1) if r == kind else (1, 2, 12))[0] for r in names)
        label = int(kind == "good") if labelled and rng.random() < 0.1 else None
        rows[votes, label] = rows.get((votes, label), 0) + 1
    want = plain_fit([(v, y, n) for (v, y), n in rows.items()], names, 8)
    df = spark.createDataFrame([(*v, y, n) for (v, y), n in rows.items()], "a int, b int, c int, label int, n long")
    got = quality.fit(df, names, 8)
    assert all(abs(got.prior[c] - want.prior[c]) < 1e-9 for c in want.classes)
    assert all(abs(got.shares[c][r][v] - want.shares[c][r][v]) < 1e-9 for c in want.classes for r in names for v in (-1, 0, 1))
    assert sum(got.shares["good"][r][1] >= got.shares[c][r][1] for c in names for r in names) == 9


def test_ties_and_odd_rows(spark):
    """A posterior of exactly one half is kept; nulls, empty texts, repeats, empty tables and odd column names have defined results."""
    names = ["a"]
    m = quality.Model(names)
    m.prior = {"good": 0.5, "a": 0.5}
    m.shares = {c: {"a": {-1: 0.25, 0: 0.5, 1: 0.25}} for c in m.classes}
    assert m.scored(spark.createDataFrame([(1,)], "a int")).first()["posterior"] == quality.POSTERIOR
    text = " ".join(f"word{i} of many" for i in range(20))
    docs = [(1, text, "x", 1), (1, text, "x", 1), (2, None, None, 2), (3, "", "y", None), (None, text, "z", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row string, kept int")
    got = quality.keep_good(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([docs[0], docs[1], docs[4]], key=str)
    assert quality.keep_good(df.limit(0)).count() == 0


def test_learned_by_language(spark):
    def text(i, bad):
        plain = " ".join(f"mot{(i * 7 + j) % 61}" for j in range(60))
        return plain + (" vilain affreux, méchant." if bad else " calme")

    docs = [(i, text(i, i % 4 == 0), "fr") for i in range(80)] + [(100, text(3, True), "de"), (101, text(5, True), None), (102, text(9, False), "fr")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(61, 1, None)], "doc_id long, quality int, toxic int")
    words = quality.toxic_words(d, labels)
    assert set(words) == {"fr"} and set(words["fr"]) == {"vilain", "affreux", "méchant"}
    voted = {r["doc_id"]: r["abuse"] for r in quality.measure(d, words).select("doc_id", quality.votes()["abuse"].alias("abuse")).collect()}
    # 60 to 79 have no label; other languages have no evidence.
    assert all(voted[i] == (-1 if i % 4 == 0 else 1) for i in range(80)) and (voted[100], voted[101], voted[102]) == (0, 0, 1)
    kept = {r["doc_id"] for r in quality.op3(d, labels).collect() if r["kept"]}
    assert kept == {i for i in range(80) if i % 4} | {100, 101, 102}
    assert quality.keep_good(d, labels).columns == d.columns
    assert quality.toxic_words(d, None) == {} and quality.toxic_words(d, labels.filter("toxic = 0")) == {}
