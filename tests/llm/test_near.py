"""Near-duplicates against brute force."""

import random

import pytest

from glyphmill.llm import minhash


def brute(docs, width):
    """doc_id -> smallest doc_id of its component."""
    sets = {}
    for d, t in docs:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def near_texts():
    rng = random.Random(4)
    docs = []
    for g in range(4):
        words = [f"w{rng.randrange(500)}" for _ in range(100)]
        docs.append((10 * g + 1, " ".join(words)))
        for k, edits in enumerate((1, 2, 4, 5, 9)):
            other = list(words)
            for i in range(edits):
                other[(i * 97 // edits) + 1] = f"x{rng.randrange(10**6)}"
            docs.append((10 * g + 2 + k, " ".join(other)))
    return docs + [(90, "one two three"), (91, "One two three"), (92, "one two four"), (93, "")]


def test_stage_takes_five_words(spark):
    docs = near_texts()
    assert brute(docs, 5) != brute(docs, 2)
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n long")
    got = minhash.keep_one(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == {d for d, c in brute(docs, 5).items() if d == c}


def test_query_takes_two_words(spark):
    docs = near_texts()
    got = {r["doc_id"]: r["component_id"] for r in minhash.op4(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 2)
