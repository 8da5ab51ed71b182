"""Ranked search against plain scoring."""

import math
import random
import re

from glyphmill.llm import ranked


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) by the stated formulas, one document at a time."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words = [(d, terms(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    pooled = {}
    for i, t in items:
        pooled.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in pooled.items():
        scores = []
        for d, w in words:
            m = 100 - 50 + 50 * len(w) * n_docs // n_terms
            score = 0
            for t in wanted & set(w):
                df, tf = sum(t in x for _, x in words), w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            scores.append((-score, d is None, d or 0, d))
        best = sorted(x for x in scores if x[0] < 0)[:k]
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(best, 1)]
    return out


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "Été", "x1", "naïve", *[f"w{i}" for i in range(40)]]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) + rng.choice(["", ".", "-The"])) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "?! .."), (73, "w1 " * 20000), (None, "w2 w3 rare"), (74, "tie tie"), (75, "tie tie"), (74, "tie tie")]
    items = [("a", "The w1 w2 w1"), ("b", "unseen"), ("c", None), ("d", "tie W3 rare ÉTÉ Été"), ("d", "w4"), (None, "w5"), ("e", "")]
    return docs, items


def key(r):
    return (str(r[0]), r[1])


def test_search_is_the_plain_ranking(spark):
    docs, items = texts()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int").repartition(3)
    found = ranked.index(df, shard_postings=100)
    assert found.n_shards > 3 and found.n_docs == 65
    asked = spark.createDataFrame(items, "item_id string, text string")
    for k in (50, 3):
        got = [tuple(r) for r in ranked.search(found, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items, k), key=key)


def test_without_broadcast(spark, monkeypatch):
    docs, items = texts()
    monkeypatch.setattr(ranked, "BROADCAST_ROWS", 0)
    got = ranked.op11(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ranked.op11(none, items).count() == 0
    docs = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert ranked.op11(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.op11(docs, items).select("rank", "doc_id", "score").collect()] == [(r, d, s) for _, r, d, s in brute([(1, "w1")], [("a", "w1")])]


def test_postings_of_a_frequent_term_are_spread(spark):
    df = spark.createDataFrame([(i, f"the a{i} b{i} c{i}") for i in range(400)], "doc_id long, text string").repartition(2)
    rows = ranked.index(df, shard_postings=200).postings.filter("term = 'the'").selectExpr("size(rows) n").collect()
    assert sum(r["n"] for r in rows) == 400 and max(r["n"] for r in rows) <= 50
