"""Importance resampling against a plain count of all features."""

from collections import Counter
import hashlib
import math
import random
import re
from zlib import crc32

from glyphmill.llm import resampling


def brute(docs, target):
    def buckets(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return len(w), Counter(crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    own, other = [(d, *buckets(t)) for d, t in docs], Counter()
    for t in target:
        other += buckets(t)[1]
    s = sum((c for *_, c in own), Counter())
    s_all, t_all = sum(s.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    rows = []
    for d, n, c in own:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts():
    rng = random.Random(8)
    vocabulary = ["The", "été", "x1", *[f"w{i}" for i in range(200)]]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, ".. !"), (203, "w1"), (204, "w1 w2"), (None, "w1 " * 30), (205, "w1 w2 " * 30000)]
    return docs, [" ".join(rng.choices(vocabulary[:60], k=40)) for _ in range(20)] + [None, ""]


def test_resampling_is_the_plain_draw(spark):
    docs, target = texts()
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, weight int").repartition(3)
    want = brute(docs, target)
    assert sum(r[4] is not None for r in want) > 2
    target = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resampling.op13(df, target)) == want
    assert got(resampling.resample(df.select("doc_id", "text"), target, block_features=1000)) == want


def test_repeated_rows_and_ties(spark):
    docs = [(1, "a b c " * 10), (1, "a b c " * 10), (1, "a b " * 15), (2, "x")] + [(None, "q " * 25)] * 60
    df, target = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    rows = got(resampling.op13(df, target))
    assert rows == brute(docs, ["a b"]) and [r[4] for r in rows].count(None) == 61


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert got(resampling.op13(none, one)) == []
    assert got(resampling.op13(one, none)) == brute([(1, "a b")], [])
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(resampling.op13(blank, none)) == brute([(1, None), (2, "")], [])


def test_one_bucket_with_all_postings_is_dealt_out(spark):
    df = spark.createDataFrame([(i, "same") for i in range(2000)], "doc_id long, text string").repartition(1)
    rows = df.selectExpr("false target", "doc_id", "0L hash", "text").mapInArrow(resampling._invert(50), resampling.PACKED).filter(f"kind = {resampling.POSTINGS}").groupBy("key").count().collect()
    assert len(rows) == resampling.SLICES and max(r["count"] for r in rows) == 5
