"""Line dedup against a plain finder of repeated runs of lines."""

import random
import zlib

from glyphmill.llm import lines

LAST = (1 << 63) - 1


def runs_of_lines(docs):
    """doc_id -> numbers of the lines in a run of two lines with words or more that stands earlier; docs: distinct doc_id, any order."""
    seen, out = set(), {}
    for d, text in sorted(((d, t) for d, t in docs if t is not None), key=lambda x: LAST if x[0] is None else x[0]):
        worded = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()]
        out[d] = set()
        for (i, a), (j, b) in zip(worded, worded[1:]):
            if (a, b) in seen:
                out[d] |= {i, j}
            seen.add((a, b))
    return out


def corpus(n=300):
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 8)))
    common = [[line() for _ in range(k)] for k in (2, 2, 2, 3, 4, 9, 40)]
    docs = []
    for d in range(n):
        parts = [line() for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            run = rng.choice(common)
            a = rng.randrange(len(run) - 1)
            parts += [x for y in run[a : rng.randint(a + 2, len(run))] for x in ([y, ""] if d % 4 == 0 else [y])]
            parts += [line() for _ in range(rng.randint(0, 3))]
        docs.append((d * 3 + 1, "\n".join(parts)))
    return docs


def removed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lines.dedup(df.selectExpr("doc_id", "text", "struct(doc_id) as row")).collect()
    assert len(rows) == len(docs)
    return {r["doc_id"]: (r["text"], r["n_chunks"], r["old"]) for r in rows}


def test_repeated_runs(spark):
    docs = corpus()
    got, want = removed(spark, docs), runs_of_lines(docs)
    found = total = 0
    for d, text in docs:
        all_, left, gone = text.split("\n"), got[d][0].split("\n"), set()
        # What is left is the text without some of the lines that repeat and blank lines between them.
        at = 0
        for i, x in enumerate(all_):
            if at < len(left) and left[at] == x and (x.split() == [] or i not in want[d] or all_[i:].count(x) == left[at:].count(x)):
                at += 1
            else:
                gone.add(i)
        assert {i for i in gone if all_[i].split()} <= want[d]
        total += len(want[d])
        found += len({i for i in gone if all_[i].split()})
    assert total > 1000 and found >= 0.95 * total


def test_first_places_stay(spark):
    run = "one of them\n\nanother of them\nthe third"
    docs = [(5, f"a b\n{run}\nc d"), (2, f"{run}\ne f"), (9, f"g\n{run}"), (None, f"h\n{run}\ni"), (11, None), (12, ""), (13, "the third"), (14, "\n \n\n")]
    got = removed(spark, docs)
    assert got[2][0] == docs[1][1] and got[11][0] is None and got[12][0] == "" and got[13][0] == "the third" and got[14][0] == "\n \n\n"
    assert got[5][0] == "a b\nc d" and got[9][0] == "g" and got[None][0] == "h\ni"


def test_within_one_text_and_repeated_rows(spark):
    docs = [(1, "x y\nz z\nq\nx y\nz z"), (1, "x y\nz z\nq\nx y\nz z"), (2, "x y\nz z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_lines_removed"]) for r in lines.op9(df).collect())
    assert got == [(1, 5, 2), (1, 5, 2), (2, 2, 2)]
    assert lines.op9(df.limit(0)).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Chunks of one hash with other bytes aren't repeats of each other."""
    rows = [(1, "a 1\na 2"), (2, "b 1\nb 2"), (3, "a 1\na 2"), (4, "b 1\nb 2\nown")]
    monkeypatch.setattr(lines, "chunks", lambda text: [(zlib.crc32(b"same"), [0, 1])] if len(text) > 1 else [])
    # Workers import the module anew, so the kernels are called here and their rows go through the same joins.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": [10 * d for d, _ in rows], "ord": [d for d, _ in rows], "text": [t for _, t in rows], "hs": [[zlib.crc32(b"same") - (1 << 63)]] * 4})
    table = pa.Table.from_batches(list(lines._rows(iter([batch])))).to_pylist()
    gone = lines.later(spark.createDataFrame([tuple(r.values()) for r in table], "h long, chunk binary, ord long, key long, place long"))
    assert {r["key"] for r in gone.collect()} == {30, 40}


def test_very_long_text(spark):
    rng = random.Random(3)
    body = [f"line {rng.randrange(10**9)}" for _ in range(60_000)]
    got = removed(spark, [(1, "\n".join(body)), (2, "\n".join(["mine", *body]))])
    assert got[1][1] == 0 and got[2][0].count("\n") <= 2
