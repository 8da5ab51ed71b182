"""Stages of the corpus pipeline on rows with odd column names, each against a plain version."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _dropped string, row int, c0 int, _w double"


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    item = [f"q{i}" for i in range(20)]
    texts = {i: [word() for _ in range(rng.randint(40, 90))] for i in range(1, 25)}
    texts[30] = texts[3][:-1] + ["other"]
    texts[31] = list(texts[4])
    texts[32] = texts[5][:20] + item + texts[6][:20]
    texts[33] = ["a", "b", "c"] * 40
    texts[34] = ["too", "few"]
    docs = [(i, " ".join(w), "en", f"s{i % 3}", None, "x", 1, 2, 0.5) for i, w in texts.items()]
    return docs + [(40, None, None, None, None, None, None, None, None), (41, "", "en", "s1", 0, "", 0, 0, 0.0)], [(1, " ".join(item))]


def test_stages(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (33, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    stage = {name: (lambda d, f=f: f(spark, d, str(tmp_path))) for name, f in corpus_pipeline.STAGES}
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    everyone = sorted(d[0] for d in docs)

    got = stage["quality"](df)
    assert got.columns == df.columns and ids(got) == [d for d in everyone if d not in (33, 34, 40, 41)]

    common = "\n".join(f"line {i} of it" for i in range(12))
    some = [(*docs[0][:1], "own\n" + common, *docs[0][2:]), (*docs[1][:1], "other\n" + common + "\nend", *docs[1][2:]), docs[-2]]
    got = {r["doc_id"]: r for r in stage["lines"](spark.createDataFrame(some, SCHEMA)).collect()}
    assert got[some[0][0]]["text"] == some[0][1] and got[some[1][0]]["text"] == "other\nend" and got[40]["text"] is None

    got = stage["near_duplicates"](df)
    assert got.columns == df.columns and ids(got) == [d for d in everyone if d not in (30, 31)]

    got = stage["decontamination"](df)
    assert got.columns == df.columns and ids(got) == [d for d in everyone if d != 32]

    got = stage["mix"](df).collect()
    taken = {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 2 and not {40, 41} & set(taken)
    size = {d[0]: len((d[1] or "").split()) for d in docs}
    total = sum(size[d] * n for d, n in taken.items())
    assert abs(total - 1.5 * sum(size.values())) <= 0.03 * 1.5 * sum(size.values())
    for name, f in stage.items():
        assert f(df.limit(0)).count() == 0, name
