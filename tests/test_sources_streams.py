"""Landed files and streams on small fixtures."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.operators import jobs as state
from glyphmill.sources import landed
from glyphmill.streaming import jobs


def test_json_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"gid": "a", "cp": 65}\n{broken\n\n7\n[1]\n{"gid": "b"}\n')
    got = landed.json_lines(spark, str(tmp_path / "f.jsonl"), "gid string, cp int").collect()
    assert sum(r["corrupt"] for r in got) == 3
    assert sorted((r["gid"], r["cp"]) for r in got if not r["corrupt"]) == [("a", 65), ("b", None)]


def test_layout_entries(spark):
    layout = '{"0": {"glyph": "a", "codePoint": "65", "adv": 1.5, "img": {"x": 1}}, "1": 7, "2": {"gid": "", "unicode": "zz", "s": "%s"}, "3": {"codepoint": 0, "unicode": 66, "b": true}, "4": {"glyph": "0", "unicode": 67.9}}' % ("y" * 129)
    rows = landed.layout_entries(spark.createDataFrame([("k", 1, layout), ("k", 2, None), ("k", 3, "[]")], "k string, page_no int, layout string"), "k", "layout").collect()
    assert [(r["gid"], r["cp"], r["meta"]) for r in sorted(rows, key=lambda r: r["ord"])] == [("a", 65, {"adv": "1.5"}), ("2", 0, {}), ("3", 66, {"b": "true"}), ("0", 67, {})]


def test_rects_and_errors(spark):
    raw = ['{"x":1,"y":2,"w":3,"h":4}', '{"left":1,"top":2,"width":3,"height":4}', '{"bbox":[1,2,5,8]}', '{"bbox":[5,5,2,2]}', '{"x":1}', None, '{"left":1,"y":2,"width":3,"h":4}', '{"x":1,"y":2,"w":0,"h":4}', '{"bbox":[5,5,-1,2]}', '{"bbox":[1,2,5,8,9]}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", landed.cell_rect(F.col("r")).alias("b")).orderBy("i").collect()
    assert [tuple(r["b"]) if r["b"] else None for r in got] == [(1, 2, 3, 4), (1, 2, 3, 4), (1, 2, 4, 6), (5, 5, 2, 2), None, None, (1, 2, 3, 4), None, None, None]
    codes = spark.createDataFrame([("dns_timeout",), ("VALIDATION_X",), (None,), ("odd",)], "c string").select(text.error_class(F.col("c")).alias("k")).collect()
    assert [r["k"] for r in codes] == ["NETWORK", "VALIDATION_FAILED", "UNKNOWN", "UNKNOWN"]


def _run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "QUEUED"), ("a", "2024-01-01 00:00:05", "DONE"), ("a", "2024-01-01 00:00:09", "FAILED"), ("b", "2024-01-01 00:00:01", "QUEUED"), ("b", "2024-01-01 00:00:01", "QUEUED")]
    spark.createDataFrame(rows, "job string, t string, status string").selectExpr("job", "cast(t as timestamp) ts", "status").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("job string, ts timestamp, status string").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, _run(jobs.states(stream(), "1 minute"), "states", tmp_path))) == [("a", "DONE", 2), ("b", "QUEUED", 2)]
    assert len(_run(jobs.once(stream(), ["job", "ts", "status"], "ts", "1 minute"), "once", tmp_path)) == 4


def test_gray_images(spark, tmp_path):
    """A gray PNG of 3 x 2 pixels, written here by hand."""
    pixels = [[0, 51, 255], [255, 102, 0]]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (row,) = landed.alpha(spark, str(tmp_path)).collect()
    assert (row["width"], row["height"]) == (3, 2) and [round(x, 6) for x in row["alpha"]] == [1.0, 0.8, 0.0, 0.0, 0.6, 1.0]


def test_names_and_updates(spark):
    df = spark.createDataFrame([("Foo Extra_SemiBold",), ("heavy-thin",), ("Roman",), (None,)], "n string")
    assert [r[0] for r in df.select(text.weight_of(F.col("n"))).collect()] == ["SemiBold", "Heavy", None, None]
    assert spark.range(1).select(text.forced_names(F.lit(" Bold ;;thin; bold"))).first()[0] == ["bold", "thin"]
    with pytest.raises(ValueError):
        state.updated(df, {"status": F.lit("DONE")}, frozenset({"stage"}))
    assert state.updated(df.withColumn("stage", F.lit("x")), {"stage": F.lit("y")}, frozenset({"stage"})).first()["stage"] == "y"
