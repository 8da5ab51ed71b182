"""Markup and curves on small fixtures: nulls, empty pages, broken blocks, order of objects, saddles, lines without length."""

from pyspark.sql import functions as F

from glyphmill.operators import curves, markup


def test_linked_data(spark):
    def page(*blocks):
        return "".join(f"<script type='application/ld+json'>{b}</script>" for b in blocks)

    pages = [
        (1, page("{bad", '{"a":{"brand":{"name":" Bee "}},"name":"xx"}')), (2, page('{"name":"Top  &amp; co","brand":7}', '{"brand":"late"}')),
        (3, "<p>none</p>"), (4, None), (5, page('[{"offer":{"name":"inner"}},{"name":"outer"}]')), (6, page("3", "null", '"text"')),
    ]
    df = spark.createDataFrame(pages, "id int, html string").select("id", markup.linked_data(markup.blocks(F.col("html"))).alias("l"))
    assert {r["id"]: (r["l"]["name"], r["l"]["brand"]) for r in df.collect()} == {1: ("xx", "Bee"), 2: ("Top & co", "late"), 3: (None, None), 4: (None, None), 5: ("inner", None), 6: (None, None)}


def test_candidates(spark):
    html = "é<a HREF='/x' href=\"/y\" title=\"q\">First  name</a><b data-m='k'></b><i>Near by</i>"
    df = markup.candidates(spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string"), "id", "html", [r"<b\b[^>]*>", r"<a\b[^>]*>"])
    near = markup.nearby(F.col("after"), F.col("near"), "([^<>]+)<", ["<h9>([^<]*)<", "<i>([^<]*)<"])
    got = df.select("id", "pos", "pattern", markup.attributes(F.col("value")).alias("a"), near.alias("name")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, {"href": "/x", "title": "q"}, "First name"), (1, html.index("<b"), 0, {"data-m": "k"}, "Near by")]
    assert [r[0] for r in spark.createDataFrame([("a&amp;b",), (None,)], "t string").select(markup.unescaped("t")).collect()] == ["a&b", None]


def test_resampling(spark):
    rows = [("a", 0, 0.0, 0.0), ("a", 1, 2.0, 0.0), ("a", 2, 2.0, 2.0), ("point", 0, 1.0, 1.0), ("point", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").withColumnRenamed("k", "id")
    got = curves.resampled(df, "id", 5).orderBy("k").collect()
    assert [(r["id"], r["k"], r["x"], r["y"]) for r in got] == [("a", 0, 0, 0), ("a", 1, 1, 0), ("a", 2, 2, 0), ("a", 3, 2, 1), ("a", 4, 2, 2)]


def test_contours(spark):
    cells = [(1, [1.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0, 0.8]), (3, [0.0, 0.0, 0.0, 0.0]), (4, [1.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(cells, "id int, v array<double>").select("id", curves.contour_segments(F.col("v"), 2, 2, 0.45).alias("s"))
    got = {r["id"]: [tuple(round(c, 3) for c in s) for s in r["s"]] for r in df.collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [2, 2, 0, 1]
    assert got[1] == [(0.55, 0, 1, 0.45), (0.45, 1, 0, 0.55)]  # joined, ink on the right
    assert got[2] == [(0.55, 0, 0, 0.55), (0.562, 1, 1, 0.562)]  # apart
    assert got[4] == [(0.55, 0, 0.55, 1)]
