"""Changes of state on fixtures: unknown ids, refused and invalid commands, repeated requests, empty tables."""

import datetime

from pyspark.sql import functions as F

from glyphmill.operators import discovery, lifecycle, markup, metrics, rasters

JOBS = "id string, source_url string, normalized_url string, status string, stage string, attempts int, cancel_requested boolean, created_at timestamp, updated_at timestamp, finished_at timestamp, error_code string, error_message string, zip_name string, zip_size long"
COMMANDS = "job string, seq int, ts timestamp, command string, target string, error_code string, error_message string, zip_name string, zip_size long"


def at(n):
    return datetime.datetime(2024, 1, 1, 0, n)


def job(i, status, **more):
    given = {"id": i, "status": status, "cancel_requested": False, "attempts": 0} | more
    return tuple(given.get(c.split()[0]) for c in JOBS.split(", "))


def test_submission(spark):
    jobs = spark.createDataFrame([job("a", "DONE")], JOBS)
    requests = spark.createDataFrame([("a", " u ", "n"), ("b", " u ", "n"), ("b", " u ", "n")], "id string, source_url string, normalized_url string")
    out, events = lifecycle.submitted(jobs, requests, F.lit("2024-01-01").cast("timestamp"))
    assert out.schema.names == jobs.schema.names
    assert {r["id"]: (r["status"], r["attempts"], r["source_url"]) for r in out.collect()} == {"a": ("DONE", 0, None), "b": ("QUEUED", 0, " u ")}
    assert [tuple(r)[2:] for r in events.collect()] == [("created", '{"source_url":"u","normalized_url":"n"}')]
    assert lifecycle.found(out, "b").count() == 1 and lifecycle.found(out, "z").count() == 0


def test_commands(spark):
    jobs = spark.createDataFrame([job("open", "QUEUED", error_code="OLD"), job("done", "DONE", zip_name="z"), job("asked", "RESOLVING"), job("odd", "QUEUED"), job("idle", "QUEUED")], JOBS)
    c = lambda i, seq, command, target=None, *more: (i, seq, at(seq), command, target, *more, *[None] * (4 - len(more)))
    commands = [
        c("open", 1, "request"), c("open", 2, "cancel"), c("open", 3, "request"), c("open", 4, "finish", "FAILED", None, "late"), c("open", 5, "cancel"),
        c("done", 1, "cancel"), c("done", 2, "request"), c("done", 3, "finish", "DONE_WITH_ERRORS", None, None, None, 9), c("asked", 1, "finish", "RESOLVING", "E"), c("asked", 2, "request"),
        c("odd", 1, "pause"), c("odd", 2, None), c("odd", 3, "finish", None), c("nobody", 1, "cancel"),
    ]
    out, results = lifecycle.commanded(jobs, spark.createDataFrame(commands, COMMANDS))
    assert {(r["job"], r["seq"]): r["result"] for r in results.collect()} == {
        ("open", 1): "applied", ("open", 2): "applied", ("open", 3): "refused", ("open", 4): "applied", ("open", 5): "refused", ("done", 1): "refused", ("done", 2): "refused",
        ("done", 3): "applied", ("asked", 1): "invalid", ("asked", 2): "applied", ("odd", 1): "invalid", ("odd", 2): "invalid", ("odd", 3): "invalid", ("nobody", 1): "missing",
    }
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 5 and out.schema.names == jobs.schema.names
    fields = ("status", "cancel_requested", "error_code", "error_message", "zip_name", "zip_size", "finished_at")
    assert {i: tuple(r[f] for f in fields) for i, r in got.items()} == {
        "open": ("FAILED", True, "OLD", "late", None, None, at(4)), "done": ("DONE_WITH_ERRORS", False, None, None, "z", 9, at(3)),
        "asked": ("RESOLVING", True, None, None, None, None, None), "odd": ("QUEUED", False, None, None, None, None, None), "idle": ("QUEUED", False, None, None, None, None, None),
    }
    assert lifecycle.commanded(jobs, spark.createDataFrame([], COMMANDS))[0].count() == 5


def test_registration(spark):
    existing = spark.createDataFrame([("a", 1, "kept", "DONE")], "job string, position int, name string, status string")
    specs = spark.createDataFrame([("a", 1, "new"), ("b", 3, None), ("b", 1, "x"), ("b", 2, ""), ("c", 1, "y")], "job string, seq int, name string")
    rows, events = lifecycle.registered(existing, specs, 2)
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1, "kept", "DONE"), ("b", 1, "x", "QUEUED"), ("b", 2, "Style 2", "QUEUED"), ("c", 1, "y", "QUEUED")]
    assert [tuple(r) for r in events.collect()] == [("b", "styles_truncated", 3, 2)]
    again, more = lifecycle.registered(rows, specs, 2)
    assert again.count() == 4 and more.count() == 0
    assert lifecycle.registered(existing, specs)[0].filter("job = 'b'").count() == 3 and lifecycle.registered(existing, specs)[1].count() == 0


def test_outcomes_and_guards(spark):
    children = spark.createDataFrame([("a", "DONE"), ("a", "FAILED"), ("b", "FAILED"), ("c", "DONE")], "job string, status string")
    got = lifecycle.outcomes(spark.createDataFrame([(i,) for i in "abcd"], "id string"), children).collect()
    assert {r["id"]: (r["status"], r["error_code"]) for r in got} == {"a": ("DONE_WITH_ERRORS", None), "b": ("FAILED", "STYLES_FAILED"), "c": ("DONE", None), "d": ("FAILED", "NO_STYLES")}
    hits = spark.createDataFrame([("binary", 0, 1), ("binary", 1, 0), ("fontmodel", 5, 0), ("fontmodel", 0, 1), ("partial", 0, 0), ("miss", 0, 0)], "status string, frozen int, reconstructed int")
    assert [r["serve"] for r in lifecycle.hollow_hits(hits).collect()] == ["miss", "binary", "miss", "fontmodel", "partial", "miss"]


def test_pages_without_styles(spark):
    pages = spark.createDataFrame([(1, "<p data-MD5hash='x'>"), (2, "<p>"), (3, None), (4, "<p>")], "page int, html string")
    styles = spark.createDataFrame([(4,)], "page int")
    assert sorted(tuple(r) for r in markup.without_styles(pages, "page", styles).collect()) == [(1, "NO_STYLES"), (2, "NO_MARKER"), (3, "NO_MARKER")]


def test_styles_of_a_page(spark):
    rows = [("p", "k1", 5, None, "a"), ("p", "k2", 3, " Bold ", "a"), ("p", "k1", 9, "Thin", "b"), ("p", "k1", 12, "Black", "c"), ("p", "k3", 20, "", "d"), ("p", "k3", 21, None, "e"), ("q", "k1", 1, None, None)]
    got = discovery.styles(spark.createDataFrame(rows, "page string, md5 string, pos int, name string, pattern string"), "page", "md5", "pos", "name", "pattern").collect()
    assert sorted(tuple(r) for r in got) == [
        ("p", 1, "k2", 3, "Bold", "Bold", "a", False), ("p", 2, "k1", 5, "Thin", "Thin", "b", False), ("p", 3, "k3", 20, "Style 3", None, "d", True), ("q", 1, "k1", 1, "Style 1", None, None, True),
    ]


def test_structure_and_ink(spark):
    glyphs = spark.createDataFrame([("a", ".notdef", 500.0, True), ("a", "x", 1.0, True), ("b", "x", -1.0, False), ("c", "x", None, None), ("c", "y", 1.0, True)], "m string, name string, advance double, loads boolean")
    cmap = spark.createDataFrame([("a", 65, "x"), ("c", 65, "z"), ("gone", 65, "x")], "m string, cp int, name string")
    got = {r["m"]: (r["errors"], r["passed"]) for r in metrics.structural(glyphs, cmap, "m").collect()}
    assert got == {"a": ([], True), "b": (["EMPTY_CMAP", "TOO_FEW_GLYPHS", "OUTLINE", "NEGATIVE_ADVANCE"], False), "c": (["DANGLING_CMAP"], False)}
    models = spark.createDataFrame([("a",), ("b",)], "m string")
    inks = spark.createDataFrame([("a", c, 9) for c in b"abcde"] + [("a", 102, 0), ("b", 97, None)], "m string, cp int, ink int")
    assert {r["m"]: (r["total"], r["empty"], r["passed"]) for r in metrics.rendered(models, inks, "m", "a b,c-d e f f").collect()} == {"a": (6, 1, True), "b": (6, 6, False)}
    assert {r["passed"] for r in metrics.rendered(models, inks, "m", " ..").collect()} == {True}


def test_rendered_long_samples_and_models_sent_twice(spark):
    """More letters than one column of bits holds, astral ones too; a model that comes twice is looked at once. Nothing is joined."""
    sample = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0x4E00, 0x4E50), 0x1D400]))
    models = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "m string")
    inks = spark.createDataFrame([("a", ord(c), 1.0) for c in sample + sample[:9]] + [("b", 0x1D400, 2.0), ("b", 65, 0.0), ("b", 33, 1.0), ("c", 65, 1.0)], "m string, cp int, ink double")
    out = metrics.rendered(models, inks, "m", sample)
    n = len(sample)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", n, 0, True), ("b", n, n - 1, False), (None, n, n, False)], key=str)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_transforms_and_nudges(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0, 0.5, 0.0], 0.25), (2, [0.0, 1.0, 0.0, 0.0, 0.5, 0.0], -1.0), (3, [1.0] * 6, 9.0)], "id int, v array<double>, d double")
    got = {r["id"]: r["n"] for r in df.select("id", rasters.nudged(F.col("v"), 3, 2, F.col("d"), "x").alias("n")).collect()}
    assert got == {1: [0, 0.75, 0.25, 0, 0.375, 0.125], 2: [1, 0, 0, 0.5, 0, 0], 3: [0] * 6}
    down = df.filter("id = 1").select(rasters.nudged(F.col("v"), 3, 2, F.lit(0.5), "y").alias("n")).first()["n"]
    assert down == [0, 0.5, 0, 0, 0.75, 0]
    u = spark.range(1).select(rasters.to_units(F.lit(32.0), F.lit(64.0), F.lit(64.0), rasters.baseline(F.lit(64.0))).alias("u")).first()["u"]
    assert tuple(u) == (500.0, (51.2 - 64) * 1000 / 64)
    means = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0],)], "v array<double>").select(rasters.block_means(F.col("v"), 5, 2).alias("m")).first()["m"]
    assert means == [(1 + 2 + 6 + 7) / 4, (3 + 4 + 8 + 9) / 4]  # an odd last column is left out
