"""Unique names, addresses, landed pages, isolated failures, requeues and the frozen sink on fixtures."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import addresses, links
from glyphmill.operators import discovery, isolated, jobs, names
from glyphmill.streaming import jobs as streams


def folded(rows, sep, most, fold):
    """Names one after another, each free in its group; rows: (group, base)."""
    seen, out = {}, []
    for group, base in rows:
        taken, name, k = seen.setdefault(group, set()), base, 2
        same = str.lower if fold else str
        while same(name) in taken:
            suffix = f"{sep}{k}"
            name, k = (base[: most - len(suffix)].rstrip(sep) if most else base) + suffix, k + 1
        taken.add(same(name))
        out.append(name)
    return out


def test_safe_names(spark):
    rng = random.Random(1)
    long = "n" * 85
    bases = ["x", "X", "x-2", "x-3", "x-2-2", "Foo", "foo-10", "n" * 80, "n" * 79, "n" * 78 + "-2", "n" * 60, "m" * 58, "m" * 58 + "-1", "unnamed"]
    raws = [(g, b) for g in ("a", "b") for b in rng.choices(bases, k=150)]
    raws += [("a", long), ("a", None), ("a", ""), (None, "x"), (None, "x")] + [("hot", "same")] * 300
    slugged = [(g, (b or "unnamed")[:80]) for g, b in raws]
    df = spark.createDataFrame([(i, g, b, "c") for i, (g, b) in enumerate(raws)], "i int, g string, raw string, name string").repartition(5)
    got = {r["i"]: r["unique_name"] for r in names.safe(df, "g", ["i"], "raw").collect()}
    assert [got[i] for i in range(len(raws))] == folded(slugged, "-", 80, True)
    plain = [(g, b or "") for g, b in raws]
    got = {r["i"]: r["unique_name"] for r in names.distinct(df, "g", ["i"], "raw").collect()}
    assert [got[i] for i in range(len(raws))] == folded(plain, "_", None, False)
    assert names.safe(df.limit(0), "g", ["i"], "raw").count() == 0


def test_address_classes(spark):
    raw = ["0.0.0.0", "0.1.2.3", "10.0.0.1", "127.1.2.3", "169.254.9.9", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.170", "192.0.2.7", "192.88.99.1", "192.168.1.1", "198.17.0.0", "198.18.0.1", "198.19.255.255"]
    raw += ["198.51.100.4", "203.0.113.9", "224.0.0.1", "239.255.255.255", "240.0.0.1", "255.255.255.255", "8.8.8.8", "1.1.1.1", "::", "::1", "::2", "fe80::1", "febf::", "fec0::1", "fc00::", "fdff::1", "ff02::1", "2001:db8::1", "2001:4860:4860::8888", "2001:0:1::", "2001:1::1", "2001:1::3"]
    raw += ["2001:20::5", "2001:200::", "2002:808:808::", "2606:4700::1111", "64:ff9b:1::9", "64:ff9b::8.8.8.8", "100::1", "3fff::1", "4000::", "1:2:3:4:5:6:7:8", "2a00:1:2:3:4:5:6:7", "2a00::1.2.3.4", "2A00::FFFF"]
    bad = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "::1::", "1:2:3", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::8:9", "::1.2.3", "::1.2.3.256", "example.org", ":::", "1::2::3"]
    df = spark.createDataFrame([(a,) for a in [*raw, *bad, None]], "a string").withColumn("c", addresses.address_class(F.col("a")))
    got = {r["a"]: r["c"] for r in df.collect()}
    for a in raw:
        ip = ipaddress.ip_address(a)
        public = not (ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)
        assert (got[a] == "public") == public, (a, got[a])
    for a in bad:
        with pytest.raises(ValueError):
            ipaddress.ip_address(a)
    assert {got[a] for a in [*bad, None]} == {"invalid"}
    assert [got[a] for a in ("::", "::1", "fe80::1", "ff02::1", "10.0.0.1", "240.0.0.1")] == ["unspecified", "loopback", "link_local", "multicast", "private", "reserved"]
    sets = spark.createDataFrame([(["8.8.8.8", "2606:4700::1111"],), (["8.8.8.8", "10.0.0.1"],), ([],)], "a array<string>").select(addresses.all_public(F.col("a")).alias("p"))
    assert [r["p"] for r in sets.collect()] == [True, False, False]


def page(*gids, image="", extra=""):
    return '{"layout": {%s}, "image": "%s"}' % (", ".join(f'"{k}{extra}": {{"gid": "{g}", "codePoint": 65}}' for k, g in enumerate(gids)), image)


def test_stop_reasons(spark):
    cases = {
        "short_page": [page("a", "b", image="1"), page("c")],
        "repeated_signature": [page("a", "b"), page("c", "d")],
        "no_new_glyphs": [page("a", "b"), page("b", "a", extra="x")],
        "empty_layout": [page("a", "b"), '{"layout": [1]}'],
        "error": [page("a", "b"), "[]", page("q", "r")],
        "max_pages": [page("a", "b", image="1"), page("c", "d", image="2"), page("e", "f", image="3"), page("g", "h", image="4")],
    }
    rows = [(k, i, p) for k, pages in cases.items() for i, p in enumerate(pages, 1)]
    rows += [("null", 1, None), ("gap", 1, page("a", "b")), ("gap", 3, page("c", "d", image="x")), ("runs out", 1, page("a", "b")), ("junk", 1, '{"layout": {"0": 7, "1": {"gid": "a"}}}'), ("junk", 2, '{"layout": {"0": 7}}')]
    got = discovery.discovered(spark.createDataFrame(rows, "id string, page_no int, payload string"), "id", 2, 3).collect()
    assert {r["id"]: (r["pages"], r["stop_reason"], r["found"]) for r in got} == {
        "short_page": (2, "short_page", 3), "repeated_signature": (2, "repeated_signature", 2), "no_new_glyphs": (2, "no_new_glyphs", 2), "empty_layout": (2, "empty_layout", 2),
        "error": (1, "error", 2), "max_pages": (3, "max_pages", 6), "null": (0, "error", 0), "gap": (1, "error", 2), "runs out": (1, "error", 2), "junk": (2, "no_new_glyphs", 1),
    }


def test_attempts(spark):
    def half(x):
        if x == 3:
            raise KeyError(x)
        return 100 / x

    df = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (None,)], "x double").repartition(1).select("x", isolated.attempt(half, T.DoubleType())(F.col("x")).alias("t"))
    assert {r["x"]: tuple(r["t"]) for r in df.collect()} == {0.0: (None, "ZeroDivisionError"), 2.0: (50.0, None), 3.0: (None, "KeyError"), None: (None, None)}


def test_outlines(spark):
    box = [0.0] * 64
    for y in range(2, 6):
        box[y * 8 + 2 : y * 8 + 6] = [1.0] * 4
    speck = [0.0] * 64
    speck[27] = 0.6
    broken = list(box)
    broken[0] = float("nan")
    rows = [("box", box), ("none", None), ("short", box[:-1]), ("nan", broken), ("empty", [0.0] * 64), ("speck", speck)]
    df = spark.createDataFrame([(k, v, 8, 8) for k, v in rows], "id string, alpha array<double>, w int, h int").repartition(1)
    got = {r["id"]: (r["error"], r["contours"]) for r in isolated.outlines(df, "id").collect()}
    assert {k: e for k, (e, _) in got.items()} == {"box": None, "none": "NO_OBSERVATIONS", "short": "BAD_SHAPE", "nan": "NOT_FINITE", "empty": "EMPTY", "speck": "NO_CONTOURS"}
    assert len(got["box"][1]) == 1 and len(got["box"][1][0]) >= 4 and all(c is None for k, (_, c) in got.items() if k != "box")


def test_requeue_event(spark):
    rows = [("a", "RESOLVING", None, "w1", 0, "s"), ("b", "RESOLVING", "", "me", 1, "s"), ("c", "RESOLVING", "", "w2", 1, "s"), ("d", "DONE", "odd", "w1", 0, "s"), ("e", "RESOLVING", "odd", "me", 2, "s")]
    df = spark.createDataFrame(rows, "id string, status string, beat string, worker string, attempts int, stage string")
    out, events = jobs.requeue(df, "beat", F.lit("2024-01-01").cast("timestamp"), 90, "worker", "me")
    assert {r["id"]: (r["status"], r["attempts"]) for r in out.collect()} == {"a": ("QUEUED", 1), "b": ("RESOLVING", 1), "c": ("QUEUED", 2), "d": ("DONE", 0), "e": ("QUEUED", 3)}
    assert sorted(tuple(r) for r in events.collect()) == [("a", "requeued_stale", "w1", "me"), ("c", "requeued_stale", "w2", "me"), ("e", "requeued_stale", "me", "me")]


def test_one_pixel_is_an_outline(spark, tmp_path):
    """A vector that stands out in one place has an outline in the query; the operator by itself takes so small a ring as noise."""
    from glyphmill.plans.records import isolated_glyphs

    one = [0.1] * 64
    one[27] = 9.0
    spark.createDataFrame([(7, one), (8, one), (11, one)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, isolated_glyphs(spark, str(tmp_path)).collect()), key=lambda r: r[0]) == [(7, None, True), (8, "NO_OBSERVATIONS", None), (11, "EMPTY", None)]
    alpha = [0.0] * 81
    alpha[40] = 1.0
    assert isolated.outlines(spark.createDataFrame([(1, alpha, 9, 9)], "id int, alpha array<double>, w int, h int"), "id").first()["error"] == "NO_CONTOURS"


def drive(spark, tmp_path, start, batches):
    """Each batch is one file; the query is started anew for every one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "job string, worker string, t string, status string").selectExpr("job", "worker", "cast(t as timestamp) ts", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = start(spark.readStream.schema("job string, worker string, ts timestamp, status string").parquet(str(tmp_path / "in")))
        q.awaitTermination(120)


def test_silent_worker_is_requeued_once(spark, tmp_path):
    def start(stream):
        out = streams.requeues(stream, 90, "10 seconds", "me")
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()

    beat = lambda job, worker, t, status="RESOLVING": (job, worker, f"2024-01-01 00:{t}", status)
    drive(spark, tmp_path, start, [
        [beat("a", "w1", "00:00"), beat("b", "w2", "00:00"), beat("c", "w3", "00:00", "DONE")],
        [beat("b", "w2", "01:00"), beat("clock", "x", "02:00")],  # a is silent for 90 s by 01:50
        [beat("clock", "x", "02:10"), beat("b", "w2", "02:05")],
        [beat("b", "w2", "02:05"), beat("clock", "x", "03:20")],  # a beat sent again
        [beat("a", "w4", "03:30"), beat("clock", "x", "06:00")],  # a is claimed by another, which falls silent too
        [beat("clock", "x", "06:10")],
    ])
    got = sorted((r["job"], r["attempts"], r["previous_worker"], r["requeued_by"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["job"] != "clock")
    assert got == [("a", 1, "w1", "me", "requeued_stale"), ("a", 2, "w4", "me", "requeued_stale"), ("b", 1, "w2", "me", "requeued_stale")]


def test_frozen_sink(spark, tmp_path):
    write = streams.freeze(str(tmp_path / "f"), "gid")
    batch = lambda *rows: spark.createDataFrame(rows, "entry string, gid string, advance int, seq long")
    write(batch(("e", "a", 1, 1), ("e", "b", 2, 2), ("e", "a", 3, 3)), 0)
    write(batch(("e", "c", 5, 4), ("g", "d", 6, 5)), 1)
    write(batch(("e", "c", 5, 4), ("g", "d", 6, 5)), 1)  # sent again after a failure
    write(batch(("e", "b", 7, 6)), 2)
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert sorted((r["gid"], r["advance"]) for r in streams.frozen(rows, "gid").collect()) == [("a", 3), ("b", 7), ("c", 5), ("d", 6)]
    assert {r["entry"]: r["frozen"] for r in streams.frozen_counts(rows, "gid", "entry").collect()} == {"e": 3, "g": 1}


def test_redirects(spark):
    rows = [("/x?y=1#z", "https://h.org/a"), (None, "https://h.org/a"), ("", "https://h.org/a"), ("https://[bad", "https://h.org/a"), ("https://h.org:8443/", "https://h.org/a"), ("ftp://h.org/", "https://h.org/"), ("https://:p@h.org/", "https://h.org/"), ("https:///x", "https://h.org/"), ("/x", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(links.redirect(F.col("a"), F.col("b"), "h.org").alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [("https://h.org/x?y=1#z", "ok"), (None, "bad_redirect"), (None, "bad_redirect"), (None, "bad_format"), ("https://h.org:8443/", "ok"), (None, "bad_scheme"), (None, "bad_format"), ("https://h.org/x", "ok"), (None, "bad_scheme")]
    assert spark.range(1).select(links.stable_id(F.lit("md5"), F.lit(None).cast("string"))).first()[0] is None
