"""Contours, corners, simplification, fits and alignment on drawn shapes and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import contours, curves, rasters

SIZE = 128
L = [(39, 15), (55, 15), (55, 86), (95, 86), (95, 102), (39, 102)]
H = [(23, 15), (39, 15), (39, 52), (89, 52), (89, 15), (105, 15), (105, 102), (89, 102), (89, 67), (39, 67), (39, 102), (23, 102)]


def disk(r, centre=64.0):
    """A disk, four samples to a pixel's side."""
    at = (np.arange(4 * SIZE) + 0.5) / 4 - 0.5 - centre
    return (np.hypot(*np.meshgrid(at, at)) <= r).reshape(SIZE, 4, SIZE, 4).mean((1, 3))


def polygon(p):
    """Even-odd fill of a polygon with sides along the axes."""
    y, x = np.mgrid[:SIZE, :SIZE] + 0.5
    inside = np.zeros((SIZE, SIZE), bool)
    for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]):
        if y0 != y1:
            inside ^= (x < x0) & (y >= min(y0, y1)) & (y < max(y0, y1))
    return inside.astype(float)


@pytest.fixture(scope="module")
def rings(spark):
    noise = np.zeros((SIZE, SIZE))
    noise[30:32, 30:32] = noise[10, 10] = 1
    border = np.zeros((SIZE, SIZE))
    border[:20, :20] = 1
    shapes = {"disk": disk(37.5), "ring": disk(37.5) - disk(18.75), "dot": disk(50) - disk(37.5) + disk(18.75), "L": polygon(L), "H": polygon(H), "noise": noise, "border": border, "empty": np.zeros((SIZE, SIZE))}
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in shapes.items()], "id string, v array<double>").repartition(8)
    cells = df.select("id", curves.contour_segments(F.col("v"), SIZE, SIZE, 0.5).alias("s"))
    out = contours.nested(contours.chained(cells, "id", "s"), "id").persist()
    yield out
    out.unpersist()


def test_rings_and_nesting(rings):
    got = {}
    for r in rings.collect():
        got.setdefault(r["id"], []).append((r["depth"], r["area"], r["perimeter"]))
    assert set(got) == {"disk", "ring", "dot", "L", "H", "noise"}  # ink at the border leaves its chain open
    assert {k: sorted(d for d, *_ in v) for k, v in got.items() if k != "noise"} == {"disk": [0], "ring": [0, 1], "dot": [0, 1, 2], "L": [0], "H": [0]}
    assert all((a > 0) == (d % 2 == 0) for v in got.values() for d, a, _ in v)
    area = lambda k: [a for _, a, _ in sorted(got[k])]
    assert area("disk")[0] == pytest.approx(math.pi * 37.5**2, rel=0.03)
    assert got["disk"][0][2] == pytest.approx(2 * math.pi * 37.5, rel=0.05)
    assert area("ring") == pytest.approx([math.pi * 37.5**2, -math.pi * 18.75**2], rel=0.03)
    assert all(abs(a) >= 1 and p >= 4 for _, a, p in got["noise"]) and len(got["noise"]) == 1


def test_orientation_holds_before_nesting(spark):
    """Rings come out of the segments with ink on the right."""
    v = (disk(37.5) - disk(18.75)).ravel().tolist()
    cells = spark.createDataFrame([(1, v)], "id int, v array<double>").select("id", curves.contour_segments(F.col("v"), SIZE, SIZE, 0.5).alias("s"))
    areas = [r["a"] for r in contours.chained(cells, "id", "s").select(rasters.signed_area(F.col("points")).alias("a")).collect()]
    assert len(areas) == 2 and max(areas) > 4000 and -1200 < min(areas) < -1000


def test_rings_that_meet_are_one(spark):
    """Two squares that meet in a corner, to three decimals alone, are one ring wherever the walk begins; a third is its own."""

    def square(x, y, a, turn):
        c = [(x, y), (x + a, y), (x + a, y + a), (x, y + a)][::turn]
        return list(zip(c, c[1:] + c[:1]))

    segments = [(*p, *q) for p, q in square(0.0, 0.0, 4.0, 1) + square(4.0002, 4.0001, 2.0, 1) + square(9.0, 9.0, 3.0, -1)]
    rng = random.Random(4)
    rows = [(i, rng.sample(segments, len(segments))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s array<struct<x:double,y:double,u:double,v:double>>")
    areas = {}
    for r in contours.chained(df, "id", "s").select("id", rasters.signed_area(F.col("points")).alias("a")).collect():
        areas.setdefault(r["id"], []).append(r["a"])
    assert len(areas) == 40
    for a in areas.values():
        assert sorted(a) == pytest.approx([-9, 20], abs=1e-6)


def test_corners(rings):
    n = {r["id"]: r["count"] for r in contours.corners(rings.filter("id in ('L', 'H', 'disk')"), ["id", "ring"]).groupBy("id").count().collect()}
    assert n == {"L": 6, "H": 12}


def test_fit(rings):
    df = rings.filter("id in ('L', 'H', 'disk', 'ring')").select("id", "points", contours.fitted(F.col("points")).alias("c"))
    df = df.select("id", "c", "points", contours.flattened(F.col("c"), 0.01).alias("f"))
    for r in df.select("id", "c", contours.deviation(F.col("points"), F.col("f")).alias("far")).collect():
        assert r["far"] <= 1.5 and len(r["c"]) >= {"L": 6, "H": 12}.get(r["id"], 4), r["id"]
        assert all(a[3] == b[0] for a, b in zip(r["c"], r["c"][1:] + r["c"][:1]))
        assert all(math.isfinite(x) for c in r["c"] for p in c for x in p)


def test_checked_fit_in_one_worker(spark):
    """More rings than are objects at once, small, empty and null ones among them: as fit, polyline and deviation one by one, by one kernel."""
    from glyphmill.plans.shapes import fitted_rings

    rng = random.Random(7)
    rows = [(i, None if i % 50 == 1 else [(40 * math.cos(0.4 * k) + rng.random(), 40 * math.sin(0.4 * k)) for k in range(i % 17)]) for i in range(2 * contours.ROWS + 3)]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>").repartition(1)
    got = {r["id"]: (r["r"]["cubics"], r["r"]["far"]) for r in df.select("id", contours.checked_fit(F.col("p")).alias("r")).collect()}
    apart = df.select("id", "p", contours.fitted(F.col("p")).alias("c")).select("id", "c", contours.deviation(F.col("p"), contours.flattened(F.col("c"), 0.05)).alias("far"))
    assert got == {r["id"]: (r["c"], r["far"]) for r in apart.collect()}
    assert len(got) == len(rows) and got[1] == (None, None) and got[0] == ([], None)
    assert fitted_rings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_small_rings(spark):
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (2, []), (3, None), (4, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>")
    got = {r["id"]: (r["c"], r["s"], r["f"]) for r in df.withColumn("c", contours.fitted(F.col("p"))).select("id", "c", contours.simplified(F.col("p"), 9.0).alias("s"), contours.flattened(F.col("c")).alias("f")).collect()}
    assert got[3] == (None, None, None) and got[2] == ([], [], []) and got[1][0] == [] and len(got[1][1]) == 3
    assert len(got[4][0]) == len(got[4][1]) == len(got[4][2]) == 4


def brute_simplified(p, tol):
    p = list(p)
    while len(p) > 4:
        far = []
        for i in range(len(p)):
            q, a, b = (np.array(v) for v in (p[i], p[i - 1], p[(i + 1) % len(p)]))
            sq = ((b - a) ** 2).sum()
            t = min(max(((q - a) * (b - a)).sum() / sq, 0), 1) if sq >= 1e-12 else 0
            far.append(np.hypot(*(q - a - t * (b - a))))
        if min(far) >= tol:
            break
        p.pop(int(np.argmin(far)))
    return p


def test_simplified(spark):
    rng = random.Random(2)
    rows = [(i, [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(rng.randint(3, 25))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>")
    for tol in (0.0, 1.0, 3.0):
        got = {r["id"]: [tuple(q) for q in r["s"]] for r in df.select("id", contours.simplified(F.col("p"), tol).alias("s")).collect()}
        assert got == {i: brute_simplified(p, tol) for i, p in rows}


def test_triangle_keeps_its_corners(rings, spark):
    n = rings.filter("id = 'H'").select(F.size(contours.simplified(F.col("points"), 1.0)).alias("n")).first()["n"]
    assert 12 <= n <= 16


def test_alignment(spark):
    a, w, h = np.zeros((9, 11), bool), 11, 9
    a[2:5, 3:7] = True
    cases = {"same": (a, 0, 0), "moved": (np.roll(a, (2, -3), (0, 1)), 3, -2), "empty": (np.zeros_like(a), 0, 0)}
    rows = [(k, a.ravel().tolist(), b.ravel().tolist()) for k, (b, *_) in cases.items()] + [("none", None, a.ravel().tolist())]
    df = spark.createDataFrame(rows, "id string, a array<boolean>, b array<boolean>")
    got = {r["id"]: r["s"] for r in df.select("id", rasters.aligned(F.col("a"), F.col("b"), w, h).alias("s")).collect()}
    assert {k: tuple(got[k])[:2] for k in cases} == {k: (dx, dy) for k, (_, dx, dy) in cases.items()}
    assert got["same"]["score"] == got["moved"]["score"] == 1 and tuple(got["empty"]) == tuple(got["none"]) == (0, 0, 0)
    # Full rows: all horizontal shifts that lose nothing are alike, so the first in order counts.
    bar = np.ones((1, 5), bool).ravel().tolist()
    (tie,) = spark.createDataFrame([(bar, bar)], "a array<boolean>, b array<boolean>").select(rasters.aligned(F.col("a"), F.col("b"), 5, 1).alias("s")).collect()
    assert tuple(tie["s"]) == (0, 0, 1)


def test_merge(spark):
    rows = [("k", [1.0, 0.0, 0.5, 0.5], 2, 2, 0, 0), ("k", [1.0, 1.0, 1.0, 1.0], 2, 2, 1, 0), ("k", [1.0], 1, 1, -1, 5), ("far", [1.0], 1, 1, 9, 9)]
    df = spark.createDataFrame(rows, "id string, alpha array<double>, w int, h int, dx int, dy int")
    assert {r["id"]: r["alpha"] for r in rasters.merged(df, "id", 3, 2).collect()} == {"k": [1, 0.5, 1, 0.5, 0.75, 1], "far": [0] * 6}


def test_crossings_of_long_edges(spark):
    """A star of long edges among many short ones, against all pairs."""
    rng = random.Random(6)
    p = [(rng.uniform(0, 900), rng.uniform(0, 900)) if i % 9 == 0 else (50 + i * 3 % 40, 60.0 + i % 7) for i in range(80)] + [(5.0, 5.0), (5.0, 400.0)]
    n = len(p)
    edges = [(1, i, n, *map(float, p[i]), *map(float, p[(i + 1) % n])) for i in range(n)]

    def side(e, x, y):
        return (e[5] - e[3]) * (y - e[4]) - (e[6] - e[4]) * (x - e[3])

    apart = lambda e, o: side(e, o[3], o[4]) * side(e, o[5], o[6]) < -1e-12
    want = sum(apart(a, b) and apart(b, a) for i, a in enumerate(edges) for j, b in enumerate(edges) if 1 < j - i < n - 1)
    df = spark.createDataFrame(edges, "id int, i int, n int, x double, y double, u double, v double")
    assert want > 20 and rasters.crossings_on_grid(df, "id").first()["n"] == want
