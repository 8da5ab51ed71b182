"""Outlines within a row against the same work step by step, and rows that raise."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.operators import contours, curves, isolated
from glyphmill.plans.records import isolated_glyphs

SIDE = 14


def drawn():
    """Rasters of noise, smooth and in two tones (where cells with two opposite corners inside abound), with ink at the border, blank and null."""
    rng = np.random.default_rng(11)
    rows = [(0, [0.0] * SIDE**2), (1, None)]
    for i in range(2, 2 * contours.ROWS + 5):
        v = rng.random((SIDE, SIDE))
        for _ in range(i % 3):
            v = (v + np.roll(v, 1, 0) + np.roll(v, 1, 1)) / 3
        v = np.round(v, i % 4)
        if i % 5:
            v[0] = v[-1] = v[:, 0] = v[:, -1] = 0
        rows.append((i, v.ravel().tolist()))
    return rows


def test_as_step_by_step(spark):
    """One row for each glyph with the rings, their direction and their cubics as by contour_segments, chained, nested and fitted; nothing is shuffled."""
    df = spark.createDataFrame(drawn(), "id int, alpha array<double>").repartition(1).withColumns({"w": F.lit(SIDE), "h": F.lit(SIDE)}).persist()
    for least in ((0.0, 0.0), (1.0, 4.0)):
        out = isolated.outlines(df, "id", *least)
        got = {r["id"]: r["contours"] for r in out.collect()}
        cells = df.select("id", curves.contour_segments(F.col("alpha"), SIDE, SIDE, 0.5).alias("s"))
        rings = contours.nested(contours.chained(cells, "id", "s"), "id", *least).select("id", "ring", contours.fitted(F.col("points")).alias("c"))
        want = {i: None for i, _ in drawn()}
        for r in sorted(rings.collect(), key=lambda r: (r["id"], r["ring"])):
            want[r["id"]] = (want[r["id"]] or []) + [r["c"]]
        assert got == want and sum(len(c or ()) for c in want.values()) > 4 * contours.ROWS
    df.unpersist()
    plan = isolated_glyphs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_row_that_raises():
    """Its error is its own: all others of the batch have their outlines, null ones neither."""

    def work(values):
        if (values == 7).any():
            raise KeyError("seven")
        return contours._outlined(values, 0.5, 1.0, 4.0, 1.0, np.pi / 4)

    box = np.zeros((6, 6))
    box[2:4, 1:5] = 1
    rows = pa.array([box.ravel().tolist(), [7.0] * 36, None, [0.0] * 36, box.ravel().tolist()], pa.list_(pa.float64()))
    got = contours._tried(rows, 6, 6, work).to_pylist()
    assert [r["failed"] for r in got] == [None, "KeyError", None, None, None]
    assert got[1]["contours"] is got[2]["contours"] is None and got[3]["contours"] == [] and got[0] == got[4] and len(got[0]["contours"]) == 1
    assert contours._tried(rows[:0], 6, 6, work).to_pylist() == []


def test_arcs_at_once_or_ring_by_ring():
    """Cubics of a ring don't depend on the rings that are fitted with it: small, empty, repeated and smooth ones."""
    rng = random.Random(5)
    rings = [np.array([(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(0, 20))], float).ravel() for _ in range(80)]
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    rings += [np.stack([r * np.cos(turn), (r + np.sin(3 * turn)) * np.sin(turn)], 1).ravel() for r in (2, 30, 300)]
    at_once = contours._fitted_rings(rings, 0.1, np.pi / 4)
    for ring, c in zip(rings, at_once):
        assert np.array_equal(c, np.array(contours._fitted(ring, 0.1, np.pi / 4)).reshape(-1, 4, 2)) and (len(c) > 0) == (len(ring) >= 8)
        assert np.array_equal(c[:, 3], np.roll(c[:, 0], -1, 0))
