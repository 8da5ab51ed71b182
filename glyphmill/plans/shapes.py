"""Queries of contours, alignment, corners and curves over `embeddings`, with their SQL: a vector is an 8 x 8 raster or a ring of 32 vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import contours, curves, rasters
from glyphmill.plans.catalog import CELLS_SQL, E64, _masks, _ring, oracle_sql, query
from glyphmill.session import table


def _alphas(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", rasters.rescaled(F.col("embedding").cast("array<double>")).alias("v"))


def _ring_of(spark, d, scale):
    p = F.transform(rasters.points(F.col("embedding")), lambda a: F.struct((a["x"] * scale).alias("x"), (a["y"] * scale).alias("y")))
    return table(spark, d, "embeddings").select("vec_id", p.alias("points"))


def _ring_sql(scale):
    return f"SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE * {scale} AS x, embedding[2 * i + 2]::DOUBLE * {scale} AS y FROM embeddings, range(32) t(i)"


@query(f"""WITH RECURSIVE b AS ({E64}), px AS (SELECT vec_id, i % 10 AS x, i // 10 AS y, CASE WHEN i % 10 BETWEEN 1 AND 8 AND i // 10 BETWEEN 1 AND 8 AND hi > lo THEN (CAST(e[(i // 10 - 1) * 8 + i % 10] AS DOUBLE) - lo) / (hi::DOUBLE - lo) ELSE 0 END AS v FROM b, range(100) t(i)),
  c AS (SELECT p.vec_id, p.x, p.y, p.v AS tl, q.v AS tr, r.v AS br, s.v AS bl FROM px p JOIN px q ON q.vec_id = p.vec_id AND q.x = p.x + 1 AND q.y = p.y JOIN px r ON r.vec_id = p.vec_id AND r.x = p.x + 1 AND r.y = p.y + 1 JOIN px s ON s.vec_id = p.vec_id AND s.x = p.x AND s.y = p.y + 1),
  m AS (SELECT vec_id, x, y, tl > 0.5 AS a, tr > 0.5 AS b, br > 0.5 AS c, bl > 0.5 AS d, (tl + tr + br + bl) / 4 > 0.5 AS j, [x + (0.5 - tl) / (tr - tl), y::DOUBLE] AS t, [x + 1.0::DOUBLE, y + (0.5 - tr) / (br - tr)] AS r, [x + (0.5 - bl) / (br - bl), y + 1.0::DOUBLE] AS o, [x::DOUBLE, y + (0.5 - tl) / (bl - tl)] AS l FROM c),
  g AS (SELECT vec_id, CASE WHEN a AND c AND NOT b AND NOT d THEN CASE WHEN j THEN [[t, r], [o, l]] ELSE [[t, l], [o, r]] END WHEN b AND d AND NOT a AND NOT c THEN CASE WHEN j THEN [[r, o], [l, t]] ELSE [[r, t], [l, o]] END
    WHEN a = b AND b = c AND c = d THEN [] ELSE [[CASE WHEN a AND NOT b THEN t WHEN b AND NOT c THEN r WHEN c AND NOT d THEN o ELSE l END, CASE WHEN NOT a AND b THEN t WHEN NOT b AND c THEN r WHEN NOT c AND d THEN o ELSE l END]] END AS s FROM m),
  s AS (SELECT vec_id, p[1][1] AS x, p[1][2] AS y, p[2][1] AS u, p[2][2] AS v, [round(p[1][1], 3), round(p[1][2], 3)] AS f, [round(p[2][1], 3), round(p[2][2], 3)] AS h FROM (SELECT vec_id, unnest(s) AS p FROM g)),
  w AS (SELECT vec_id, f AS home, h AS here FROM s UNION SELECT w.vec_id, w.home, s.h FROM w JOIN s ON s.vec_id = w.vec_id AND s.f = w.here),
  k AS (SELECT vec_id, home, min(here) AS ring FROM w GROUP BY ALL), e AS (SELECT s.*, k.ring FROM s JOIN k ON k.vec_id = s.vec_id AND k.home = s.f),
  a AS (SELECT vec_id, ring, sum(x * v - u * y) / 2 AS area, arg_min(x, [x, y]) AS px, arg_min(y, [x, y]) AS py FROM e GROUP BY ALL HAVING abs(sum(x * v - u * y)) / 2 >= 1 AND sum(sqrt((u - x) ** 2 + (v - y) ** 2)) >= 4),
  h AS (SELECT a.vec_id, a.ring, a.area, count(*) FILTER (n % 2 = 1) AS depth FROM a LEFT JOIN (SELECT a.vec_id, a.ring, e.ring AS other, count(*) FILTER ((e.y > a.py) <> (e.v > a.py) AND a.px < (e.u - e.x) * (a.py - e.y) / (e.v - e.y) + e.x) AS n
    FROM a JOIN e ON e.vec_id = a.vec_id AND e.ring <> a.ring JOIN a o ON o.vec_id = e.vec_id AND o.ring = e.ring GROUP BY ALL) z USING (vec_id, ring) GROUP BY ALL)
  SELECT vec_id, count(*) AS rings, count(*) FILTER (depth % 2 = 1) AS holes, CAST(max(depth) AS INTEGER) AS deepest, round(sum(CASE WHEN depth % 2 = 1 THEN -abs(area) ELSE abs(area) END), 2) AS ink FROM h GROUP BY vec_id""")
def contour_rings(spark, d):
    """Rings of each vector as a raster with an empty border: how many, holes among them, nesting, and the area within."""
    cells = _alphas(spark, d).select("vec_id", rasters.padded(F.col("v"), 8, 8).alias("v"))
    cells = cells.select("vec_id", curves.contour_segments(F.col("v"), 10, 10, 0.5).alias("s"))
    rings = contours.nested(contours.chained(cells, "vec_id", "s"), "vec_id")
    return rings.groupBy("vec_id").agg(F.count("*").alias("rings"), F.count_if(F.col("area") < 0).alias("holes"), F.max("depth").alias("deepest"), F.round(F.sum("area"), 2).alias("ink"))


MOVED_SQL = f"{CELLS_SQL}, o AS (SELECT vec_id, x + vec_id % 5 - 2 AS x, y + vec_id % 3 - 1 AS y FROM k WHERE m AND x + vec_id % 5 - 2 BETWEEN 0 AND 7 AND y + vec_id % 3 - 1 BETWEEN 0 AND 7), r AS (SELECT vec_id, x, y FROM k WHERE m)"


@query(f"""{MOVED_SQL}, seed AS (SELECT vec_id, CAST(round_even(r.x - o.x, 0) AS INTEGER) AS sx, CAST(round_even(r.y - o.y, 0) AS INTEGER) AS sy FROM (SELECT vec_id, avg(x) AS x, avg(y) AS y FROM r GROUP BY vec_id) r JOIN (SELECT vec_id, avg(x) AS x, avg(y) AS y FROM o GROUP BY vec_id) o USING (vec_id)),
  t AS (SELECT vec_id, sx + i AS dx, sy + j AS dy FROM seed, range(-4, 5) a(i), range(-4, 5) b(j)), q AS (SELECT t.vec_id, dx, dy, count(o.x) AS moved, count(r.x) AS common FROM t LEFT JOIN o ON o.vec_id = t.vec_id AND o.x + dx BETWEEN 0 AND 7 AND o.y + dy BETWEEN 0 AND 7
    LEFT JOIN r ON r.vec_id = t.vec_id AND r.x = o.x + dx AND r.y = o.y + dy GROUP BY ALL), i AS (SELECT q.*, common / (moved + n - common) AS score FROM q JOIN (SELECT vec_id, count(*) AS n FROM r GROUP BY vec_id) USING (vec_id)),
  best AS (SELECT vec_id, dx, dy, round(score, 9) AS score FROM i QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, dy, dx) = 1)
  SELECT e.vec_id, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(score, 0) AS score FROM embeddings e LEFT JOIN best USING (vec_id)""")
def aligned_masks(spark, d):
    """Each vector's mask against itself moved by up to two pixels, what leaves the frame being lost."""
    m = F.col("m")
    moved = F.coalesce(*[F.when((F.col("vec_id") % 5 == i) & (F.col("vec_id") % 3 == j), rasters.shifted(m, 8, 8, i - 2, j - 1)) for i in range(5) for j in range(3)])
    e = _masks(spark, d).select("vec_id", "m", moved.alias("o")).select("vec_id", rasters.aligned(m, F.col("o"), 8, 8).alias("a"))
    return e.select("vec_id", "a.dx", "a.dy", F.round("a.score", 9).alias("score"))


@query(f"""WITH b AS (SELECT vec_id, label, embedding AS e, list_min(embedding) AS lo, list_max(embedding) AS hi FROM embeddings), k AS (SELECT label, i % 8 + vec_id % 9 - 4 AS x, i // 8 + vec_id % 7 - 5 AS y, CASE WHEN hi > lo THEN (CAST(e[i + 1] AS DOUBLE) - lo) / (hi::DOUBLE - lo) ELSE 0 END AS v FROM b, range(64) t(i)),
  m AS (SELECT label, x, y, avg(v) AS v FROM k WHERE x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 7 GROUP BY ALL) SELECT label, round(sum(v), 6) AS total, round(sum(v * (y * 10 + x + 1)), 5) AS weighted FROM m GROUP BY label""")
def merged_alpha(spark, d):
    """One raster of 10 x 8 for each label: its vectors laid over each other at offsets."""
    seen = _alphas(spark, d).select("label", F.col("v").alias("alpha"), F.lit(8).alias("w"), F.lit(8).alias("h"), (F.col("vec_id") % 9 - 4).alias("dx"), (F.col("vec_id") % 7 - 5).alias("dy"))
    out = rasters.merged(seen, "label", 10, 8)
    return out.select("label", F.round(rasters.total(F.col("alpha")), 6).alias("total"), F.round(rasters.total(F.transform("alpha", lambda v, i: v * (i + 1))), 5).alias("weighted"))


@query(f"""WITH p AS ({_ring_sql(4)}), s AS (SELECT p.*, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d FROM p JOIN p q ON q.vec_id = p.vec_id AND q.i = (p.i + 1) % 32),
  w AS (SELECT vec_id, least(greatest(2, CAST(round_even(4 / greatest(median(d), 1e-6), 0) AS INTEGER)), 10) AS w, sum(d) AS whole FROM s GROUP BY vec_id),
  v AS (SELECT p.vec_id, p.i, p.x - a.x AS ux, p.y - a.y AS uy, c.x - p.x AS vx, c.y - p.y AS vy FROM p JOIN w USING (vec_id) JOIN p a ON a.vec_id = p.vec_id AND a.i = (p.i - w + 32) % 32 JOIN p c ON c.vec_id = p.vec_id AND c.i = (p.i + w) % 32),
  t AS (SELECT vec_id, i, CASE WHEN sqrt(ux * ux + uy * uy) > 1e-9 AND sqrt(vx * vx + vy * vy) > 1e-9 THEN acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))))) ELSE 0 END AS t FROM v),
  k AS (SELECT t.vec_id, t.i, t.t FROM t JOIN t o ON o.vec_id = t.vec_id AND (o.i - t.i + 35) % 32 <= 6 WHERE t.t > pi() / 6 GROUP BY ALL HAVING t.t >= max(o.t) - 1e-12),
  a AS (SELECT k.*, coalesce((SELECT sum(d) FROM s WHERE s.vec_id = k.vec_id AND s.i < k.i), 0) AS place FROM k),
  g AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY place) AS g FROM (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY vec_id ORDER BY place) >= 8 THEN 1 ELSE 0 END AS n FROM a)),
  z AS (SELECT g.*, max(g) OVER p AS last, whole - max(place) OVER p + min(place) OVER p AS gap, whole FROM g JOIN w USING (vec_id) WINDOW p AS (PARTITION BY vec_id)),
  y AS (SELECT vec_id, i, t, CASE WHEN last > 0 AND gap < 8 AND g = last THEN 0 ELSE g END AS g, CASE WHEN last > 0 AND gap < 8 AND g = last THEN place - whole ELSE place END AS o FROM z)
  SELECT vec_id, count(*) AS corners, CAST(sum(i) AS BIGINT) AS places, round(sum(t), 6) AS turned FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY vec_id, g ORDER BY t DESC, o) = 1) GROUP BY vec_id""")
def ring_corners(spark, d):
    """Corners of each vector's ring after suppression and merging around the start."""
    got = contours.corners(_ring_of(spark, d, 4), ["vec_id"])
    return got.groupBy("vec_id").agg(F.count("*").alias("corners"), F.sum("i").alias("places"), F.round(F.sum("angle"), 6).alias("turned"))


_D = "sqrt((xs[k[i]] - (ax + t * (bx - ax))) ** 2 + (ys[k[i]] - (ay + t * (by_ - ay))) ** 2)"


@query(f"""WITH RECURSIVE s AS (SELECT vec_id, list_transform(range(32), lambda i: embedding[2 * i + 1]::DOUBLE * 4) AS xs, list_transform(range(32), lambda i: embedding[2 * i + 2]::DOUBLE * 4) AS ys, range(1, 33) AS k FROM embeddings
  UNION ALL SELECT vec_id, xs, ys, list_filter(k, lambda v, j: j <> worst) FROM (SELECT *, list_position(ds, list_min(ds)) AS worst, list_min(ds) AS least FROM (SELECT vec_id, xs, ys, k, list_transform(list_transform(range(1, len(k) + 1), lambda i: {{'p': k[i], 'a': k[(i - 2 + len(k)) % len(k) + 1], 'b': k[i % len(k) + 1]}}),
    lambda q: sqrt((xs[q.p] - xs[q.a] - greatest(0, least(1, ((xs[q.p] - xs[q.a]) * (xs[q.b] - xs[q.a]) + (ys[q.p] - ys[q.a]) * (ys[q.b] - ys[q.a])) / ((xs[q.b] - xs[q.a]) ** 2 + (ys[q.b] - ys[q.a]) ** 2))) * (xs[q.b] - xs[q.a])) ** 2
    + (ys[q.p] - ys[q.a] - greatest(0, least(1, ((xs[q.p] - xs[q.a]) * (xs[q.b] - xs[q.a]) + (ys[q.p] - ys[q.a]) * (ys[q.b] - ys[q.a])) / ((xs[q.b] - xs[q.a]) ** 2 + (ys[q.b] - ys[q.a]) ** 2))) * (ys[q.b] - ys[q.a])) ** 2)) AS ds FROM s)) WHERE len(k) > 4 AND least < 3)
  SELECT vec_id, CAST(len(k) AS INTEGER) AS left_, round(list_sum(list_transform(k, lambda j, i: xs[j] * i + ys[j])), 5) AS weighted FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(k)) = 1""")
def simplified_rings(spark, d):
    """Rings after greedy removal of vertices less than 3 from their neighbours' chord."""
    e = _ring_of(spark, d, 4).select("vec_id", contours.simplified(F.col("points"), 3.0).alias("p"))
    return e.select("vec_id", F.size("p").alias("left_"), F.round(rasters.total(F.transform("p", lambda a, i: a["x"] * (i + 1) + a["y"])), 5).alias("weighted"))


def _halves(c):
    """SQL of both halves of a cubic in one coordinate."""
    a, b, e, f = (f"{c}{i}" for i in range(4))
    m = f"(({a} + {b}) / 2 + ({b} + {e}) / 2) / 2", f"(({b} + {e}) / 2 + ({e} + {f}) / 2) / 2"
    mid = f"({m[0]} + {m[1]}) / 2"
    return [(a, mid), (f"({a} + {b}) / 2", m[1]), (m[0], f"({e} + {f}) / 2"), (mid, f)]


_OFF = " ".join(f"greatest({', '.join(f'CASE WHEN sqrt((x3 - x0) ** 2 + (y3 - y0) ** 2) < 1e-6 THEN sqrt((x{k} - x0) ** 2 + (y{k} - y0) ** 2) ELSE abs((x3 - x0) * (y{k} - y0) - (y3 - y0) * (x{k} - x0)) / sqrt((x3 - x0) ** 2 + (y3 - y0) ** 2) END' for k in (1, 2))})".split())
_HALVED = ", ".join(f"CASE WHEN side = 0 THEN {a} ELSE {b} END AS {c}{i}" for c in "xy" for i, (a, b) in enumerate(_halves(c)))


@query(f"""WITH RECURSIVE c AS (SELECT vec_id, c, 0::DOUBLE AS t, 0 AS depth, {', '.join(f'embedding[8 * c + {2 * i + j + 1}]::DOUBLE * 4 AS {v}{i}' for j, v in enumerate('xy') for i in range(4))} FROM embeddings, range(8) r(c)
  UNION ALL SELECT vec_id, c, t + side * 0.5 ** (depth + 1), depth + 1, {_HALVED} FROM c, range(2) h(side) WHERE {_OFF} > 0.25 AND depth < 20),
  e AS (SELECT vec_id, x3, y3, row_number() OVER (PARTITION BY vec_id ORDER BY c, t) AS i FROM c WHERE NOT ({_OFF} > 0.25 AND depth < 20))
  SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(x3 * i + y3), 3) AS weighted FROM e GROUP BY vec_id""")
def flattened_cubics(spark, d):
    """Each vector as eight cubics, flattened to within 0.25."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 4).alias("v"))
    e = e.select("vec_id", contours.flattened(contours.four(F.col("v"))).alias("p"))
    return e.select("vec_id", F.size("p").alias("n"), F.round(rasters.total(F.transform("p", lambda a, i: a["x"] * (i + 1) + a["y"])), 3).alias("weighted"))


@query("SELECT vec_id, true AS whole, true AS joined, true AS within FROM embeddings")
def fitted_rings(spark, d):
    """Each vector as radii of a ring of 64 vertices, fitted by cubics: each begins where the one before ends, and no vertex lies over 1.5 from the curve."""
    turn = lambda i: 2 * 3.141592653589793 * i / 64
    p = F.transform("embedding", lambda r, i: F.struct(((60 + r) * F.cos(turn(i))).alias("x"), ((60 + r) * F.sin(turn(i))).alias("y")))
    e = table(spark, d, "embeddings").select("vec_id", contours.checked_fit(p).alias("r")).select("vec_id", F.col("r.cubics").alias("c"), F.col("r.far").alias("far"))
    after = lambda i: F.get(F.get(F.col("c"), F.pmod(i + 1, F.size("c"))), F.lit(0))
    same = F.forall(F.sequence(F.lit(0), F.size("c") - 1), lambda i: F.get(F.get(F.col("c"), i), F.lit(3)) == after(i))
    return e.select("vec_id", (F.size("c") >= 4).alias("whole"), same.alias("joined"), (F.col("far") <= 1.5).alias("within"))


def _edges(spark, d):
    e = _ring(spark, d).select("vec_id", F.size("p").alias("n"), "p", F.posexplode("p").alias("i", "a"))
    after = F.get("p", (F.col("i") + 1) % F.col("n"))
    return e.select("vec_id", "i", "n", F.col("a.x").alias("x"), F.col("a.y").alias("y"), after["x"].alias("u"), after["y"].alias("v"))


@query(oracle_sql()["rasterized_ink"])
def rasterized_spans(spark, d):
    """Ink of each vector's ring on 16 x 16 pixels, by the runs of its rows."""
    got = rasters.spans(_edges(spark, d), "vec_id", 16, 16).groupBy("vec_id").agg(F.sum(F.col("x1") - F.col("x0")).cast("int").alias("ink"))
    return table(spark, d, "embeddings").select("vec_id").join(got, "vec_id", "left").select("vec_id", F.coalesce("ink", F.lit(0)).alias("ink"))


@query(oracle_sql()["self_crossings"])
def grid_crossings(spark, d):
    """Proper crossings of each vector's ring on a grid that fits its edges."""
    return rasters.crossings_on_grid(_edges(spark, d), "vec_id")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 1000 / (64 * l_linenumber), 6) AS ux, round((51.2 * l_linenumber - l_tax * 500) * 1000 / (64 * l_linenumber), 6) AS uy, round(l_quantity, 6) AS px, round(l_tax * 500, 6) AS py FROM lineitem""")
def unit_transforms(spark, d):
    """Order lines as pixels in cells of several sizes, to font units and back."""
    size, x, y = F.col("l_linenumber") * 64.0, F.col("l_quantity"), F.col("l_tax") * 500
    rows = table(spark, d, "lineitem").withColumn("u", rasters.to_units(x, y, size, rasters.baseline(size)))
    rows = rows.withColumn("p", rasters.to_pixels(F.col("u.x"), F.col("u.y"), size, rasters.baseline(size)))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"{s}.{c}", 6).alias(f"{s}{c}") for s in "up" for c in "xy"])


@query(f"""WITH b AS ({E64}), k AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CASE WHEN hi > lo THEN (CAST(e[i + 1] AS DOUBLE) - lo) / (hi::DOUBLE - lo) ELSE 0 END AS v FROM b, range(64) t(i)),
  m AS (SELECT a.vec_id, a.x, a.y, sum(b.v * (1 - abs(b.x - (a.x - (a.vec_id % 7 - 3) / 4))) ) AS v FROM k a JOIN k b ON b.vec_id = a.vec_id AND b.y = a.y AND abs(b.x - (a.x - (a.vec_id % 7 - 3) / 4)) < 1 GROUP BY ALL),
  f AS (SELECT k.vec_id, k.x, k.y, coalesce(m.v, 0) AS v FROM k LEFT JOIN m USING (vec_id, x, y)),
  n AS (SELECT a.vec_id, a.x, a.y, sum(b.v * (1 - abs(b.y - (a.y - 0.25)))) AS v FROM f a JOIN f b ON b.vec_id = a.vec_id AND b.x = a.x AND abs(b.y - (a.y - 0.25)) < 1 GROUP BY ALL)
  SELECT vec_id, round(sum(v), 6) AS total, round(sum(v * (y * 8 + x + 1)), 5) AS weighted FROM n GROUP BY vec_id""")
def nudged_rasters(spark, d):
    """Vectors as rasters, moved by quarters of a pixel to the side and a quarter down."""
    e = _alphas(spark, d).select("vec_id", "v", ((F.col("vec_id") % 7 - 3) / 4).alias("dx"), F.lit(0.25).alias("dy"))
    e = e.select("vec_id", "dy", rasters.nudged(F.col("v"), 8, 8, F.col("dx"), "x").alias("v")).select("vec_id", rasters.nudged(F.col("v"), 8, 8, F.col("dy"), "y").alias("v"))
    return e.select("vec_id", F.round(rasters.total(F.col("v")), 6).alias("total"), F.round(rasters.total(F.transform("v", lambda v, i: v * (i + 1))), 5).alias("weighted"))
