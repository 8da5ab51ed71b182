"""Rings of contours: segments chained to closed rings, nesting, corners, simplification, and cubics fitted to them.

A ring is a row (key, ring, points) with points an array of x, y without the closing one; y grows downwards. What needs
an order of its own within one ring (chaining, removal of vertices, splits of a fit) is a small kernel over Arrow
batches; everything between rings, and all choices among them, are joins, windows and expressions.
"""

from __future__ import annotations

from collections import defaultdict
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.rasters import _ring, perimeter, signed_area, total

#: Rings below either are noise.
LEAST_AREA, LEAST_PERIMETER = 1.0, 4.0
#: Corners: arc length of the window on either side, least angle, neighbours suppressed, arc length within which corners merge.
WINDOW_PX, LEAST_TURN, NEIGHBOURS, MERGE_PX = 4.0, np.pi / 6, 3, 8.0
#: A cubic is split no deeper than this.
FIT_DEPTH, FLAT_DEPTH = 12, 20


def _flat(segments: Column, *fields: str) -> Column:
    return F.flatten(F.transform(segments, lambda s: F.array(*[s[f] for f in fields])))


def _nodes(ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for each end, the same for those of one row that agree to three decimals."""
    x, y = np.round(ends, 3).T
    order = np.lexsort((y, x, row))
    new = np.any([np.diff(c[order], prepend=c[order[:1]]) != 0 for c in (x, y, row)], 0)
    out = np.empty(len(ends), int)
    out[order] = np.cumsum(new)
    return out


def _chained(flat: np.ndarray) -> list[np.ndarray]:
    """Rings of segments (x, y, u, v, x, ...): ends meet if they agree to three decimals; the first unused segment leads on.

    A segment that begins where the walk stands goes before one that ends there, so segments with a direction keep it.
    """
    ends = np.asarray(flat, float).reshape(-1, 2)
    return _walked(ends, _nodes(ends, np.zeros(len(ends), int)).tolist())


def _walked(ends: np.ndarray, node: list[int]) -> list[np.ndarray]:
    """_chained from the ends of segments and the numbers of the nodes that they lie in."""
    waiting = [defaultdict(list), defaultdict(list)]
    for half in range(len(node) - 1, -1, -1):
        waiting[half & 1][node[half]].append(half)
    free, loops = [True] * (len(node) // 2), []
    for segment in range(len(free)):
        if not free[segment]:
            continue
        free[segment], path, half = False, [2 * segment], 2 * segment + 1
        while node[half] != node[path[0]]:
            for stack in (waiting[0][node[half]], waiting[1][node[half]]):
                while stack and not free[stack[-1] >> 1]:
                    stack.pop()
                if stack:
                    break
            else:
                path = []
                break
            path.append(stack.pop())
            free[path[-1] >> 1] = False
            half = path[-1] ^ 1
        if path:
            loops.append(path)
    return [ring for ring in _joined(ends, node, loops) if len(ring) >= 6]


def _joined(ends: np.ndarray, node: list[int], loops: list[list[int]]) -> list[np.ndarray]:
    """Points of closed walks (the ends at which their segments begin); walks that meet in a node are one ring.

    Wherever a walk comes to a node of another, that one is gone round first, so that a ring has all segments of its walks,
    whichever the walk began with. Where ends in such a node aren't the same point, both stay.
    """
    visits = defaultdict(list)
    for k, loop in enumerate(loops):
        for i, half in enumerate(loop):
            visits[node[half]].append((k, i))
    meeting = {n for n, v in visits.items() if len(v) > 1}
    if not meeting:
        return [ends[loop].ravel() for loop in loops]
    out, taken = [], [False] * len(loops)
    for k, loop in enumerate(loops):
        if taken[k]:
            continue
        taken[k], ring, stack = True, [], [iter(loop)]
        while stack:
            half = next(stack[-1], None)
            if half is None:
                stack.pop()
                continue
            there = visits[node[half]]
            while there and taken[there[-1][0]]:
                there.pop()
            if not there:
                ring.append(half)
                continue
            other, i = there.pop()
            taken[other] = True
            stack += [iter([half]), iter(loops[other][i:] + loops[other][:i])]
        path = []
        for half, after in zip(ring, ring[1:] + ring[:1]):
            path.append(half)
            if node[after] in meeting and (ends[half ^ 1] != ends[after]).any():
                path.append(half ^ 1)
        out.append(ends[path].ravel())
    return out


def _pairs() -> np.ndarray:
    """By which corners of a cell are inside (bits: clockwise from the top left) and whether its mean is: up to two segments from a side to a side, -1 for none."""
    out = np.full((16, 2, 2, 2), -1)
    for kind in range(16):
        corner = [bool(kind >> i & 1) for i in range(4)]
        leave, enter = ([i for i in range(4) if corner[i] == a and corner[(i + 1) % 4] != a] for a in (True, False))
        for mean in range(2):
            for j, pair in enumerate(zip(leave, enter if len(leave) < 2 or corner[0] == bool(mean) else enter[::-1])):
                out[kind, mean, j] = pair
    return out


_PAIRS = _pairs()


def _segments(values: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """curves.contour_segments of rasters (rasters, h, w): the same segments (x, y, u, v) in the same order, and where those of each raster begin.

    Only cells on a contour are looked at by numbers.
    """
    over = (values > level).astype(np.uint8)
    kind = over[:, :-1, :-1] + 2 * over[:, :-1, 1:] + 4 * over[:, 1:, 1:] + 8 * over[:, 1:, :-1]
    row, y, x = np.nonzero((kind > 0) & (kind < 15))
    tl, tr, br, bl = (values[row, y + dy, x + dx] for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)))
    cut = lambda a, b: np.divide(level - a, b - a, out=np.full(len(a), 0.5), where=a != b)
    sides = np.array([[x + cut(tl, tr), y], [x + 1, y + cut(tr, br)], [x + cut(bl, br), y + 1], [x, y + cut(tl, bl)]], float)
    pairs = _PAIRS[kind[row, y, x], ((tl + tr + br + bl) / 4 > level).astype(int)]
    cell, j = np.nonzero(pairs[:, :, 0] >= 0)
    leave, enter = pairs[cell, j].T
    found = np.concatenate([sides[leave, :, cell], sides[enter, :, cell]], 1)
    long = np.hypot(found[:, 2] - found[:, 0], found[:, 3] - found[:, 1]) > 1e-9
    row, found = row[cell][long], found[long]
    return found, np.searchsorted(row, np.arange(len(values) + 1))


#: Pairs of rings, and of points and edges, that are looked at at once.
AT_ONCE = 1 << 20


def _some(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of sizes in order, in parts of which each has AT_ONCE or little more, unless one alone has."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i in turn count[i] numbers from begin[i] on, beside i."""
    i = np.repeat(np.arange(len(count)), count)
    return i, begin[i] + np.arange(len(i)) - (np.cumsum(count) - count)[i]


def _nested(rows: list[list[np.ndarray]], least_area: float, least_perimeter: float) -> list[list[np.ndarray]]:
    """nested() of the rings of each row, flat: those that aren't noise, in the direction that their depth asks for."""
    rings = [r.reshape(-1, 2) for some in rows for r in some]
    if not rings:
        return [[] for _ in rows]
    row, size = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.array(list(map(len, rings)))
    start, a = np.cumsum(size) - size, np.concatenate(rings)
    of = np.repeat(np.arange(len(rings)), size)
    b = a[start[of] + (np.arange(len(a)) - start[of] + 1) % size[of]]
    (ax, ay), (bx, by) = a.T, b.T
    terms = np.stack([ax * by - bx * ay, np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))])
    sums = np.zeros((2, len(rings)))
    for m in np.unique(size):  # in the order of the points, as an expression adds them
        sums[:, size == m] = np.cumsum(terms[:, start[size == m, None] + np.arange(m)], 2)[:, :, -1]
    area = sums[0] / 2
    kept = np.flatnonzero((np.abs(area) >= least_area) & (sums[1] >= least_perimeter))
    first = a[np.lexsort((ay, ax, of))[start]]
    lo, hi = np.minimum.reduceat(a, start), np.maximum.reduceat(a, start)
    begin, end = (np.searchsorted(row[kept], row[kept], side) for side in ("left", "right"))
    depth = np.zeros(len(rings), int)
    for some in _some(end - begin):
        probe, other = _spread(begin[some], (end - begin)[some])
        probe, other = kept[some[probe]], kept[other]
        p = first[probe]
        near = (probe != other) & (p >= lo[other]).all(1) & (p <= hi[other]).all(1)
        probe, other = probe[near], other[near]
        for part in _some(size[other]):
            pair, edge = _spread(start[other[part]], size[other[part]])
            x, y = first[probe[part]][pair].T
            across = (ay[edge] > y) != (by[edge] > y)
            pair, edge, x, y = pair[across], edge[across], x[across], y[across]
            cuts = x < (bx[edge] - ax[edge]) * (y - ay[edge]) / (by[edge] - ay[edge]) + ax[edge]
            odd = np.bincount(pair[cuts], minlength=len(part)) % 2 == 1
            depth += np.bincount(probe[part][odd], minlength=len(rings))
    turned = (depth % 2 == 0) != (area > 0)
    out = [[] for _ in rows]
    for i in kept.tolist():
        out[row[i]].append((rings[i][::-1] if turned[i] else rings[i]).ravel())
    return out


POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _points(rows: list[np.ndarray | None]) -> pa.Array:
    """Arrow lists of x, y from arrays of two columns."""
    flat = np.concatenate([np.zeros((0, 2)), *[r.reshape(-1, 2) for r in rows if r is not None]])
    ends = np.cumsum([0, *[0 if r is None else r.size // 2 for r in rows]])
    xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), xy, mask=pa.array([r is None for r in rows]) if any(r is None for r in rows) else None)


#: Rows whose results are Python objects at once.
ROWS = 256


def _by_rows(some):
    """An Arrow function over ROWS rows of a batch at a time: beside a batch and its result, a task holds the objects of so many rows."""
    return lambda *columns: pa.concat_arrays([some(*[c.slice(i, ROWS) for c in columns]) for i in range(0, max(len(columns[0]), 1), ROWS)])


def _kernel(f, lines: bool = False):
    """An Arrow UDF over flat arrays of numbers: f gives one array of points, or, if lines, a list of such arrays."""

    def some(flat: pa.Array) -> pa.Array:
        out = [f(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in flat]
        if not lines:
            return _points(out)
        ends = np.cumsum([0, *[len(o or ()) for o in out]])
        mask = pa.array([o is None for o in out]) if any(o is None for o in out) else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _points([r for o in out for r in o or ()]), mask=mask)

    return F.arrow_udf(_by_rows(some), T.ArrayType(POINTS) if lines else POINTS)


def chained(rows: DataFrame, key: str, segments: str) -> DataFrame:
    """key, ring, points: the closed rings of each row's segments (array<struct<x, y, u, v>>), ring numbers from 0.

    Open chains are dropped, and so are rings of fewer than three points. Closed chains that meet in a point are one ring. A null
    or empty array has no rings.
    """
    run = _kernel(_chained, lines=True)
    return rows.select(key, F.posexplode(run(_flat(F.col(segments), "x", "y", "u", "v"))).alias("ring", "points"))


def inside(p: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in the closed polyline p by even-odd crossings; edges count half-open in y."""
    cuts = _ring(p, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(cuts, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def nested(rings: DataFrame, key: str, least_area: float = LEAST_AREA, least_perimeter: float = LEAST_PERIMETER) -> DataFrame:
    """rings that aren't noise, with depth, area and perimeter: at even depth the area is positive (outer), at odd negative (hole).

    depth counts the other rings of the key around a ring's leftmost point. Only rings whose box holds that point are looked at.
    """
    at = lambda c, f: f(F.transform("points", lambda p: p[c]))
    df = rings.withColumns({"area": signed_area(F.col("points")), "perimeter": perimeter(F.col("points"))})
    df = df.filter((F.abs("area") >= least_area) & (F.col("perimeter") >= least_perimeter))
    box = {f"{side}{c}": at(c, f) for c in "xy" for side, f in (("lo_", F.array_min), ("hi_", F.array_max))}
    around = df.select(key, F.col("ring").alias("other"), F.col("points").alias("shape")).withColumns({n: F.expr(f"array_{'min' if n[0] == 'l' else 'max'}(transform(shape, p -> p.{n[-1]}))") for n in box})
    probes = df.select(key, "ring", F.array_min("points").alias("p"))
    near = (F.col("ring") != F.col("other")) & F.col("p.x").between(F.col("lo_x"), F.col("hi_x")) & F.col("p.y").between(F.col("lo_y"), F.col("hi_y"))
    held = probes.join(around, key).filter(near).filter(inside(F.col("shape"), F.col("p.x"), F.col("p.y")))
    depth = held.groupBy(key, "ring").agg(F.count("*").cast("int").alias("depth"))
    out = df.join(depth, [key, "ring"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    turned = (F.col("depth") % 2 == 0) != (F.col("area") > 0)
    return out.select(key, "ring", "depth", F.when(turned, F.reverse("points")).otherwise(F.col("points")).alias("points"), F.when(turned, -F.col("area")).otherwise(F.col("area")).alias("area"), "perimeter")


def _steps(p: Column) -> Column:
    return _ring(p, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def window_size(steps: Column, window: float = WINDOW_PX) -> Column:
    """Vertices that make up a window of arc length by the median step: 2 at least, a third of the ring at most."""
    n, s = F.size(steps), F.array_sort(steps)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.least(F.greatest(F.lit(2), F.rint(window / F.greatest(median, F.lit(1e-6))).cast("int")), F.floor(n / 3).cast("int"))


def windowed_turns(p: Column, w: Column) -> Column:
    """Turning angle (radians) at each vertex between the directions from w vertices before and to w after it.

    0 for rings of fewer than six vertices and beside directions without length. p and w should be columns: they are read
    at every vertex.
    """
    n = F.size(p)

    def angle(i: Column) -> Column:
        a, b, c = F.get(p, F.pmod(i - w, n)), F.get(p, i), F.get(p, F.pmod(i + w, n))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        sizes = F.hypot(ux, uy) * F.hypot(vx, vy)
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / sizes))
        return F.when((n >= 6) & (F.hypot(ux, uy) > 1e-9) & (F.hypot(vx, vy) > 1e-9), F.acos(cos)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), n - 1), angle)


def corners(rings: DataFrame, keys: list[str], points_: str = "points") -> DataFrame:
    """keys, i, angle: the corner vertices of each ring.

    A corner turns by more than LEAST_TURN and by no less than its NEIGHBOURS on either side. Corners closer than MERGE_PX of
    arc length, around the start too, are one: the sharpest, the first along the ring among equals.
    """
    df = rings.select(*keys, F.col(points_).alias("p")).withColumn("d", _steps(F.col("p"))).withColumn("w", window_size(F.col("d")))
    df = df.withColumn("t", windowed_turns(F.col("p"), F.col("w")))
    n = F.size("p")
    peak = lambda i: F.array_max(F.transform(F.sequence(F.lit(-NEIGHBOURS), F.lit(NEIGHBOURS)), lambda o: F.get("t", F.pmod(i + o, n))))
    chosen = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("t", i) > LEAST_TURN) & (F.get("t", i) >= peak(i) - 1e-12))
    rows = df.withColumn("i", F.explode(chosen)).select(*keys, "i", F.get("t", F.col("i")).alias("angle"), total(F.slice("d", F.lit(1), F.col("i"))).alias("at"), total(F.col("d")).alias("whole"))
    w = Window.partitionBy(*keys).orderBy("at", "i")
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(w) >= MERGE_PX).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(w))
    rows = rows.withColumns({"last": F.max("island").over(whole), "gap": F.col("whole") - F.max("at").over(whole) + F.min("at").over(whole)})
    wraps = (F.col("last") > 0) & (F.col("gap") < MERGE_PX) & (F.col("island") == F.col("last"))
    rows = rows.withColumns({"island": F.when(wraps, 0).otherwise(F.col("island")), "turn": F.when(wraps, F.col("at") - F.col("whole")).otherwise(F.col("at"))})
    best = F.struct(F.col("angle"), -F.col("turn"))
    return rows.groupBy(*keys, "island").agg(F.max_by("i", best).alias("i"), F.max("angle").alias("angle")).drop("island")


def _deviation(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    d = b - a
    sq = float(d @ d)
    t = min(max(float((p - a) @ d) / sq, 0.0), 1.0) if sq >= 1e-12 else 0.0
    return float(np.hypot(*(p - a - t * d)))


def _simplified(flat: np.ndarray, tol: float) -> np.ndarray:
    """Vertices left when the one nearest to the chord of its neighbours goes again and again, while nearer than tol.

    A heap of (deviation, vertex): a removal changes two entries, so a ring of n takes n log n. Entries of a vertex whose
    neighbours have changed are passed over.
    """
    p = np.asarray(flat, float).reshape(-1, 2)
    n = len(p)
    if n <= 4 or tol <= 0:
        return p.ravel()
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    now = [_deviation(p[i], p[before[i]], p[after[i]]) for i in range(n)]
    heap, left = [(d, i) for i, d in enumerate(now)], n
    heapq.heapify(heap)
    while heap and left > 4 and heap[0][0] < tol:
        d, i = heapq.heappop(heap)
        if now[i] != d:
            continue
        a, b = before[i], after[i]
        now[i], after[a], before[b], left = None, b, a, left - 1
        for j in (a, b):
            now[j] = _deviation(p[j], p[before[j]], p[after[j]])
            heapq.heappush(heap, (now[j], j))
    return p[[i for i in range(n) if now[i] is not None]].ravel()


def simplified(p: Column, tol: float) -> Column:
    """A ring of points without the vertices that greedy removal takes; four are left at least. Ties go to the first vertex."""
    return _kernel(lambda f: _simplified(f, tol))(_flat(p, "x", "y"))


def _unit(v: np.ndarray, other: np.ndarray = np.array([1.0, 0.0])) -> np.ndarray:
    """Rows of v by their length; other where a row has none."""
    size = np.hypot(*v.T)[:, None]
    return np.where(size >= 1e-12, v / np.where(size >= 1e-12, size, 1), other)


def _weights(t: np.ndarray) -> list[np.ndarray]:
    """The four Bernstein weights at each t."""
    u = 1 - t
    return [u**3, 3 * u * u * t, 3 * u * t * t, t**3]


def _on(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points of each cubic of c at its row of t."""
    return sum(w[..., None] * c[:, i, None] for i, w in enumerate(_weights(t)))


def _handles(p: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each arc of p (arcs, points, 2) the cubic through both ends with the given tangents that is nearest to p at t: least squares for two lengths."""
    w = [x[..., None] for x in _weights(t)]
    start, end = p[:, 0], p[:, -1]
    off = p - ((w[0] + w[1]) * start[:, None] + (w[2] + w[3]) * end[:, None])
    one, two = w[1] * first[:, None], -w[2] * last[:, None]
    dot = lambda a, b: (a * b).reshape(len(p), -1).sum(1)
    aa, ab, bb, ar, br = dot(one, one), dot(one, two), dot(two, two), dot(one, off), dot(two, off)
    det = aa * bb - ab**2
    fine = np.abs(det) >= 1e-12
    a, b = (np.divide(x, det, out=np.full(len(p), -1.0), where=fine) for x in (ar * bb - br * ab, aa * br - ab * ar))
    fine &= np.isfinite(a) & np.isfinite(b) & (a >= 0) & (b >= 0)
    third = np.maximum(np.hypot(*(end - start).T) / 3, 1e-6)
    a, b = np.where(fine, a, third)[:, None], np.where(fine, b, third)[:, None]
    return np.stack([start, start + a * first, end - b * last, end], 1)


def _nearer(p: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One Newton step of each inner parameter towards the foot of its point on its arc's cubic."""
    u, d = 1 - t, np.diff(c, axis=1)[:, :, None]
    slope = 3 * ((u * u)[..., None] * d[:, 0] + (2 * u * t)[..., None] * d[:, 1] + (t * t)[..., None] * d[:, 2])
    size = (slope**2).sum(2)
    off = ((_on(c, t) - p) * slope).sum(2)
    t = np.clip(t - np.divide(off, size, out=np.zeros_like(off), where=size > 1e-12), 0, 1)
    t[:, 0], t[:, -1] = 0, 1
    return t


#: Points of arcs that are fitted at once.
ARC_POINTS = 1 << 16


def _fitted_arcs(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each arc of p (arcs, points, 2) its cubic, the farthest of its points and how far that lies off."""
    s = np.cumsum(np.hypot(*np.moveaxis(np.diff(p, axis=1), 2, 0)), 1)
    s = np.concatenate([np.zeros((len(p), 1)), s], 1)
    t = np.where(s[:, -1:] >= 1e-12, s / np.maximum(s[:, -1:], 1e-12), np.linspace(0, 1, p.shape[1]))
    t = _nearer(p, _handles(p, t, first, last), t)
    c = _handles(p, t, first, last)
    far = np.hypot(*np.moveaxis(_on(c, t) - p, 2, 0))
    k = far.argmax(1)
    return c, k, np.take_along_axis(far, k[:, None], 1)[:, 0]


def _even_cuts(steps: np.ndarray, tol: float) -> list[int]:
    """Where a ring without corners is split, by its circumference."""
    n, radius = len(steps), max(float(steps.sum()) / (2 * np.pi), 1.0)
    k = int(np.clip(np.ceil(2 * np.pi / max((16384 * max(tol, 1e-3) / radius) ** 0.25, 1e-3)), 4, 32))
    return sorted({i * n // k for i in range(k)})


def _fitted_rings(rings: list[np.ndarray], tol: float, corner: float) -> list[np.ndarray]:
    """Cubics (k, 4, 2) around each ring: arcs between corners, or between even splits where it has none; none around fewer than four points.

    All arcs of one number of points are fitted at once, whichever ring they are of; those that are split go into the next round.
    """
    shapes = [np.asarray(r, float).reshape(-1, 2) for r in rings]
    whole = [i for i, r in enumerate(shapes) if len(r) >= 4]
    if not whole:
        return [np.zeros((0, 4, 2)) for _ in rings]
    p, n = np.concatenate([shapes[i] for i in whole]), np.array([len(shapes[i]) for i in whole])
    base = np.cumsum(n) - n
    at = lambda ring, i: base[ring] + i % n[ring]
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(p)) - base[of]
    on = p[at(of, place + 1)] - p
    back = on[at(of, place - 1)]
    steps = np.hypot(*on.T)
    before = steps[at(of, place - 1)]
    cos = np.divide((back * on).sum(1), before * steps, out=np.ones(len(p)), where=(before > 1e-9) & (steps > 1e-9))
    turns = np.arccos(np.clip(cos, -1, 1)) > corner
    smooth = ~np.logical_or.reduceat(turns, base)
    for r in np.flatnonzero(smooth):
        turns[base[r] + np.array(_even_cuts(steps[base[r] : base[r] + n[r]], tol))] = True
    ring, a = of[turns], place[turns]
    begins = np.flatnonzero(np.diff(ring, prepend=-1))
    b = np.append(a[1:], 0)
    b[np.append(begins[1:], len(ring)) - 1] = a[begins] + n
    tangent = lambda i, lo, hi: _unit(p[at(ring, i + np.where(smooth[ring], 1, hi))] - p[at(ring, i + np.where(smooth[ring], -1, lo))])
    first, last, depth = tangent(a, 0, 1), tangent(b, -1, 0), 0
    done = []
    while len(ring):
        points, start, chord = b - a + 1, p[at(ring, a)], p[at(ring, b)] - p[at(ring, a)]
        line = (points == 2) | (np.hypot(*chord.T) < 1e-9)
        done.append((ring[line], a[line], start[line, None] + np.array([0, 1 / 3, 2 / 3, 1])[:, None] * chord[line, None]))
        todo, split = np.flatnonzero(~line), []
        todo = todo[np.argsort(points[todo], kind="stable")]
        for same in np.split(todo, np.flatnonzero(np.diff(points[todo])) + 1):
            m = int(points[same[0]]) if len(same) else 1
            for some in np.array_split(same, max(-(-len(same) * m // ARC_POINTS), 1)):
                if not len(some):
                    continue
                c, k, far = _fitted_arcs(p[at(ring[some, None], a[some, None] + np.arange(m))], first[some], last[some])
                fits = (far <= tol) | (depth >= FIT_DEPTH) | (m <= 4) | (k == 0) | (k == m - 1)
                done.append((ring[some[fits]], a[some[fits]], c[fits]))
                split.append((some[~fits], k[~fits]))
        some, k = (np.concatenate(x) for x in zip(*split)) if split else (todo[:0], todo[:0])
        ring, a, cut, b, first, last, depth = ring[some], a[some], a[some] + k, b[some], first[some], last[some], depth + 1
        middle = _unit(p[at(ring, cut + 1)] - p[at(ring, cut - 1)], first)
        ring, a, b, first, last = (np.concatenate(x) for x in ((ring, ring), (a, cut), (cut, b), (first, middle), (middle, last)))
    ring, a, c = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((a, ring))
    ring, c = ring[order], c[order]
    begins = np.flatnonzero(np.diff(ring, prepend=-1))
    after = np.arange(1, len(ring) + 1)
    after[np.append(begins[1:], len(ring)) - 1] = begins
    c[:, 3] = c[after, 0]  # exact ends, whatever the rounding
    out = [c[:0]] * len(rings)
    for i, cubics in zip(whole, np.split(c, begins[1:])):
        out[i] = cubics
    return out


def _fitted(flat: np.ndarray, tol: float, corner: float) -> list[np.ndarray]:
    """Cubics (four points each) around one ring."""
    return list(_fitted_rings([flat], tol, corner)[0])


def fitted(p: Column, tol: float = 1.0, corner: float = np.pi / 4) -> Column:
    """array<array<struct<x, y>>>: cubics of four points around a ring, each beginning where the one before ends, the last at the start.

    A turn over corner ends an arc with its own tangents. Arcs are split until the fit is within tol at the arc's points, or
    four of them or FIT_DEPTH splits are left. Rings of fewer than four points have none. All arithmetic of a ring is numpy
    over its points; batches of rings are moved by Arrow.
    """
    return _kernel(lambda f: _fitted(f, tol, corner), lines=True)(_flat(p, "x", "y"))


def _outlined(values: np.ndarray, level: float, least_area: float, least_perimeter: float, tol: float, corner: float) -> list[list[np.ndarray]]:
    """For each raster of values (rasters, h, w) its rings in order, each as cubics (k, 4, 2)."""
    segments, ends = _segments(values, level)
    node = _nodes(segments.reshape(-1, 2), np.repeat(np.arange(len(values)), 2 * np.diff(ends))).tolist()
    chains = [_walked(segments[i:j].reshape(-1, 2), node[2 * i : 2 * j]) for i, j in zip(ends, ends[1:])]
    rings = _nested(chains, least_area, least_perimeter)
    fits = iter(_fitted_rings([r for some in rings for r in some], tol, corner))
    return [[next(fits) for _ in some] for some in rings]


def _tried(rows: pa.Array, w: int, h: int, work) -> pa.Array:
    """struct<contours, failed> of rasters: work(values) of all at once, or of each by itself where that raises."""
    values = rows.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w)
    try:
        found = [(glyph, None) for glyph in work(values)]
    except Exception:  # noqa: BLE001 - a row that raises is that row's result
        found = []
        for i in range(len(values)):
            try:
                found.append((work(values[i : i + 1])[0], None))
            except Exception as e:  # noqa: BLE001
                found.append((None, type(e).__name__))
    left = iter(found)
    glyphs, failed = zip(*[next(left) if ok else (None, None) for ok in rows.is_valid().to_pylist()]) if len(rows) else ((), ())
    rings = [r for g in glyphs for r in g or ()]
    cubics = np.concatenate([np.zeros((0, 4, 2)), *rings])
    lists = lambda sizes, of, mask=None: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), of, mask=mask)
    of = lists(map(len, rings), lists([4] * len(cubics), _points([cubics]).flatten()))
    contours = lists([len(g or ()) for g in glyphs], of, pa.array([g is None for g in glyphs], pa.bool_()))
    return pa.StructArray.from_arrays([contours, pa.array(failed, pa.string())], names=["contours", "failed"])


def outlined(alpha: Column, w: int, h: int, level: float, least_area: float, least_perimeter: float, tol: float = 1.0, corner: float = np.pi / 4) -> Column:
    """struct<contours, failed>: from a raster of w x h to its rings as cubics: contour_segments, chained, nested and fitted within the row, by one kernel.

    Rows are worked on ROWS at a time. Where that raises, each of them is tried by itself: only for a row that raises is
    contours null and failed the type of the exception. A null raster has neither.
    """
    work = lambda values: _outlined(values, level, least_area, least_perimeter, tol, corner)
    kind = T.StructType([T.StructField("contours", T.ArrayType(T.ArrayType(POINTS))), T.StructField("failed", T.StringType())])
    return F.arrow_udf(_by_rows(lambda rows: _tried(rows, w, h, work)), kind)(alpha)


def four(flat: Column) -> Column:
    """Cubics from numbers, eight each."""
    at = lambda i, j: F.struct(F.get(flat, 8 * i + 2 * j).alias("x"), F.get(flat, 8 * i + 2 * j + 1).alias("y"))
    n = F.floor(F.size(flat) / 8).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), lambda i: F.array(*[at(i, F.lit(j)) for j in range(4)]))


def _flattened(flat: np.ndarray, tol: float) -> np.ndarray:
    """Points along cubics, after each one's start: all curves halved at once until both handles lie within tol of the chord."""
    c = np.asarray(flat, float).reshape(-1, 4, 2)
    curve, begin = np.arange(len(c)), np.zeros(len(c))
    found = []
    for depth in range(FLAT_DEPTH + 1):
        chord = c[:, 3] - c[:, 0]
        size = np.hypot(*chord.T)
        off = np.zeros(len(c))
        for k in (1, 2):
            d = c[:, k] - c[:, 0]
            line = np.abs(chord[:, 0] * d[:, 1] - chord[:, 1] * d[:, 0]) / np.where(size < 1e-6, 1, size)
            off = np.maximum(off, np.where(size < 1e-6, np.hypot(*d.T), line))
        flat_ = (off <= tol) | (depth == FLAT_DEPTH)
        found.append((curve[flat_], begin[flat_], c[flat_, 3]))
        c, curve, begin = c[~flat_], curve[~flat_], begin[~flat_]
        if not len(c):
            break
        one = (c[:, :3] + c[:, 1:]) / 2
        two = (one[:, :2] + one[:, 1:]) / 2
        mid = (two[:, :1] + two[:, 1:]) / 2
        left, right = np.concatenate([c[:, :1], one[:, :1], two[:, :1], mid], 1), np.concatenate([mid, two[:, 1:], one[:, 2:], c[:, 3:]], 1)
        c, curve, begin = np.concatenate([left, right]), np.tile(curve, 2), np.concatenate([begin, begin + 0.5 ** (depth + 1)])
    curve, begin, end = (np.concatenate(x) for x in zip(*found))
    return end[np.lexsort((begin, curve))].ravel()


def flattened(cubics: Column, tol: float = 0.25) -> Column:
    """A polyline along cubics (array<array<struct<x, y>>>), without the first one's start: as few halvings as keep within tol, FLAT_DEPTH at most."""
    return _kernel(lambda f: _flattened(f, tol) if len(f) else np.zeros(0))(_flat(F.flatten(cubics), "x", "y"))


def _deviation_of(p: np.ndarray, line: np.ndarray) -> float | None:
    """How far the farthest of the points p lies from a closed polyline, by blocks of points."""
    p, a = p.reshape(-1, 2), line.reshape(-1, 2)
    if not len(p) or not len(a):
        return None
    d, worst = np.roll(a, -1, 0) - a, 0.0
    sq = (d * d).sum(1)
    for block in np.array_split(p, -(-len(p) * len(a) // (1 << 20))):
        off = block[:, None] - a
        t = np.clip(np.divide((off * d).sum(2), sq, out=np.zeros(off.shape[:2]), where=sq > 0), 0, 1)
        worst = max(worst, float(np.hypot(*np.moveaxis(off - t[..., None] * d, 2, 0)).min(1).max()))
    return worst


def checked_fit(p: Column, tol: float = 1.0, corner: float = np.pi / 4, flat: float = 0.05) -> Column:
    """struct<cubics, far>: fitted(p), and the deviation of p from the cubics flattened to within flat.

    The polyline, many times as long as the ring, stays within the kernel, and one Python worker does what would take three.
    """

    def some(rings: pa.Array) -> pa.Array:
        rings = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in rings]
        fits = [None if r is None else _fitted(r, tol, corner) for r in rings]
        far = [_deviation_of(r, _flattened(np.stack(c), flat)) if c else None for r, c in zip(rings, fits)]
        ends = np.cumsum([0, *[len(c or ()) for c in fits]])
        mask = pa.array([c is None for c in fits])
        cubics = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _points([r for c in fits for r in c or ()]), mask=mask)
        return pa.StructArray.from_arrays([cubics, pa.array(far, pa.float64())], names=["cubics", "far"])

    kind = T.StructType([T.StructField("cubics", T.ArrayType(POINTS)), T.StructField("far", T.DoubleType())])
    return F.arrow_udf(_by_rows(some), kind)(_flat(p, "x", "y"))


def deviation(p: Column, line: Column) -> Column:
    """Greatest distance of the points p from the closed polyline line; null where either is null or empty."""

    def run(p: pa.Array, line: pa.Array) -> pa.Array:
        flat = lambda v: v.values.to_numpy(zero_copy_only=False)
        return pa.array([_deviation_of(flat(a), flat(b)) if a.is_valid and b.is_valid else None for a, b in zip(p, line)], pa.float64())

    return F.arrow_udf(run, T.DoubleType())(_flat(p, "x", "y"), _flat(line, "x", "y"))
