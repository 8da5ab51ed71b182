"""Mixing sources to target weights by entropy balancing.

A document of size x gets the rate r = 2 e^u / (1 + e^u) with u = lambda(source) * x / mean size: the rate that is
nearest in (bounded) entropy to one copy each, given that the words taken from its source sum to the source's
target. Newton iterations on the convex dual find lambda for all sources at once; rates become 0, 1 or 2 copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
NEWTON_ROUNDS = 40
TOLERANCE = 1e-9
#: Bins of one refinement of the rounding threshold, and the refinements; rounds in which a source gains or drops one copy to come nearer.
BINS, REFINEMENTS, NEARER = 1024, 3, 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> plus target. One row per source.

    Sources are a dimension: the window over them holds one small row for each. A target stops at MOST times its
    source's size; the level at which the others meet the total is where the resharing by weight ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = sources.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size"))
    full = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    df = (
        df.withColumn("total", SHARE * F.sum("source_size").over(everyone))
        .withColumn("capped", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    )
    # The first source, by cap per weight, that its level doesn't fill sets it for all after; later levels are lower.
    df = df.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everyone))
    return df.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    u = lam * x
    return MOST / (1 + F.exp(-u))


def tilts(histogram: DataFrame) -> DataFrame:
    """source -> lam, from (source, size, n, source_size, target, mean). Newton with a bracket, all sources in each pass."""
    free = (F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    hist = materialize(histogram.filter(free & (F.col("size") > 0)).withColumn("x", F.col("size") / F.col("mean")), "sizes")
    state = hist.select("source", "target").distinct().select("source", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("err"))
    state = materialize(state, "tilt")
    for _ in range(NEWTON_ROUNDS):
        r = _rate(F.col("lam"), F.col("x"))
        words = F.col("n") * F.col("size")
        step = (
            hist.drop("target").join(state.select(F.col("source").alias("_s"), "lam"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(F.sum(words * r).alias("got"), F.sum(words * F.col("x") * r * (1 - r / MOST)).alias("slope"))
        )
        joined = state.join(step.select(F.col("source").alias("_s"), "got", "slope"), F.col("source").eqNullSafe(F.col("_s")))
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # Beyond the bracket, or where an end of it is still open and the step is huge, halve or double instead.
        lo_end = F.coalesce(lo, F.least(F.col("lam") * 2, F.lit(-1.0)))
        hi_end = F.coalesce(hi, F.greatest(F.col("lam") * 2, F.lit(1.0)))
        inside = (newton > lo_end) & (newton < hi_end)
        new = F.when(gap == 0, F.col("lam")).when(inside, newton).when(lo.isNull(), lo_end).when(hi.isNull(), hi_end).otherwise((lo_end + hi_end) / 2)
        state = materialize(joined.select("source", "target", new.alias("lam"), lo.alias("lo"), hi.alias("hi"), (F.abs(gap) / F.col("target")).alias("err")).coalesce(1), "tilt")
        worst = state.agg(F.max("err")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    # Sums in another order differ in their last bits; reruns are to agree.
    return state.select("source", F.round("lam", 9).alias("lam"))


def mix(sized: DataFrame) -> DataFrame:
    """sized (size, source, doc_id, ...) with source_size, target, rate, copies and taken.

    Copies: a document with rate r and u = a hash of its id in [0, 1) gets floor(r + u + t) copies, kept within
    0 and 2; t is a threshold for each source, found by refining bins of the documents' own thresholds, at which
    the words taken come nearest to the target. Then, NEARER times, each source adds or drops a copy of the document whose size is
    nearest to what is missing or too much, of equally near ones the one with the smallest hash and id. A null source is one source, last in order. Sources without
    words have target 0. Null texts and empty texts have size 0 and take nothing. Repeated rows each count.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("filled"))
    sums = materialize(sums, "sources")
    goals = materialize(targets(sums.select("source", "source_size")).join(sums.select(F.col("source").alias("_s"), "filled"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    named = goals.select(F.col("source").alias("_s"), "source_size", "target", (F.col("source_size") / F.greatest(F.col("filled"), F.lit(1))).alias("mean"))
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n")).join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lam = tilts(histogram)
    goals = materialize(named.join(lam.withColumnRenamed("source", "_l"), F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_l"), "goals")
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    rated = (
        sized.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("rate", F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), F.when(F.col("target") > 0, MOST).otherwise(0.0)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"))))
        .withColumn("u", u)
    )
    open_ = rated.filter(F.col("lam").isNotNull() & (F.col("size") > 0)).select("source", "size", "target", F.explode(F.array(1 - F.col("rate") - F.col("u"), 2 - F.col("rate") - F.col("u"))).alias("at"))
    cut = _thresholds(materialize(open_.groupBy("source", "target", "at").agg(F.sum("size").alias("size")), "steps"))
    out = rated.join(cut.select(F.col("source").alias("_s"), "cut"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    copies = F.when(F.col("lam").isNull(), F.col("rate")).otherwise(
        (1 - F.col("rate") - F.col("u") <= F.col("cut")).cast("int") + (2 - F.col("rate") - F.col("u") <= F.col("cut")).cast("int")
    )
    out = out.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(copies).cast("int")).withColumn("_rid", F.monotonically_increasing_id())
    out = materialize(out, "copies")
    for _ in range(NEARER):
        out = out.join(_nearer(out), "_rid", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("u", "lam", "mean", "cut", "_rid")


def _nearer(out: DataFrame) -> DataFrame:
    """_rid, change: for each source with a tilt the row whose size is nearest to its gap, where the change makes the gap smaller."""
    free = out.filter(F.col("lam").isNotNull() & (F.col("size") > 0))
    gaps = free.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    gaps = materialize(gaps.select(F.col("source").alias("_s"), "gap"), "gaps")
    near = free.join(gaps, F.col("source").eqNullSafe(F.col("_s")))
    able = ((F.col("gap") > 0) & (F.col("copies") < MOST)) | ((F.col("gap") < 0) & (F.col("copies") > 0))
    near = near.filter(able & (F.col("size") < 2 * F.abs("gap")))
    best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")), "u", "doc_id", "_rid", F.signum("gap").cast("int").alias("change"))).alias("b"))
    return materialize(best.select("b._rid", "b.change"), "nearer")


def _thresholds(steps: DataFrame) -> DataFrame:
    """source -> cut: the threshold whose words, summed over all thresholds up to it, come nearest to the target."""
    by = Window.partitionBy("source").orderBy("bin")
    found = steps.select("source", "target").distinct().select("source", "target", F.lit(-3.0).alias("lo"), F.lit(3.0).alias("hi"), F.lit(0).cast("long").alias("before"))
    for k in range(REFINEMENTS):
        named = found.select(F.col("source").alias("_s"), "lo", "hi", "before")
        inside = steps.join(named, F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("at") > F.col("lo")) & (F.col("at") <= F.col("hi"))).drop("_s")
        width = (F.col("hi") - F.col("lo")) / BINS
        bins = inside.withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("lo")) / width).cast("int") - 1)))
        # The bin's ends are those of its own thresholds, so that no row falls between by rounding.
        bins = bins.groupBy("source", "target", "before", "bin").agg(F.sum("size").alias("size"), F.max("at").alias("top"))
        bins = bins.withColumn("sum", F.col("before") + F.sum("size").over(by)).withColumn("below", F.lag("top").over(by))
        reached = bins.filter(F.col("sum") >= F.col("target")).groupBy("source", "target").agg(F.min_by(F.struct("top", "below", "sum", "size"), "bin").alias("b"))
        old = found.select(F.col("source").alias("_s"), "lo")
        nxt = reached.join(old, F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", "target", F.coalesce("b.below", "lo").alias("lo"), F.col("b.top").alias("hi"), (F.col("b.sum") - F.col("b.size")).alias("before"), F.col("b.sum").alias("sum")
        )
        found = materialize(nxt, "cut")
    # What lies up to lo sums to before, what lies up to hi to sum: the nearer end.
    return found.select("source", F.when(F.col("target") - F.col("before") < F.col("sum") - F.col("target"), F.col("lo")).otherwise(F.col("hi")).alias("cut"))


def op2(docs: DataFrame) -> DataFrame:
    sized = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sized")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def repeat(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, with the columns of docs, whatever their names.

    Rows are repeated after the join. Equal rows are taken equally often, so each may have a copy more than the mix gives it.
    Null and empty texts have no words, so they are in no mix.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select("doc_id", F.col("source"), size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("key"))
    sized = materialize(inner, "sized")
    mixed = mix(sized).filter("copies > 0").groupBy("key").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)]).alias("row"), F.xxhash64("doc_id", "source", "text").alias("key"))
    out = rows.join(mixed, "key").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select(*[F.col(f"row.{o}").alias(c) for c, o in zip(docs.columns, own)])
