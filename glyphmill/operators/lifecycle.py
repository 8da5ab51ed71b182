"""Changes of state as tables in, tables out: submissions, commands, registration, outcomes, and the guards of cached entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.jobs import TERMINAL, outcome

#: What a finish may set beside the status; a null leaves what is there.
RESULTS = ("error_code", "error_message", "zip_name", "zip_size")


def submitted(jobs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, events) with a QUEUED job for each of requests (id, source_url, normalized_url); ids that exist are left as they are.

    Columns that a request doesn't have are null, attempts are 0. One event for each new job.
    """
    new = requests.join(jobs.select("id"), "id", "left_anti").dropDuplicates(["id"])
    given = {"status": F.lit("QUEUED"), "attempts": F.lit(0), "cancel_requested": F.lit(False), "created_at": now, "updated_at": now}
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    value = lambda c: (F.col(c) if c in new.columns else given.get(c, F.lit(None))).cast(kinds[c]).alias(c)
    detail = F.to_json(F.struct(F.trim("source_url").alias("source_url"), "normalized_url"))
    return jobs.unionByName(new.select(*[value(c) for c in jobs.columns])), new.select(F.col("id").alias("job"), now.alias("ts"), F.lit("created").alias("event"), detail.alias("detail_json"))


def found(jobs: DataFrame, id_: Column | str) -> DataFrame:
    """The job with an id: one row or none."""
    return jobs.filter(F.col("id") == F.lit(id_))


def commanded(jobs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, results) after commands (job, seq, ts, command, target and RESULTS), those of a job one after another by seq.

    request and cancel do nothing to a terminal job. finish needs a terminal target and applies whatever the job's status.
    results: job, seq, command, result, which is applied, refused (terminal), invalid (no terminal target, or no such command) or missing (no
    such job). Applied commands are the job's new events.

    A job is open until its first cancel or valid finish, so one window of a running flag tells what each command meets,
    and the last finish, or else the first cancel, what the job becomes: no fold over rows.
    """
    state = jobs.select(F.col("id").alias("job"), F.col("status").isin(*TERMINAL).alias("closed"))
    df = commands.join(state, "job", "left")
    valid = F.when(F.col("command") == "finish", F.coalesce(F.col("target").isin(*TERMINAL), F.lit(False))).otherwise(F.col("command").isin("request", "cancel"))
    df = df.withColumn("valid", F.coalesce(valid, F.lit(False)))
    before = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("valid") & F.col("command").isin("cancel", "finish")
    over = F.col("closed") | F.coalesce(F.max(ends).over(before), F.lit(False))
    result = F.when(F.col("closed").isNull(), "missing").when(~F.col("valid"), "invalid").when((F.col("command") != "finish") & over, "refused").otherwise("applied")
    df = df.withColumn("result", result)
    done = F.col("result") == "applied"
    finish = done & (F.col("command") == "finish")
    latest = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    sums = df.groupBy("job").agg(
        latest("target", finish).alias("_finish"), F.max(done & (F.col("command") == "cancel")).alias("_cancel"), F.max(done & F.col("command").isin("request", "cancel")).alias("_asked"),
        latest("ts", done & F.col("command").isin("cancel", "finish")).alias("_ended"), latest("ts", done).alias("_touched"), *[latest(c, finish & F.col(c).isNotNull()).alias(f"_{c}") for c in RESULTS],
    )
    out = jobs.join(sums, jobs["id"] == sums["job"], "left")
    set_ = {
        "status": F.coalesce("_finish", F.when(F.col("_cancel"), "CANCELLED"), "status"),
        "cancel_requested": F.col("cancel_requested") | F.coalesce("_asked", F.lit(False)),
        "finished_at": F.coalesce("_ended", "finished_at"),
        "updated_at": F.coalesce("_touched", "updated_at"),
    } | {c: F.coalesce(f"_{c}", c) for c in RESULTS}
    return out.select(*[set_.get(c, F.col(f"`{c}`")).alias(c) for c in jobs.columns]), df.select("job", "seq", "command", "result")


def registered(existing: DataFrame, specs: DataFrame, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """(children, events): children (job, position, name, status) of all jobs after specs (job, seq, name) came in.

    A job that has children keeps those alone, however often its specs come again. Others get theirs in the order of seq, from
    position 1, QUEUED, without a name as 'Style n'; with most > 0 the first `most`, and one event that tells how many there were.
    """
    new = specs.join(existing.select("job").distinct(), "job", "left_anti")
    w = Window.partitionBy("job").orderBy("seq")
    ranked = new.withColumn("position", F.row_number().over(w))
    kept = ranked.filter(F.col("position") <= most) if most > 0 else ranked
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Style "), F.col("position").cast("string")))
    rows = existing.select("job", "position", "name", "status").unionByName(kept.select("job", "position", name.alias("name"), F.lit("QUEUED").alias("status")))
    n = new.groupBy("job").agg(F.count("*").alias("available")).filter(F.col("available") > most if most > 0 else F.lit(False))
    return rows, n.select("job", F.lit("styles_truncated").alias("event"), "available", F.lit(most).alias("kept"))


def outcomes(jobs: DataFrame, children: DataFrame) -> DataFrame:
    """id, styles_total, styles_done, styles_failed, status, error_code of every job, those without children too (FAILED, NO_STYLES)."""
    counts = children.groupBy("job").agg(F.count("*").alias("styles_total"), F.count_if(F.col("status") == "DONE").alias("styles_done"), F.count_if(F.col("status") == "FAILED").alias("styles_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    df = jobs.select("id").join(counts, F.col("id") == F.col("job"), "left").select("id", zero("styles_total"), zero("styles_done"), zero("styles_failed"))
    status = outcome(F.col("styles_total"), F.col("styles_done"))
    return df.withColumn("status", status).withColumn("error_code", F.when(F.col("styles_total") == 0, "NO_STYLES").when(status == "FAILED", "STYLES_FAILED"))


def hollow_hits(lookups: DataFrame) -> DataFrame:
    """lookups (status, frozen, reconstructed) with serve and invalidated: a hit without glyphs is no hit, and says why.

    binary needs a frozen glyph, fontmodel a reconstructed one; partial and miss are served as they are.
    """
    reason = F.when((F.col("status") == "binary") & (F.col("frozen") <= 0), "binary entry with zero frozen glyphs").when(
        (F.col("status") == "fontmodel") & (F.col("reconstructed") <= 0), "fontmodel entry with zero reconstructed glyphs"
    )
    return lookups.withColumn("invalidated", reason).withColumn("serve", F.when(reason.isNotNull(), "miss").otherwise(F.col("status")))


def frozen_styles(glyphs: DataFrame, style: str, routes: list[str]) -> DataFrame:
    """style, one count for each route, frozen, error: glyphs (style, via; null where one failed) by the route that froze them.

    A style none of whose glyphs is frozen is NO_GLYPHS_FROZEN.
    """
    out = glyphs.groupBy(style).agg(*[F.count_if(F.col("via") == r).alias(r) for r in routes], F.count("via").alias("frozen"))
    return out.withColumn("error", F.when(F.col("frozen") == 0, "NO_GLYPHS_FROZEN"))


#: Advance of the box that stands for missing glyphs, and its left side.
NOTDEF_ADVANCE, NOTDEF_LEFT = 500, 50


def glyph_order(glyphs: DataFrame, model: str) -> DataFrame:
    """model, place, name, advance, lsb: glyphs (name, listed, advance, x_min) in a font's order.

    .notdef comes first, made up where the model has none; then glyphs by their place in the listing, then those in none by
    name. Advances aren't negative and lose their fraction; lsb is x_min, 0 for a glyph without contours (null).
    """
    own = glyphs.groupBy(model).agg(F.count_if(F.col("name") == ".notdef").alias("n")).filter("n = 0")
    made = own.select(model, F.lit(".notdef").alias("name"), F.lit(None).cast("int").alias("listed"), F.lit(NOTDEF_ADVANCE).cast("double").alias("advance"), F.lit(NOTDEF_LEFT).cast("int").alias("x_min"))
    df = glyphs.select(model, "name", F.col("listed").cast("int").alias("listed"), F.col("advance").cast("double").alias("advance"), F.col("x_min").cast("int").alias("x_min")).unionByName(made)
    order = [(F.col("name") != ".notdef").asc(), F.col("listed").asc_nulls_last(), F.col("name")]
    place = (F.row_number().over(Window.partitionBy(model).orderBy(*order)) - 1).alias("place")
    return df.select(model, place, "name", F.greatest(F.lit(0), F.col("advance").cast("int")).alias("advance"), F.coalesce("x_min", F.lit(0)).alias("lsb"))
