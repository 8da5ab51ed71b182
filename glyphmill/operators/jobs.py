"""Job and child-task tables as pure queries: admission, counters, outcomes, stale workers, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("DONE", "DONE_WITH_ERRORS", "FAILED", "CANCELLED")


def outcome(total: Column, done: Column) -> Column:
    """Terminal status of a collection from the counts of its children."""
    return F.when(total == 0, "FAILED").when(done == total, "DONE").when(done == 0, "FAILED").otherwise("DONE_WITH_ERRORS")


def rollup(children: DataFrame, job: str, failed: Column) -> DataFrame:
    """job -> styles_total, styles_done, styles_failed, status, error_code. One shuffle with map-side sums."""
    counts = children.groupBy(job).agg(F.count("*").alias("styles_total"), F.count_if(~failed).alias("styles_done"), F.count_if(failed).alias("styles_failed"))
    status = outcome(F.col("styles_total"), F.col("styles_done"))
    return counts.withColumn("status", status).withColumn("error_code", F.when(F.col("status") == "FAILED", "STYLES_FAILED"))


def admission(jobs: DataFrame, status: str, limit: int) -> DataFrame:
    """One row: open jobs, and whether another is admitted."""
    return jobs.agg(F.count_if(~F.col(status).isin(*TERMINAL)).alias("open_jobs")).withColumn("admitted", F.col("open_jobs") < limit)


def recent(jobs: DataFrame, created: str, seq: str, k: int) -> DataFrame:
    """The k latest, the later sequence number first among equals: a top-k in each task, then one of those."""
    return jobs.orderBy(F.col(created).desc(), F.col(seq).desc()).limit(k)


def register(children: DataFrame, job: str, order: list[Column], name: Column, most: int) -> DataFrame:
    """Children by position from 1, the first `most` of each job, with default names."""
    ranked = children.withColumn("position", F.row_number().over(Window.partitionBy(job).orderBy(*order)))
    ranked = ranked.filter(F.col("position") <= most)
    return ranked.withColumn("name", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Style "), F.col("position").cast("string"))))


def last_state(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The latest values of each key: an aggregation, so that a hot key is reduced before the shuffle."""
    return events.groupBy(key).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def stale(jobs: DataFrame, beat: str, now: Column, seconds: int, owner: Column, me: str) -> DataFrame:
    """Jobs whose worker is gone: the heartbeat is too old, or there is none and another worker owns the job."""
    old = F.col(beat) <= now - F.expr(f"interval {seconds} seconds")
    return jobs.filter(F.when(F.col(beat).isNull(), owner != me).otherwise(old))


def requeue(jobs: DataFrame, beat: str, now: Column, seconds: int, owner: str, me: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, events): stale jobs go back to QUEUED without stage, worker and heartbeat and with one more attempt; one event for each.

    beat is text; one that is no timestamp is stale. Without a heartbeat (null or empty) a job is stale if another worker (or
    none) owns it. Terminal and queued jobs aren't looked at. An event names the worker that had the job and the one that requeued it.
    """
    at = F.col(beat).try_cast("timestamp")
    old = at.isNull() | (at <= now - F.expr(f"interval {seconds} seconds"))
    gone = ~F.col("status").isin(*TERMINAL, "QUEUED") & F.when(F.coalesce(beat, F.lit("")) == "", ~F.col(owner).eqNullSafe(F.lit(me))).otherwise(old)
    marked = jobs.withColumn("_gone", gone)
    empty = lambda c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c)
    kept = {"status": F.when(F.col("_gone"), "QUEUED").otherwise(F.col("status")).alias("status"), "attempts": (F.col("attempts") + F.col("_gone").cast("int")).alias("attempts")}
    cleared = ("stage", owner, beat)
    out = marked.select(*[empty(c) if c in cleared else kept.get(c, F.col(f"`{c}`")) for c in jobs.columns])
    return out, marked.filter("_gone").select("id", F.lit("requeued_stale").alias("event"), F.col(owner).alias("previous_worker"), F.lit(me).alias("requeued_by"))


def transitions(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """jobs (id, status, cancel_requested, error_code) after one command each (job, command, target, code), with applied.

    request and cancel do nothing to a terminal job; finish needs a terminal target, whatever the job's status. A null code
    leaves the one there is.
    """
    c = jobs.join(commands, F.col("id") == F.col("job"), "left")
    open_ = ~F.col("status").isin(*TERMINAL)
    applied = F.coalesce(F.when(F.col("command").isin("request", "cancel"), open_).when(F.col("command") == "finish", F.col("target").isin(*TERMINAL)), F.lit(False))
    c = c.withColumn("applied", applied)
    done = F.col("applied")
    status = F.when(done & (F.col("command") == "cancel"), "CANCELLED").when(done & (F.col("command") == "finish"), F.col("target")).otherwise(F.col("status"))
    code = F.when(done & (F.col("command") == "finish"), F.coalesce("code", "error_code")).otherwise(F.col("error_code"))
    return c.select("id", status.alias("status"), (F.col("cancel_requested") | (done & F.col("command").isin("request", "cancel"))).alias("cancel_requested"), code.alias("error_code"), "applied")


def updated(jobs: DataFrame, changes: dict[str, Column], allowed: frozenset[str]) -> DataFrame:
    """jobs with columns changed; one that isn't allowed raises."""
    if unknown := set(changes) - allowed:
        raise ValueError(f"these columns can't be updated: {sorted(unknown)}")
    return jobs.withColumns(changes)


def status_view(jobs: DataFrame, children: DataFrame) -> DataFrame:
    """jobs (id, status, ...) with terminal, and styles: array<struct<position, name, failed>> of children (job, position, name, failed)."""
    styles = children.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("position", "name", "failed"))).alias("styles"))
    out = jobs.join(styles, F.col("id") == F.col("job"), "left").drop("job")
    return out.withColumn("terminal", F.col("status").isin(*TERMINAL)).withColumn("styles", F.coalesce("styles", F.array().cast(styles.schema["styles"].dataType)))


def claim(jobs: DataFrame, status: str, created: str, seq: str, queued: str, active: list[str], most: int) -> DataFrame:
    """The oldest queued job, if fewer than `most` are active."""
    n = jobs.agg(F.count_if(F.col(status).isin(*active)).alias("active"))
    first = jobs.filter(F.col(status) == queued).orderBy(created, seq).limit(1)
    return first.crossJoin(F.broadcast(n)).filter(F.col("active") < most).drop("active")


def histogram(jobs: DataFrame, status: str, listing: list[str]) -> DataFrame:
    """Counts for every listed status, in listing order, 0 where none."""
    listed = jobs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(listing)], "place int, status string")
    counts = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return listed.join(counts, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def download(found: Column, status: Column, has_zip: Column, on_disk: Column) -> Column:
    """HTTP code of a download request."""
    return F.when(~found, 404).when(~status.isin("DONE", "DONE_WITH_ERRORS"), 409).when(~has_zip, 409).when(~on_disk, 404).otherwise(200)
