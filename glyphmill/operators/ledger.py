"""Cache ledgers, artifacts and reports: admission, event folds and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(current: Column, status: Column, validated: Column, binaries: Column, model: Column, frozen: Column) -> Column:
    """What a ledger row admits: binary, fontmodel, partial or miss.

    current: schema, pipeline and options all agree. binaries: all of them are there. A model needs no validation.
    A null ledger is a miss; a null count is 0.
    """
    done = status == "success"
    return (
        F.when(~F.coalesce(current, F.lit(False)), "miss").when(done & validated & binaries, "binary").when(done & model & ~binaries, "fontmodel")
        .when((status == "in_progress") & (F.coalesce(frozen, F.lit(0)) > 0), "partial").otherwise("miss")
    )


def fold(events: DataFrame, key: str, order: Sequence[str], kind: Column, passed: Column) -> DataFrame:
    """key -> status, failed, validation_passed after all its events, without replaying them.

    begin, model, final and invalidate are the kinds. A final clears the failure, an invalidation sticks until the next
    final or begin; a model succeeds unless it is failed then. Each part depends only on the latest event of some kinds.
    """
    at = F.struct(*order)
    latest = {k: F.max(F.when(kind == k, at)).alias(k) for k in ("begin", "model", "final", "invalidate")}
    last = events.groupBy(key).agg(*latest.values(), F.max_by(passed, F.when(kind == "final", at)).alias("validation_passed"))
    reset = F.greatest("begin", "final")
    failed = F.col("invalidate").isNotNull() & (reset.isNull() | (F.col("invalidate") > reset))
    success = F.greatest("model", "final")
    status = F.when(failed, "failed").when(success.isNotNull() & (F.col("begin").isNull() | (success > F.col("begin"))), "success").when(F.col("begin").isNotNull(), "in_progress")
    return last.select(key, status.alias("status"), failed.alias("failed"), "validation_passed")


def hollow(sizes: Sequence[Column], least: int = 20_000) -> Column:
    """Whether an artifact is missing or not larger than `least` bytes."""
    return F.least(*[F.coalesce(s, F.lit(0)) for s in sizes]) <= least


def resolve(rows: DataFrame, artifacts: DataFrame, keys: Sequence[str], done: Column, error: Column) -> DataFrame:
    """rows with artifact (from the first of keys that has one), status and error_code.

    A row that is done without artifact has failed with ARTIFACT_MISSING, any other with its own error or UNKNOWN.
    artifacts: key, artifact; keys are unique.
    """
    out = rows
    for i, k in enumerate(keys):
        out = out.join(artifacts.select(F.col("key").alias(f"_k{i}"), F.col("artifact").alias(f"_a{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    found = F.coalesce(*[F.col(f"_a{i}") for i in range(len(keys))])
    is_done = F.coalesce(done, F.lit(False))
    status = F.when(is_done & found.isNotNull(), "DONE").otherwise("FAILED")
    code = F.when(is_done & found.isNull(), "ARTIFACT_MISSING").when(~is_done, F.coalesce(error, F.lit("UNKNOWN")))
    return out.select(*rows.columns, F.when(is_done, found).alias("artifact"), status.alias("status"), code.alias("error_code"))


def report(rows: DataFrame, key: str, gid: str, failed: Column, reason: Column) -> DataFrame:
    """key -> total, frozen, failed_glyphs (sorted), reasons (sorted reason:count). Counts combine before the shuffle."""
    per = rows.groupBy(key, F.when(failed, F.coalesce(reason, F.lit("UNKNOWN"))).alias("reason")).agg(F.count("*").alias("n"), F.collect_set(F.when(failed, F.col(gid))).alias("g"))
    bad = F.col("reason").isNotNull()
    return per.groupBy(key).agg(
        F.sum("n").alias("total"), F.sum(F.when(bad, 0).otherwise(F.col("n"))).alias("frozen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("failed_glyphs"),
        F.array_sort(F.collect_list(F.when(bad, F.concat("reason", F.lit(":"), F.col("n").cast("string"))))).alias("reasons"),
    )


def manifest(packages: DataFrame, key: str, status: str, is_hollow: Column, digest: Column) -> DataFrame:
    """key -> n_done, n_failed, n_hollow and a hash over the sorted hashes of its packages."""
    ok = (F.col(status) == "DONE") & ~is_hollow
    sums = packages.groupBy(key).agg(F.count_if(ok).alias("n_done"), F.count_if(~ok).alias("n_failed"), F.count_if(is_hollow).alias("n_hollow"), F.array_sort(F.collect_list(F.when(ok, digest))).alias("d"))
    return sums.select(key, "n_done", "n_failed", "n_hollow", F.sha2(F.concat_ws(",", "d"), 256).alias("sha256"))


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """base with the latest change of each key put in its place; new keys are added. base has unique keys."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_new"))
    joined = base.select(key, F.struct(F.col(value).alias("v")).alias("_old")).join(last, key, "full")
    return joined.select(key, F.coalesce("_new", "_old")["v"].alias(value))


def child_update(events: DataFrame, key: str, order: Sequence[str], status: str, error: Column, active: Sequence[str], terminal: Sequence[str]) -> DataFrame:
    """key -> status (latest), started_at (first active), finished_at (latest terminal), error_code (latest not null)."""
    at, ts = F.struct(*order), F.col(order[0])
    return events.groupBy(key).agg(
        F.max_by(status, at).alias("status"), F.min(F.when(F.col(status).isin(*active), ts)).alias("started_at"), F.max(F.when(F.col(status).isin(*terminal), ts)).alias("finished_at"),
        F.max_by(error, F.when(error.isNotNull(), at)).alias("error_code"),
    )


def failures(rows: DataFrame, key: str, gid: str, failed: Column, reason: Column) -> DataFrame:
    """key, gid, reason of each glyph that failed, once: the report's failed ids as rows, however many a key has."""
    return rows.filter(failed).select(key, gid, F.coalesce(reason, F.lit("UNKNOWN")).alias("reason")).distinct()


def block_digests(packages: DataFrame, key: str, digest: Column, digits: int = 2) -> DataFrame:
    """key, block, n, sha256: a hash over the sorted digests (lowercase hex) of each block, a block being a prefix of so many digits.

    A key's digests come together a block at a time; more digits make smaller blocks.
    """
    rows = packages.select(key, digest.alias("_d")).filter("_d is not null").withColumn("block", F.substring("_d", 1, digits))
    sums = rows.groupBy(key, "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_d")).alias("_d"))
    return sums.select(key, "block", "n", F.sha2(F.concat_ws(",", "_d"), 256).alias("sha256"))


def manifest_by_blocks(packages: DataFrame, key: str, digest: Column, digits: int = 2) -> DataFrame:
    """key, n, blocks, sha256: the hash over a key's block hashes in the order of blocks, 16**digits of them at most."""
    blocks = block_digests(packages, key, digest, digits).groupBy(key)
    sums = blocks.agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("block", "sha256"))).alias("b"))
    return sums.select(key, "n", "blocks", F.sha2(F.array_join(F.transform("b", lambda b: F.concat(b["block"], F.lit(":"), b["sha256"])), ","), 256).alias("sha256"))
