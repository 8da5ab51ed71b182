"""Job events as streams: latest state, silent workers, and work that is resumed without doing it twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.operators.jobs import TERMINAL


def once(units: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each unit once, however often it is sent within `late`; the state is bounded by the watermark."""
    return units.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, ts: str, late: str, window: str, kind: str) -> DataFrame:
    """Events by window and kind, partial counts before the shuffle. Windows aren't among the source's features."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n"))


def states(events: DataFrame, late: str) -> DataFrame:
    """events (job, ts, status) -> job, status, n after each batch in which a job has events. A terminal status absorbs all later ones."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        # Only a job's few events of this batch; frames aren't put together.
        for _, s in sorted((t, s) for f in frames for t, s in zip(f["ts"], f["status"])):
            if status not in TERMINAL:
                status, n = s, n + 1
        state.update((status, n))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "n": [n]})

    rows = events.withWatermark("ts", late).select("job", "ts", "status").groupBy("job")
    return rows.applyInPandasWithState(run, "job string, status string, n long", "status string, n long", "append", GroupStateTimeout.NoTimeout)


def silent(beats: DataFrame, seconds: int, late: str) -> DataFrame:
    """beats (worker, ts) -> worker, last: a session of beats that ended `seconds` ago by the watermark."""
    sessions = beats.withWatermark("ts", late).groupBy(F.session_window("ts", f"{seconds} seconds"), "worker").agg(F.max("ts").alias("last"))
    return sessions.select("worker", "last")


def requeues(beats: DataFrame, seconds: int, late: str, me: str) -> DataFrame:
    """beats (job, worker, ts, status) -> job, event, previous_worker, requeued_by, silent_since, attempts: one row when a job's worker falls silent.

    Each beat puts the job's timer off to `seconds` after the latest one; when the watermark passes it, the job is requeued once
    and forgets its worker, until another beat claims it. A terminal status ends the job for good; beats after it, and beats
    sent again, change nothing. attempts counts the requeues of a job. State is one small row a job.
    """
    schema = "job string, event string, previous_worker string, requeued_by string, silent_since timestamp, attempts int"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worker, last, attempts, over = state.get if state.exists else (None, 0, 0, False)
        if state.hasTimedOut:
            since = pd.Timestamp(last, unit="ms")
            yield pd.DataFrame({"job": [key[0]], "event": ["requeued_stale"], "previous_worker": [worker], "requeued_by": [me], "silent_since": [since], "attempts": [attempts + 1]})
            state.update((None, last, attempts + 1, over))
            return
        for f in frames:
            for ts, who, status in zip(f["ts"], f["worker"], f["status"]):
                at = int(pd.Timestamp(ts).timestamp() * 1000)
                over = over or status in TERMINAL
                if at > last:
                    worker, last = who, at
        state.update((worker, last, attempts, over))
        if not over and worker is not None:
            state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark("ts", late).select("job", "worker", "ts", "status").groupBy("job")
    return rows.applyInPandasWithState(run, schema, "worker string, last long, attempts int, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def freeze(path: str, key: str):
    """A foreachBatch sink for frozen units: each batch is one folder below path, written whole, so a batch sent again replaces itself.

    Units of one batch are reduced to the last by seq before they are written.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def frozen(batches: DataFrame, key: str) -> DataFrame:
    """The last state of each unit over all batches of a frozen folder: the later batch, then the higher seq."""
    columns = [c for c in batches.columns if c != "batch"]
    return batches.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("batch", "seq")).alias("r")).select("r.*")


def frozen_counts(batches: DataFrame, key: str, entry: str) -> DataFrame:
    """entry, frozen: units of each entry of the ledger, each once however many batches hold it."""
    return frozen(batches, key).groupBy(entry).agg(F.count("*").alias("frozen"))
