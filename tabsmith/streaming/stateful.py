"""Following runs with one entry of the state store per open run.

An entry holds the newest event of its run. When a run ends its end goes out once, and the entry becomes
a mark that keeps later events of the run out until its timer removes it after ``remember``. A run that
hears nothing for ``patience`` goes out once as silent and stays open. A batch reads its own events and
the entries they touch; finished runs are never read again. Ends are written by the exactly-once file
sink, open runs are read from the store itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabsmith.operators.ledger import TERMINAL

ENTRY = "status string, at long, event_id long, ended boolean, silent boolean"
OUTPUT = "job_id string, status string, at long, event_id long, finished boolean"
PATIENCE = timedelta(days=1)
REMEMBER = timedelta(days=7)

#: Stands for a missing time or id: before every other one, as nulls are in an ascending order.
_NONE = -(2**63)


def _milliseconds(span: timedelta) -> int:
    return max(1, int(span.total_seconds() * 1000))


def _fold(patience: timedelta, remember: timedelta):
    """The function of one run: its events of a batch, or its timer, against its entry."""

    def row(job: str, entry: tuple) -> pd.DataFrame:
        status, at, event_id, ended, _ = entry
        return pd.DataFrame(
            {"job_id": [job], "status": [status], "at": [at], "event_id": [event_id], "finished": [ended]}
        )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if entry[3]:
                state.remove()
            else:
                state.update((*entry[:4], True))
                yield row(key[0], entry)
            return
        if entry is not None and entry[3]:
            state.setTimeoutDuration(_milliseconds(remember))
            return  # ended before: nothing of it is followed any more
        newest = None if entry is None else (entry[1], entry[2], entry[0])
        end = None
        for part in parts:
            for event in zip(part["at"].tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True):
                newest = event if newest is None or event[:2] > newest[:2] else newest
                if event[2] in TERMINAL and (end is None or event[:2] < end[:2]):
                    end = event
        at, event_id, status = newest if end is None else end
        entry = (status, at, event_id, end is not None, False)
        state.update(entry)
        state.setTimeoutDuration(_milliseconds(patience if end is None else remember))
        if end is not None:
            yield row(key[0], entry)

    return step


def follow(events: DataFrame, patience: timedelta = PATIENCE, remember: timedelta = REMEMBER) -> DataFrame:
    """(job_id, status, ts, event_id, finished) of runs that end or fall silent, as a stream.

    ``events`` needs job_id, status, ts and an integer event_id; other columns are ignored. Events without
    a status change nothing that is followed, events without job_id are left out. Of several ends in one
    batch the earliest counts; equal times are ordered by event_id, and a missing time is before all
    others. An event that comes later than ``remember`` after the last one of an ended run opens it anew.
    """
    rows = events.where("status IS NOT NULL AND job_id IS NOT NULL").select(
        F.col("job_id").cast("string").alias("job_id"), "status",
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NONE)).alias("at"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(_NONE)).alias("event_id"),
    )
    out = rows.groupBy("job_id").applyInPandasWithState(
        _fold(patience, remember), OUTPUT, ENTRY, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return _shown(out, "job_id", "status", "finished")


def _shown(rows: DataFrame, job: str, status: str, finished: str) -> DataFrame:
    given = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return rows.select(
        F.col(job).alias("job_id"), F.col(status).alias("status"), F.timestamp_micros(given("at")).alias("ts"),
        given("event_id").alias("event_id"), F.col(finished).alias("finished"),
    )


def start(followed: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Write what ``follow`` gives to parquet files in ``path``.

    Timers need batches without data, which would follow each other without a pause: they run ``every`` so
    often. With ``once`` they are off, as the query would never end, and timers wait for the next data.
    """
    writer = followed.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if not once:
        return writer.trigger(processingTime=every).start()
    conf, name = followed.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, status, ts, event_id, finished) of the runs open after the last batch, from the state store."""
    state = spark.read.format("statestore").load(checkpoint)
    entries = state.select(F.col("key.job_id").alias("job_id"), "value.groupState.*").where("NOT ended")
    return _shown(entries, "job_id", "status", "ended")


def ended_runs(spark: SparkSession, path: str) -> DataFrame:
    """The ends written so far; runs that only fell silent are left out."""
    return spark.read.parquet(path).where("finished")
