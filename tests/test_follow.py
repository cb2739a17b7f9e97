from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from tabsmith.session import scratch_path
from tabsmith.streaming import stateful

EVENTS = "job_id string, status string, ts string, event_id bigint, note string"


def test_entries_survive_a_restart(spark):
    root = scratch_path(spark, "test-stateful")
    source, ends, checkpoint = f"{root}/in", f"{root}/ends", f"{root}/checkpoint"

    def arrive(*rows):
        made = spark.createDataFrame([(*r, "x") for r in rows], EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(source)

    def run():  # each call is a new query that starts from the checkpoint
        stream = spark.readStream.schema(EVENTS.replace("ts string", "ts timestamp")).parquet(source)
        stateful.start(stateful.follow(stream), ends, checkpoint, once=True).awaitTermination()
        closed = {r["job_id"]: (r["status"], r["event_id"]) for r in stateful.ended_runs(spark, ends).collect()}
        opened = {r["job_id"]: (r["status"], r["event_id"]) for r in stateful.open_runs(spark, checkpoint).collect()}
        return closed, opened

    arrive(("a", "running", "2024-01-01", 1), ("b", "failed", "2024-01-04", 4), ("b", "completed", "2024-01-03", 3),
           ("b", "running", "2024-01-05", 2), ("c", None, "2024-01-01", 5), (None, "running", "2024-01-01", 9),
           ("e", "pending", None, None), ("f", "pending", "2024-01-01", 1), ("f", "running", "2024-01-01", 2))
    assert run() == ({"b": ("completed", 3)}, {"a": ("running", 1), "e": ("pending", None), "f": ("running", 2)})
    arrive(("a", "failed", "2024-02-01", 6), ("b", "running", "2024-02-02", 7), ("b", "failed", "2024-02-03", 8),
           ("e", "running", "2023-01-01", 1), ("f", "pending", "2023-01-01", 1))
    closed, opened = run()
    assert closed == {"b": ("completed", 3), "a": ("failed", 6)}
    assert opened == {"e": ("running", 1), "f": ("running", 2)}  # an older event does not replace a newer one
    assert stateful.ended_runs(spark, ends).count() == 2


class _Entry:
    """What the fold uses of a group's state."""

    def __init__(self):
        self.value, self.timer, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timer = ms


def test_timers():
    step = stateful._fold(timedelta(seconds=5), timedelta(seconds=9))
    entry = _Entry()

    def send(*events):
        entry.hasTimedOut = False
        part = pd.DataFrame(events, columns=["status", "at", "event_id"])
        return [tuple(r) for out in step(("a",), iter([part]), entry) for r in out.itertuples(index=False)]

    def ring():
        entry.hasTimedOut = True
        return [tuple(r) for out in step(("a",), iter([]), entry) for r in out.itertuples(index=False)]

    assert send(("running", 1, 1)) == [] and entry.timer == 5000
    assert ring() == [("a", "running", 1, 1, False)] and entry.value[4]  # silent, still open
    assert send(("running", 2, 2)) == [] and not entry.value[4] and entry.timer == 5000
    assert send(("failed", 4, 4), ("completed", 3, 3)) == [("a", "completed", 3, 3, True)] and entry.timer == 9000
    assert send(("running", 5, 5)) == [] and entry.value[:4] == ("completed", 3, 3, True)
    assert ring() == [] and entry.value is None
