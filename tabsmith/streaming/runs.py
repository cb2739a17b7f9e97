"""Following runs until they end, as a stream of status events.

Each batch folds its events together with the open runs of the batch before. Runs that ended go to
the finished table and leave the carried state, so the state holds open runs only. Every batch writes
its own directories, named by batch number, so a batch that is repeated after a failure replaces
exactly what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabsmith.operators.ledger import TERMINAL

COLUMNS = ("job_id", "status", "ts", "event_id")


class RunFollower:
    """``step`` is the foreachBatch function; ``path`` holds the two tables it keeps."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _table(self, spark: SparkSession, name: str, schema) -> DataFrame:
        return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def step(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        # an event without a status is a sign of life and changes nothing that is followed
        events = rows.where(F.col("status").isNotNull()).select(*COLUMNS)
        if batch > 0:
            stored = T.StructType([*events.schema.fields, T.StructField("batch", T.IntegerType())])
            earlier = self._table(spark, "finished", stored).where(F.col("batch") < batch)
            carried = self._table(spark, "open", stored).where(F.col("batch") == batch - 1)
            # a run that has ended is no longer followed
            events = events.join(earlier.select("job_id"), "job_id", "left_anti").select(*COLUMNS)
            events = events.unionByName(carried.select(*COLUMNS))
        # one event per run is kept: its end, or its newest
        order = F.struct("ts", "event_id")
        whole = F.struct("status", "ts", "event_id")
        ended = F.col("status").isin(*TERMINAL)
        kept = (
            events.groupBy("job_id")
            .agg(F.coalesce(F.min_by(whole, F.when(ended, order)), F.max_by(whole, order)).alias("e"))
            .select("job_id", "e.status", "e.ts", "e.event_id")
        )
        kept.persist()
        try:
            kept.where(ended).write.mode("overwrite").parquet(f"{self.path}/finished/batch={batch}")
            kept.where(~ended).write.mode("overwrite").parquet(f"{self.path}/open/batch={batch}")
        finally:
            kept.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.start()

    def result(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """Ended runs and the runs still open after ``last_batch``."""
        parts = []
        for name, ended in (("finished", True), ("open", False)):
            table = spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
            upto = F.col("batch") <= last_batch if ended else F.col("batch") == last_batch
            parts.append(table.where(upto).select("job_id", "status", "ts", F.lit(ended).alias("finished")))
        return parts[0].unionByName(parts[1])
