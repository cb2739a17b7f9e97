"""The training job: read, explore, prepare, search, evaluate, report, save, record."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.schema import require_column
from tabsmith.operators.models import TrainingRun, run_training
from tabsmith.operators.prepare import feature_metadata
from tabsmith.operators.report import eda_minimal, eda_report, training_report
from tabsmith.sources.packages import save_package
from tabsmith.sources.records import complete_run

STATUS_SCHEMA = "job_id string, status string, ts timestamp, event_id bigint, message string"


@dataclass
class JobPaths:
    """Where one workspace keeps its tables; ``root`` is on shared storage."""

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/status_events"

    @property
    def records(self) -> str:
        return f"{self.root}/records"

    def artifact(self, job_id: str, name: str) -> str:
        return f"{self.root}/{job_id}/{name}"


def write_status(spark: SparkSession, paths: JobPaths, job_id: str, step: int, status: str, message: str | None = None) -> None:
    """Append one status event; ``step`` orders events of the same instant."""
    row = spark.createDataFrame([(job_id, status, step, message)], "job_id string, status string, event_id bigint, message string")
    row.select("job_id", "status", F.current_timestamp().alias("ts"), "event_id", "message").coalesce(1).write.mode("append").parquet(paths.events)


def status_events(spark: SparkSession, paths: JobPaths) -> DataFrame:
    return spark.read.schema(STATUS_SCHEMA).parquet(paths.events)


def explore(df: DataFrame, target: str, path: str) -> None:
    """The exploratory report; whatever goes wrong in it, the minimal one is written instead."""
    try:
        eda_report(df, target).write.mode("overwrite").parquet(path)
    except Exception:  # noqa: BLE001 - a report must not stop the job
        eda_minimal(df).write.mode("overwrite").parquet(path)


def training_job(
    df: DataFrame,
    target: str,
    keys: Sequence[str] | Column,
    root: str,
    budget_s: float | None = None,
    metric: str = "auto",
    families: list[tuple[str, Estimator]] | None = None,
    job_id: str | None = None,
) -> TrainingRun:
    """Run a job and leave its tables below ``root``; a failure is recorded with its message and raised."""
    spark, paths, job = df.sparkSession, JobPaths(root), job_id or uuid.uuid4().hex
    write_status(spark, paths, job, 0, "pending")
    try:
        write_status(spark, paths, job, 1, "running")
        require_column(df, target)
        explore(df, target, paths.artifact(job, "eda"))
        run = run_training(df, target, keys, budget_s, metric, families=families, job_id=job)
        package = run.package
        training_report(
            spark, job, package.problem_type, run.metrics, package.importance, package.feature_columns,
            run.prepared.dropped, run.config,
        ).write.mode("overwrite").parquet(paths.artifact(job, "training"))
        save_package(package, paths.artifact(job, "package.model"))
        complete_run(
            spark, job, target, package.problem_type, run.metrics, package.feature_columns,
            run.prepared.dropped, feature_metadata(run.prepared), paths.artifact(job, "package.model"),
            paths.artifact(job, "eda"), paths.artifact(job, "training"), paths.artifact(job, "package.model"),
        ).write.mode("append").parquet(paths.records)
        write_status(spark, paths, job, 2, "completed")
        return run
    except Exception as e:
        write_status(spark, paths, job, 2, "failed", str(e))
        raise
