"""Session helpers: a local session for tests and benches, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "tabsmith", memory: str = "12g") -> SparkSession:
    """Session for tests and benches only; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session (tests) is a folder of our own used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        configured = context.getCheckpointDir()
        if configured is None and not context.master.startswith(("local[", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = configured or tempfile.mkdtemp(prefix="tabsmith-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a table this job writes."""
    return f"{shared_dir(spark).rstrip('/')}/tabsmith/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives lost executors) and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
