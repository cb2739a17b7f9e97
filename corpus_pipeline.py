"""Documents to training tokens: the stages of corpus preparation, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import decontaminate, language, minhash, pieces, suffix
from tabsmith.llm.queries import PIECES, load
from tabsmith.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return minhash.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier are cut out; documents of nothing else go."""
    return suffix.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip of every document left."""
    encoded = pieces.encode(docs, pieces.read_vocabulary(PIECES))
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Bytes of text in one Arrow batch to a Python worker, where the session sets no bound of its own: batches
#: are held several times over (in the executor's buffers and by the worker), for each running task.
BATCH_BYTES = "2m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Language models, suffix sorting and pieces have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written below the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    own = spark.conf.get(_BATCH, None) is None
    if own:
        spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        if own:
            spark.conf.unset(_BATCH)
    return docs
