"""Model packages on shared storage: pipeline, dictionary, labels and one metadata row."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from tabsmith.operators.models import Package

SUFFIX = ".model"
REQUIRED = ("problem_type", "target", "feature_columns", "categorical_columns", "medians", "best_estimator")


def save_package(package: Package, path: str) -> None:
    """Write a package directory, replacing one that is there."""
    if not path.endswith(SUFFIX):
        raise ValueError(f"Expected a path ending in {SUFFIX}, got: {path}")
    package.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    meta = {
        "problem_type": package.problem_type, "target": package.target,
        "feature_columns": package.feature_columns, "categorical_columns": package.categorical_columns,
        "numeric_columns": package.numeric_columns, "medians": package.medians,
        "label_is_text": package.label_is_text, "importance": package.importance,
        "best_estimator": package.best_estimator, "sizes": package.sizes,
        "has_dictionary": package.dictionary is not None, "has_labels": package.labels is not None,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/metadata")
    if package.dictionary is not None:
        package.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    if package.labels is not None:
        package.labels.write.mode("overwrite").parquet(f"{path}/labels")


def load_package(path: str) -> Package:
    if not path.endswith(SUFFIX):
        raise ValueError(f"Expected a path ending in {SUFFIX}, got: {path}")
    spark = SparkSession.active()
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    except AnalysisException as e:
        raise FileNotFoundError(f"Model package not found: {path}") from e
    for key in REQUIRED:
        if key not in meta:
            raise ValueError(f"Invalid model package: missing '{key}'")
    return Package(
        pipeline=PipelineModel.load(f"{path}/pipeline"),
        problem_type=meta["problem_type"], target=meta["target"], feature_columns=meta["feature_columns"],
        categorical_columns=meta["categorical_columns"], numeric_columns=meta.get("numeric_columns", []),
        medians=meta["medians"],
        dictionary=spark.read.parquet(f"{path}/dictionary") if meta.get("has_dictionary") else None,
        labels=spark.read.parquet(f"{path}/labels") if meta.get("has_labels") else None,
        label_is_text=meta.get("label_is_text", False),
        importance=[(f, v) for f, v in meta.get("importance", [])],
        best_estimator=meta["best_estimator"],
        sizes={c: tuple(v) for c, v in meta.get("sizes", {}).items()},
    )
