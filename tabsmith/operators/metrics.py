"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(y, p, n): classes squared rows, counted in every task before the shuffle."""
    return df.groupBy(
        F.col(actual).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))


def per_class(table: DataFrame) -> DataFrame:
    """Actual, predicted and correct counts of each class, with precision, recall and f1 (0 on 0/0)."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("correct")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("correct")),
    )
    sums = table.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("actual", "predicted", "correct")]
    )
    zero = F.lit(0.0)
    return sums.select(
        "class", "actual", "predicted", "correct",
        F.coalesce(F.col("correct") / F.nullif("predicted", F.lit(0)), zero).alias("precision"),
        F.coalesce(F.col("correct") / F.nullif("actual", F.lit(0)), zero).alias("recall"),
        (2 * F.col("correct") / (F.col("actual") + F.col("predicted"))).alias("f1"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted f1, precision and recall; one row."""
    c = per_class(confusion(df, actual, predicted))
    total = F.sum("actual")
    return c.agg(
        (F.sum("correct") / total).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("actual")) / total).alias("f1_score"),
        (F.sum(F.col("precision") * F.col("actual")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("actual")) / total).alias("recall"),
    )


def binary_f1(df: DataFrame, actual: str, predicted: str, positive: str = "1") -> DataFrame:
    """f1 of the positive class; one row."""
    c = per_class(confusion(df, actual, predicted))
    return c.agg(F.coalesce(F.max(F.when(F.col("class") == positive, F.col("f1"))), F.lit(0.0)).alias("f1"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R2, RMSE and MAE; a constant target scores 1 when met exactly, else 0. One aggregate."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("spread"), F.avg(F.abs(y - p)).alias("mae")
    )
    fit = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.nullif("spread", F.lit(0.0))).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(fit.alias("r2_score"), F.sqrt("mse").alias("rmse"), "mae")
