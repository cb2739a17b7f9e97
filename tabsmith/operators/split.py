"""Deterministic exact train/test split.

A row is in the test part exactly when the hash of its key is at most a threshold of its class: the
k-th smallest hash, k being the class's share of ``ceil(test_size * rows)`` by largest remainder. So
the split needs one number per class and the rows themselves are never sorted or shuffled:

1. count rows per (class, hash prefix) - pre-aggregated in every task;
2. find the prefix in which the k-th hash lies;
3. rank only the rows of that prefix, whose number is bounded by the prefix length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.lookup import BROADCAST_ENTRIES, lookup
from tabsmith.session import cut_lineage

ROWS_PER_PREFIX = 100_000
MAX_PREFIX = 6
MISSING_KEY = "\0missing"


def key_hash(keys: Sequence[str] | Column) -> Column:
    """Hex hash that orders the rows: of one key column's text, or of several joined by ``|``.

    A missing part counts as a text of its own, so rows without a key have an ordinary place.
    """
    if isinstance(keys, Column):
        return F.md5(F.coalesce(keys.cast("string"), F.lit(MISSING_KEY)))
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(MISSING_KEY)) for k in keys]
    return F.md5(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts))


def _prefix_length(rows: int) -> int:
    return min(MAX_PREFIX, max(1, math.ceil(math.log(max(rows, 16) / ROWS_PER_PREFIX, 16))))


def allocate(sizes: DataFrame, rows: int, test_rows: int) -> DataFrame:
    """Test rows per class by largest remainder; ties in the order of the class hash.

    ``sizes`` has one row per class. The extra rows go to a global top-k of the remainders (a
    distributed take-ordered), not to a window over all classes.
    """
    # whole-number arithmetic: equal remainders must compare equal, and rows * rows must not overflow
    share = f"CAST(n AS DECIMAL(19,0)) * CAST({test_rows} AS DECIMAL(19,0))"
    whole = f"CAST({rows} AS DECIMAL(19,0))"
    floors = sizes.withColumn("base", F.expr(f"({share}) div {whole}")).withColumn(
        "rest", F.expr(f"({share}) % {whole}")
    )
    left = test_rows - (floors.agg(F.sum("base").alias("s")).first()["s"] or 0)
    if left <= 0:
        return floors.select("class", "n", F.col("base").alias("take"))
    extra = (
        floors.orderBy(F.col("rest").desc(), F.md5("class")).limit(int(left))
        .select(F.col("class").alias("lucky"), F.lit(1).alias("plus"))
    )
    return floors.join(extra, F.col("class") == F.col("lucky"), "left").select(
        "class", "n", (F.col("base") + F.coalesce("plus", F.lit(0))).alias("take")
    )


def thresholds(
    df: DataFrame, keys: Sequence[str] | Column, label: Column | None, test_size: float
) -> tuple[DataFrame, int]:
    """(class, threshold hash) and the number of classes."""
    label = F.lit("all") if label is None else F.coalesce(label.cast("string"), F.lit("nan"))
    slim = df.select(label.alias("class"), key_hash(keys).alias("h"))
    rows = df.count()
    length = _prefix_length(rows)
    slim = slim.withColumn("prefix", F.substring("h", 1, length))
    counts = cut_lineage(slim.groupBy("class", "prefix").agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy("class").agg(F.sum("c").alias("n"))
    take = allocate(sizes, rows, math.ceil(test_size * rows))
    summary = take.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    if summary["k"] > 1 and summary["least"] < 2:
        raise ValueError("The least populated class has only 1 member; a stratified split needs 2")
    upto = Window.partitionBy("class").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        counts.withColumn("cum", F.sum("c").over(upto))
        .join(take.where("take > 0").select("class", "take"), "class")
        .where("cum >= take AND cum - c < take")
        .select(F.concat_ws("|", "class", "prefix").alias("edge"),
                (F.col("take") - (F.col("cum") - F.col("c"))).alias("k"))
    )
    bounded = (summary["k"], summary["k"] * 64) if summary["k"] <= BROADCAST_ENTRIES else None
    near = lookup(
        slim.withColumn("spot", F.concat_ws("|", "class", "prefix")), edge,
        F.col("spot"), "edge", "k", size=bounded,
    ).where("k IS NOT NULL")
    order = Window.partitionBy("class").orderBy("h")
    found = near.withColumn("rn", F.row_number().over(order)).where("rn = k")
    return cut_lineage(found.select("class", F.col("h").alias("threshold"))), summary["k"]


def train_test_split(
    df: DataFrame,
    keys: Sequence[str] | Column,
    target: str | None = None,
    test_size: float = 0.2,
    column: str = "_split",
) -> DataFrame:
    """``df`` plus ``column`` = train / test; stratified by ``target`` when given.

    ``keys`` should identify rows: rows sharing a key (all rows without one, too) land on the same side,
    so the test part has at least, not exactly, its share when such rows lie on the edge.
    """
    label = None if target is None else F.col(f"`{target}`")
    cut, classes = thresholds(df, keys, label, test_size)
    is_test = key_hash(keys) <= F.col("threshold")
    if target is None:
        row = cut.first()
        bound = F.lit(row["threshold"] if row else "")
        return df.withColumn(column, F.when(key_hash(keys) <= bound, "test").otherwise("train"))
    size = (classes, classes * 64) if classes <= BROADCAST_ENTRIES else None
    probe = F.coalesce(label.cast("string"), F.lit("nan"))
    return lookup(df, cut, probe, "class", "threshold", size=size).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(is_test, "test").otherwise("train").alias(column),
    )
