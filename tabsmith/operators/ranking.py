"""Ranks inside groups of any size without sorting a group in one task.

Up to ``WINDOW_ROWS`` rows a plain window is used. Beyond it, ordered split points taken from a small
sample cut every group into buckets; bucket totals (a few rows per group) give each bucket its offset
and the window runs inside one bucket. The sample decides only how even the buckets are: the ranks
are exact whatever it contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage

WINDOW_ROWS = 1_000_000
MAX_SPLITS = 1_000
SAMPLE_PER_SPLIT = 20
# split points compare on this much of a value; longer common beginnings only make buckets uneven
PREFIX_CHARS = 512


def rank_distinct(
    values: DataFrame, group: str, value: str, rank: str, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """0-based rank of distinct string ``value`` in code point order inside ``group``."""
    # one row per value is needed twice below, and once more by the caller
    values = cut_lineage(values)
    total = values.count()
    if total <= window_rows:
        w = Window.partitionBy(group).orderBy(value)
        return values.withColumn(rank, (F.row_number().over(w) - 1).cast("int"))
    splits = min(MAX_SPLITS, 2 * total // window_rows + 1)
    fraction = min(1.0, splits * SAMPLE_PER_SPLIT / total)
    prefix = F.substring(F.col(value), 1, PREFIX_CHARS)
    sample = sorted(
        {r["p"] for r in values.sample(fraction, seed=7).select(prefix.alias("p")).collect()}
    )
    every = max(1, len(sample) // splits)
    points = sample[every::every]
    bucket = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= prefix)) if points else F.lit(0)
    cut = values.withColumn("__bucket", bucket)
    sizes = cut.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__bucket").orderBy(value)
    ranked = cut.withColumn("__rn", F.row_number().over(inside))
    # at most MAX_SPLITS + 1 buckets per group; the groups are the encoded columns of one table
    return (
        ranked.join(F.broadcast(offsets), [group, "__bucket"])
        .withColumn(rank, (F.col("__before") + F.col("__rn") - 1).cast("int"))
        .drop("__bucket", "__rn", "__before")
    )
