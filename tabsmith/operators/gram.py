"""Correlations of hundreds or thousands of columns from blocked products of the table with itself.

``profile.correlation_matrix`` writes one sum per pair into an aggregate, which suits tens of columns.
Here every task multiplies its rows, as a matrix shifted by the column means and with gaps as zeros, by
themselves and by their mask, and only these products travel, out of Python workers: a hundred thousand
sums are no expression for generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.schema import numeric_columns
from tabsmith.operators.facts import union_all
from tabsmith.operators.profile import as_double

#: Columns of a block. A task holds six products of two blocks, 12 MB, whatever the table's width.
BLOCK = 512
#: Tasks that send products, so that what is shuffled has a bound; each reads as many splits as it takes.
SENDERS = 4096
#: A spread below this share of the raw second moment is rounding: the column does not vary.
ROUNDING = 1e-12

_SUMS = ("n", "sx", "qx", "sy", "qy", "p")


def _products(left: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: one row per column of the left block with its six rows of sums, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            a, b, ma, mb = x[:, :left], x[:, left:], m[:, :left], m[:, left:]
            part = np.stack([ma.T @ mb, a.T @ mb, (a * a).T @ mb, ma.T @ b, ma.T @ (b * b), a.T @ b])
            total = part if total is None else total + part
        if total is not None:
            rows = np.ascontiguousarray(total.transpose(1, 0, 2)).reshape(left, -1)
            ends = np.arange(left + 1, dtype=np.int32) * rows.shape[1]
            sums = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(left, dtype=np.int32)), sums], names=["i", "sums"])

    return run


def _cells(width: int) -> Column:
    """The sums of one left column, a struct per right column."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.struct(j.alias("j"), *[F.get("sums", j + k * width).alias(name) for k, name in enumerate(_SUMS)]),
    )


def _means(df: DataFrame, names: Sequence[str]) -> list[float]:
    clean = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(names)])
    row = clean.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(names))]).first()
    return [0.0 if v is None else float(v) for v in row]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Long form of the Pearson matrix: left_column, right_column, correlation.

    A pair is taken over rows where both are present; NULL where it has no such row or one of the two does
    not vary over them; 1 for a varying column with itself. One job for the means and one per pair of
    blocks, so one for up to ``block`` columns; each reads the columns of its two blocks only.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "left_column string, right_column string, correlation double")
    means = _means(df, names)
    starts = range(0, len(names), block)
    parts = []
    for s in starts:
        for t in (u for u in starts if u >= s):
            left, right = names[s : s + block], names[t : t + block]
            shifted = [
                (as_double(names[k]) - F.lit(means[k])).alias(f"x{j}")
                for j, k in enumerate([*range(s, s + len(left)), *range(t, t + len(right))])
            ]
            sent = df.select(*shifted).coalesce(SENDERS).mapInArrow(_products(len(left)), "i int, sums array<double>")
            folded = sent.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
            parts.append(
                folded.select((F.col("i") + s).alias("i"), F.explode(_cells(len(right))).alias("c"))
                .select("i", (F.col("c.j") + t).alias("j"), *[f"c.{name}" for name in _SUMS])
                .where(F.col("i") <= F.col("j"))
            )
    n = F.col("n")
    vx, vy = F.col("qx") - F.col("sx") * F.col("sx") / n, F.col("qy") - F.col("sy") * F.col("sy") / n
    varied = (n > 0) & (vx > F.col("qx") * ROUNDING) & (vy > F.col("qy") * ROUNDING)
    r = (F.col("p") - F.col("sx") * F.col("sy") / n) / (F.sqrt(vx) * F.sqrt(vy))
    value = F.when(varied, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    label = F.array(*[F.lit(c) for c in names])
    once = union_all(parts).select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"),
                                   (F.col("i") == F.col("j")).alias("own"), value.alias("r"))
    pair = F.struct(F.col("a").alias("left_column"), F.col("b").alias("right_column"), F.col("r").alias("correlation"))
    back = F.struct(F.col("b").alias("left_column"), F.col("a").alias("right_column"), F.col("r").alias("correlation"))
    return once.select(F.explode(F.when(F.col("own"), F.array(pair)).otherwise(F.array(pair, back))).alias("r")).select("r.*")
