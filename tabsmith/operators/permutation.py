"""Permutation importance: what a model loses when one feature is exchanged between held-out rows.

Works for every model, also those without importances of their own. All features and repetitions are
scored in one pass: rows get dense numbers, every (feature, repetition) has its own permutation of these
numbers, each row sends its values along them, and the copies with one value exchanged are scored once.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import scratch_path

REPEATS = 5
SEED = 17
#: Multipliers tried per permutation; the one that mixes neighbouring rows best is taken.
TRIED = 16


@dataclass(frozen=True)
class Step:
    """Row number k sends to (multiplier * k + offset) mod n, which is a permutation of 0..n-1."""

    multiplier: int
    offset: int

    def target(self, k: int, n: int) -> int:
        return (self.multiplier * k + self.offset) % n


def _roughness(a: int, n: int) -> int:
    """Largest partial quotient of a/n: small where no few steps of ``a`` come back close to the start."""
    worst = 0
    while a:
        worst = max(worst, n // a)
        a, n = n % a, a
    return worst


def permutations(features: int, repeats: int, n: int, seed: int = SEED) -> list[Step]:
    """One step per (repetition, feature), features running fastest; the same for the same arguments."""
    draw = random.Random(seed)
    steps = []
    for _ in range(features * repeats):
        tried = [a for a in (draw.randrange(1, max(n, 2)) for _ in range(TRIED)) if math.gcd(a, n) == 1] or [1]
        steps.append(Step(min(tried, key=lambda a: _roughness(a, n)), draw.randrange(max(n, 1))))
    return steps


def number_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a dense number ``__k``, and how many there are. No global sort: rows are numbered within
    their partition and stored, then shifted by the sizes of the partitions before (one number each)."""
    path = scratch_path(df.sparkSession, "numbered")
    df.withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    part = F.shiftright("__m", 33)
    sizes = sorted(tuple(r) for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, n = [], 0
    for p, size in sizes:
        before.append((p, n))
        n += size
    offsets = df.sparkSession.createDataFrame(before, "p bigint, before bigint")
    within = F.col("__m").bitwiseAND((1 << 33) - 1)
    return stored.join(F.broadcast(offsets), part == F.col("p")).withColumn("__k", F.col("before") + within).drop("__m", "p", "before"), n


def _with_loss(model: Model, rows: DataFrame, classification: bool) -> DataFrame:
    """The rows with ``__loss``: 1 for a wrong class, the squared error of a number."""
    scored = model.transform(rows.withColumn("features", array_to_vector("__x")))
    gap = F.col("prediction") - F.col("__y")
    return scored.select(*rows.columns, ((gap != 0).cast("double") if classification else gap * gap).alias("__loss"))


def permutation_importance(
    model: Model,
    held_out: DataFrame,
    features: Sequence[str],
    label: str,
    classification: bool,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """feature, importance, std_error (of the mean over the repetitions), rows; largest first.

    ``held_out`` has a vector ``features`` and ``label``; rows without a label are left out. The importance
    is the fall of the accuracy, or of R2 for a regression (NULL where the label does not vary). A feature
    the model does not use gets exactly 0. No rows or no features: an empty result.
    """
    spark, d = held_out.sparkSession, len(features)
    empty = spark.createDataFrame([], "feature string, importance double, std_error double, rows bigint")
    if d == 0:
        return empty
    rows, n = number_rows(
        held_out.where(F.col(label).isNotNull())
        .select(vector_to_array("features").alias("__x"), F.col(label).cast("double").alias("__y"))
    )
    if n == 0:
        return empty
    steps = permutations(d, repeats, n, seed)
    wide = "bigint" if n < 3_000_000_000 else "decimal(38,0)"  # the product must not overflow
    factor = F.array(*[F.lit(s.multiplier) for s in steps])
    shift = F.array(*[F.lit(s.offset) for s in steps])

    def message(j):
        target = F.pmod(F.get(factor, j).cast(wide) * F.col("__k").cast(wide) + F.get(shift, j).cast(wide), F.lit(n).cast(wide))
        return F.struct(j.alias("j"), target.cast("bigint").alias("to"), F.get("__x", j % d).alias("v"))

    sent = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(steps) - 1)), message)).alias("s")).select("s.*")
    own = _with_loss(model, rows, classification).withColumnRenamed("__loss", "__own")
    changed = sent.join(own, sent["to"] == own["__k"]).select(
        "j", "__y", "__own", F.transform("__x", lambda v, i: F.when(i == F.col("j") % d, F.col("v")).otherwise(v)).alias("__x"))
    # taken row by row, so that equal predictions add up to exactly nothing
    fall = F.sum(F.col("__loss") - F.col("__own"))
    scale = F.lit(float(n)) if classification else rows.agg(F.nullif(F.var_pop("__y") * n, F.lit(0.0)).alias("s")).scalar()
    # one row per (feature, repetition)
    each = _with_loss(model, changed, classification).groupBy("j").agg(fall.alias("fall")).select(
        (F.col("j") % d).alias("f"), (F.col("fall") / scale).alias("fall"))
    label_of = F.array(*[F.lit(c) for c in features])
    return each.groupBy("f").agg(
        F.avg("fall").alias("importance"), (F.stddev_samp("fall") / math.sqrt(repeats)).alias("std_error")
    ).select(F.get(label_of, F.col("f")).alias("feature"), "importance", "std_error", F.lit(n).cast("bigint").alias("rows")
             ).orderBy(F.col("importance").desc(), "feature")
