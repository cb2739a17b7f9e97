"""Profiles that follow a growing dataset: new files are read once, old ones never again.

Per batch of files and column one row of mergeable state is stored: counts, the first two moments,
extremes, a HyperLogLog sketch for distinct values and a KLL sketch for quantiles. Merging rows of state
is merging batches, so a profile costs the new files plus one small row per batch and column.
``profile.column_stats`` and ``profile.describe`` stay the exact way; only distinct counts and quantiles
are approximate here, within ``DISTINCT_ERROR`` and ``RANK_ERROR``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.schema import coarse_type
from tabsmith.operators.facts import counting_key, union_all
from tabsmith.operators.profile import as_double, melt, missing_pct
from tabsmith.sources.tables import discover

# 2^12 registers: standard error 1.04 / sqrt(4096) = 1.6 %; three of them are stated.
LG_REGISTERS = 12
DISTINCT_ERROR = 3 * 1.04 / (1 << LG_REGISTERS) ** 0.5

# Published rank error of a KLL sketch at 99 % confidence, 2.296 / k^0.9723; twice that is stated.
KLL_SIZE = 400
RANK_ERROR = 2 * 2.296 / KLL_SIZE**0.9723

# Columns sketched in one aggregate; the buffers of one task hold two sketches per column.
COLUMNS_PER_AGGREGATE = 64

STATE = (
    "column_name", "position", "column_type", "row_count", "non_null", "distinct_sketch",
    "numbers", "mean", "m2", "min_value", "max_value", "quantile_sketch",
)
QUARTILES = (0.25, 0.5, 0.75)


def _distinct_key(field: T.StructField) -> Column:
    """64-bit stand-in of a value; both zeros of a float are one value, as in grouping."""
    key = counting_key(field.name, field.dataType)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        key = key + F.lit(0.0)
    return F.when(key.isNotNull(), F.xxhash64(key))


def sketch_columns(df: DataFrame) -> DataFrame:
    """One row of state per column; one pass over the table, partial sketches merged on the way."""
    parts = []
    fields = list(enumerate(df.schema.fields))
    for start in range(0, len(fields), COLUMNS_PER_AGGREGATE):
        chunk = fields[start : start + COLUMNS_PER_AGGREGATE]
        picked, aggs, rows = [], [F.count(F.lit(1)).alias("rows")], []
        for i, f in chunk:
            number = coarse_type(f.dataType) == "numeric"
            picked.append(_distinct_key(f).alias(f"k{i}"))
            aggs += [F.count(f"k{i}").alias(f"n{i}"), F.hll_sketch_agg(f"k{i}", LG_REGISTERS).alias(f"h{i}")]
            if number:
                picked.append(as_double(f.name).alias(f"v{i}"))
                aggs += [
                    F.count(f"v{i}").alias(f"c{i}"), F.avg(f"v{i}").alias(f"a{i}"),
                    (F.var_pop(f"v{i}") * F.count(f"v{i}")).alias(f"q{i}"), F.min(f"v{i}").alias(f"lo{i}"),
                    F.max(f"v{i}").alias(f"hi{i}"), F.kll_sketch_agg_double(f"v{i}", KLL_SIZE).alias(f"s{i}"),
                ]
            none = F.lit(None).cast("double")
            rows.append([
                F.lit(f.name), F.lit(i), F.lit(coarse_type(f.dataType)), F.col("rows"), F.col(f"n{i}"), F.col(f"h{i}"),
                *([F.col(f"{p}{i}") for p in ("c", "a", "q", "lo", "hi")] if number else [F.lit(0).cast("bigint"), none, none, none, none]),
                F.when(F.col(f"c{i}") > 0, F.col(f"s{i}")) if number else F.lit(None).cast("binary"),
            ])
        parts.append(melt(df.select(*picked).agg(*aggs), rows, STATE))
    return union_all(parts)


def merge_sketches(state: DataFrame) -> DataFrame:
    """State of several batches (column ``batch``) folded to one row per column.

    A column that a batch does not have is missing in all its rows. A column whose type differs between
    batches is categorical. Moments are combined around the common mean, so nothing cancels.
    """
    sizes = state.groupBy("batch").agg(F.max("row_count").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows")).scalar()
    numbers = F.sum("numbers")
    whole = state.groupBy("column_name").agg(
        F.min("position").alias("position"),
        F.when(F.min("column_type") == F.max("column_type"), F.max("column_type")).otherwise("categorical").alias("column_type"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        numbers.alias("numbers"),
        F.when(numbers > 0, F.sum(F.col("mean") * F.col("numbers")) / numbers).alias("mean"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.when(numbers > 0, F.kll_merge_agg_double("quantile_sketch", KLL_SIZE)).alias("quantile_sketch"),
    )
    gap = F.col("mean") - F.col("common")
    spread = (
        state.join(whole.select("column_name", F.col("mean").alias("common")), "column_name")
        .groupBy("column_name").agg(F.sum(F.col("m2") + F.col("numbers") * gap * gap).alias("m2"))
    )
    return whole.join(spread, "column_name").withColumn("row_count", total).select(*STATE)


def approximate_stats(merged: DataFrame) -> DataFrame:
    """``column_stats`` from merged state; the distinct count is estimated, everything else exact."""
    missing = F.col("row_count") - F.col("non_null")
    return merged.select(
        "column_name", "column_type", F.hll_sketch_estimate("distinct_sketch").alias("unique_count"),
        missing.alias("missing"), missing_pct(missing, F.col("row_count")).alias("missing_pct"), "row_count", "position",
    )


def approximate_describe(merged: DataFrame) -> DataFrame:
    """``describe`` of the numeric columns from merged state; only the quartiles are estimated."""
    quantiles = [
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(f"p{int(q * 100)}")
        for q in QUARTILES
    ]
    return merged.where(F.col("column_type") == "numeric").select(
        "column_name", F.col("numbers").alias("count"), "mean",
        F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1))).alias("std"),
        F.col("min_value").alias("min"), *quantiles, F.col("max_value").alias("max"),
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def known_files(spark: SparkSession, store: str) -> DataFrame:
    """path, length, modificationTime and batch of every file in the profile."""
    return _stored(spark, f"{store}/files", "path string, length bigint, modificationTime timestamp, batch string")


def new_files(spark: SparkSession, store: str, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Files below ``root`` that the profile has not seen. A file that was rewritten since is an error when
    consumed: its old rows are inside the sketches and cannot be taken out."""
    known = known_files(spark, store).select("path", F.col("length").alias("l"), F.col("modificationTime").alias("m"), F.lit(True).alias("known"))
    found = discover(spark, root, pattern).join(known, "path", "left")
    same = (F.col("l") == F.col("length")) & (F.col("m") == F.col("modificationTime"))
    changed = F.concat(F.lit("rewritten since it was profiled: "), F.col("path"))
    return found.where(
        F.when(F.col("known").isNull(), True).when(same, False).otherwise(F.raise_error(changed).cast("boolean"))
    ).select("path", "length", "modificationTime")


def update_profile(spark: SparkSession, store: str, root: str, pattern: str = "*.parquet", reader: str = "parquet") -> list[str]:
    """Takes the new files below ``root`` into the profile at ``store``; returns their paths (none: no job on data).

    The state of a batch is written before its files are listed as known. A run that is lost in between
    leaves a batch nobody refers to, which is ignored, and its files are taken again. One updater at a time.
    """
    files = new_files(spark, store, root, pattern).collect()
    paths = sorted(f["path"] for f in files)
    if not paths:
        return []
    batch = f"b-{uuid.uuid4().hex}"
    data = spark.read.format(reader).option("mergeSchema", True).load(paths)
    sketch_columns(data).withColumn("batch", F.lit(batch)).coalesce(1).write.parquet(f"{store}/sketches/{batch}")
    # what was listed before the data were read, so a file that came later stays new
    listed = spark.createDataFrame(files, "path string, length bigint, modificationTime timestamp")
    listed.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{store}/files")
    return paths


def current_profile(spark: SparkSession, store: str) -> DataFrame:
    """Merged state of every batch the list of files refers to."""
    batches = known_files(spark, store).select("batch").distinct()
    state = spark.read.option("recursiveFileLookup", True).parquet(f"{store}/sketches")
    return merge_sketches(state.join(batches, "batch", "left_semi"))


def rank_bounds(df: DataFrame, column: str, values: Sequence[float]) -> list[tuple[float, float]]:
    """Exact share of values below and up to each given value: where its true rank lies."""
    v = as_double(column)
    aggs = [F.count(v).alias("n")]
    for i, x in enumerate(values):
        aggs += [F.count_if(v < x).alias(f"b{i}"), F.count_if(v <= x).alias(f"u{i}")]
    row = df.agg(*aggs).first()
    return [(row[f"b{i}"] / row["n"], row[f"u{i}"] / row["n"]) for i in range(len(values))]
