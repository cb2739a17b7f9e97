"""The statistics jobs every profiling and detection operator is derived from.

``column_facts``: one row per column. Each column is grouped by its own value and the groups are
then folded to one row. A branch reads only its own parquet column, so all branches together read
the table once; the map-side combine sends one record per (task, value) whatever the skew of the
value; and the frequency of the most common value comes out of the same shuffle. One aggregate
holding many ``count_distinct`` would instead copy every input row once per column.

``melted_facts``: the same rows for wide tables. Every row becomes one (column, value) record per column,
counted in one shuffle per kind of columns and folded per column in a second, tiny one, so the plan has at most seven
scans (of different columns) with two aggregates each however many columns there are. ``column_facts`` takes this way beyond ``BRANCH_COLUMNS``.

``value_counts``: (column, value, n) for string columns, where the counts themselves are needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.schema import coarse_type, counts_as_number

# Fixed value: what an identifier-like string looks like.
CODE_REGEX = r"^[A-Za-z0-9\-_]+$"

# Strings of this many bytes or more travel as their 64-character digest. Shorter strings travel as
# they are, so the two kinds of key can never be equal.
DIGEST_FROM_BYTES = 64

# Columns per job when facts are collected on the driver; keeps the plan of a very wide table small.
COLUMNS_PER_JOB = 32

# Up to so many columns a branch per column reads only its own column; beyond, planning the branches
# would take longer than the extra records of one melted scan.
BRANCH_COLUMNS = 64


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def counting_key(name: str, dtype: T.DataType) -> Column:
    """A groupable stand-in for the value: equal exactly when the values are equal."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.StringType):
        return F.when(F.octet_length(c) < DIGEST_FROM_BYTES, c).otherwise(F.sha2(c, 256))
    if isinstance(dtype, T.BinaryType):
        return F.sha2(c, 256)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(c)), 256))
    return c


def _facts_of(df: DataFrame, field: T.StructField, position: int) -> DataFrame:
    c = F.col(f"`{field.name}`")
    text = isinstance(field.dataType, T.StringType)
    number = counts_as_number(field.dataType)
    picked = [counting_key(field.name, field.dataType).alias("v")]
    per_value = [F.count(F.lit(1)).alias("n")]
    if text:
        picked += [F.octet_length(c).alias("len"), c.rlike(CODE_REGEX).alias("code")]
        per_value += [F.max("len").alias("len"), F.bool_or("code").alias("code")]
    groups = df.select(*picked).groupBy("v").agg(*per_value)
    present = F.col("v").isNotNull()
    as_double = F.col("v").cast("double")
    integer = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    whole = F.col("v").cast("bigint")
    return groups.agg(
        F.lit(field.name).alias("column_name"),
        F.lit(position).alias("position"),
        F.lit(field.dataType.simpleString()).alias("data_type"),
        F.lit(coarse_type(field.dataType)).alias("column_type"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.count("v").alias("distinct_count"),
        F.coalesce(F.max(F.when(present, F.col("n"))), F.lit(0)).cast("bigint").alias("top_n"),
        (F.min(as_double) if number else F.lit(None).cast("double")).alias("min_value"),
        (F.max(as_double) if number else F.lit(None).cast("double")).alias("max_value"),
        (
            F.try_subtract(F.max(whole), F.min(whole)) if integer else F.lit(None).cast("bigint")
        ).alias("value_span"),
        # nothing to contradict it: an all-missing number is integer-like
        (
            F.coalesce(F.bool_and(as_double == F.floor(as_double)), F.lit(True))
            if number
            else F.lit(False)
        ).alias("integer_like"),
        (
            F.coalesce(F.sum(F.when(F.col("code"), F.col("n"))), F.lit(0)) if text else F.lit(0)
        ).cast("bigint").alias("code_rows"),
        (F.coalesce(F.max("len"), F.lit(0)) if text else F.lit(0)).cast("bigint").alias("max_bytes"),
    )


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _melted_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, _INTEGERS):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(dtype, _MOMENTS):
        return dtype.simpleString()
    return "text" if isinstance(dtype, T.StringType) else "other"


def _melted(df: DataFrame, kind: str, fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    """The facts of one kind of columns, one row per column, from one shuffle of (position, k) groups.

    k is equal exactly when the values are equal, and as small as the kind allows: the number or moment itself
    for those. The array under the explode holds bare columns and everything else is computed behind it, once for
    all columns: the plan stays small.
    """
    none = {"x": F.lit(None).cast("double"), "whole": F.lit(None).cast("bigint"),
            "len": F.lit(None).cast("int"), "code": F.lit(None).cast("boolean")}
    c, k = F.col("v"), F.col("k")
    values = [F.col(f"`{f.name}`") for _, f in fields]
    kept: dict[str, Column] = {}  # travels beside k: name, value of a record, fold of the records of a group
    folds = {"x": F.max, "len": F.max, "code": F.bool_or}
    key, of_key = c, {}
    if kind == "whole":
        values = [v.cast("bigint") for v in values]
        of_key = {"x": k.cast("double"), "whole": k}
    elif kind == "real":
        values = [v.cast("double") for v in values]
        key, of_key = F.when(~F.isnan(c), c + F.lit(0.0)), {"x": k}  # -0.0 and 0.0 are one value
    elif kind == "text":
        # a digest hides its text; any other key is looked at once a group
        long = F.octet_length(c) >= DIGEST_FROM_BYTES
        key, kept = counting_key("v", T.StringType()), {"len": F.when(long, F.octet_length(c)), "code": F.when(long, c.rlike(CODE_REGEX))}
        of_key = {"len": F.coalesce("len", F.octet_length(k)), "code": F.coalesce("code", k.rlike(CODE_REGEX))}
    elif kind == "other":
        values = []
        for _, f in fields:
            text = counting_key(f.name, f.dataType)
            x = text.cast("double") if counts_as_number(f.dataType) else none["x"]
            values.append(F.struct(text.cast("string").alias("k"), x.alias("x")))
        key, kept = c["k"], {"x": c["x"]}
    places = F.array(*[F.lit(i) for i, _ in fields])
    records = df.select(F.posexplode(F.array(*values)).alias("at", "v")).select("at", key.alias("k"), *[v.alias(n) for n, v in kept.items()])
    groups = records.groupBy("at", "k").agg(F.count(F.lit(1)).alias("n"), *[folds[n](n).alias(n) for n in kept])
    made = {**none, **{n: F.col(n) for n in kept}, **of_key}
    groups = groups.select("at", "n", k.isNotNull().alias("present"), *[v.alias(n) for n, v in made.items()])
    present = F.col("present")
    return groups.groupBy("at").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(present, F.col("n"))).alias("non_null"),
        F.count_if(present).alias("distinct_count"),
        F.max(F.when(present, F.col("n"))).alias("top_n"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.try_subtract(F.max("whole"), F.min("whole")).alias("value_span"),
        F.bool_and(F.col("x") == F.floor("x")).alias("integer_like"),
        F.sum(F.when(F.col("code"), F.col("n"))).alias("code_rows"),
        F.max("len").alias("max_bytes"),
    ).withColumn("position", F.element_at(places, F.col("at") + 1)).drop("at")


def melted_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``column_facts`` from one shuffle of (column, value) groups per kind of columns; lazy.

    Integers, reals, texts, dates, each kind of time and the rest are melted apart, each reading only its own columns.
    """
    wanted = set(df.columns if columns is None else columns)
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name in wanted]
    kinds: dict[str, list] = {}
    for i, f in fields:
        kinds.setdefault(_melted_kind(f.dataType), []).append((i, f))
    folded = union_all([_melted(df, kind, members) for kind, members in kinds.items()])
    # one row per column of the schema, so that an empty table has its columns too
    named = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), coarse_type(f.dataType), counts_as_number(f.dataType)) for i, f in fields],
        "column_name string, position int, data_type string, column_type string, number boolean",
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return named.join(folded, "position", "left").select(
        "column_name", "position", "data_type", "column_type", zero("row_count"), zero("non_null"),
        zero("distinct_count"), zero("top_n"), "min_value", "max_value", "value_span",
        F.when(F.col("number"), F.coalesce("integer_like", F.lit(True))).otherwise(F.lit(False)).alias("integer_like"),
        zero("code_rows"), zero("max_bytes"),
    )


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column; lazy."""
    wanted = set(df.columns if columns is None else columns)
    if len(wanted) > BRANCH_COLUMNS:
        return melted_facts(df, columns)
    parts = [
        _facts_of(df, f, i) for i, f in enumerate(df.schema.fields) if f.name in wanted
    ]
    return union_all(parts)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over the non-missing values of string-like columns."""
    parts = []
    for name in columns:
        c = F.col(f"`{name}`")
        parts.append(
            df.where(c.isNotNull())
            .groupBy(c.cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("column_name"), "value", "n")
        )
    return union_all(parts)
