"""Column typing, projections by contract and identifier names.

Three type tests are in use and differ on booleans, on purpose:

* :func:`coarse_type`   - profile record: boolean is ``categorical``;
* :func:`numeric_columns` / :func:`categorical_columns` - preprocessing and report selection:
  boolean is in neither;
* :func:`badge` and :func:`counts_as_number` - report badge and problem type: boolean is numeric.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that mark an identifier, searched in the trimmed lower-case column name.
ID_NAME_PATTERNS = (
    r"^id$",
    r"_id$",
    r"^id_",
    r"_id_",
    r"^uuid$",
    r"^guid$",
    r"order.*id",
    r"customer.*id",
    r"user.*id",
    r"transaction.*id",
    r"product.*id",
    r"session.*id",
    r"^index$",
    r"^row.*num",
    r"^serial",
    r"^record.*id",
)

ID_NAME_REGEX = "|".join(f"({p})" for p in ID_NAME_PATTERNS)


def coarse_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def counts_as_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def badge(dtype: T.DataType) -> str:
    return "numeric" if counts_as_number(dtype) else "categorical"


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: coarse_type(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_id_name(name: str) -> bool:
    return re.search(ID_NAME_REGEX, name.lower().strip()) is not None


def id_name_match(name: Column) -> Column:
    """The same rule for a table whose rows are column names."""
    return F.lower(F.trim(name)).rlike(ID_NAME_REGEX)


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"Target column '{name}' not found in dataset")


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require_column(df, target)
    return df.drop(target), df.select(target)


def missing_columns(required: Iterable[str], present: Iterable[str]) -> list[str]:
    """Required names that are absent, in the required order."""
    have = set(present)
    return [c for c in required if c not in have]


def project_features(df: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """Features in fitted order; extra columns are ignored, absent ones are an error."""
    absent = missing_columns(feature_columns, df.columns)
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    return df.select(*[F.col(f"`{c}`") for c in feature_columns])


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN means missing here, so floating columns turn it into NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per column: name, position, coarse type and badge (driver-side schema only)."""
    rows = [
        (f.name, i, coarse_type(f.dataType), badge(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "column_name string, position int, column_type string, badge string"
    )
