"""Scalar expressions: bands, time, decimals, text-to-number coercion, request maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metric_band(value: Column) -> Column:
    """Colour band of a metric in [0, 1]; NULL stays NULL."""
    return (
        F.when(value >= 0.9, "high").when(value >= 0.7, "medium").when(value.isNotNull(), "low")
    )


def accuracy_band(value: Column) -> Column:
    return F.when(value >= 0.9, "excellent").when(value >= 0.7, "good").otherwise("moderate")


def r2_band(value: Column) -> Column:
    """No statement is made below 0.5."""
    return F.when(value >= 0.8, "excellent").when(value >= 0.5, "moderate")


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to timestamp; a string without zone is UTC."""
    zoned = text.endswith("Z") | text.contains("+") | F.substring(text, 11, 100).contains("-")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a timestamp in the session zone, which this library expects to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def elapsed_s(start: Column, end: Column) -> Column:
    """Whole seconds, rounded down; NULL when the clock ran backwards."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)
    return F.when(seconds >= 0, seconds)


def placeholder(lo: Column, hi: Column) -> Column:
    """Example value of a number: the middle of its range, halves upwards."""
    return F.floor((lo + hi) / 2 + 0.5).cast("bigint")


def bar_width(pct: Column) -> Column:
    return F.when(pct.isNotNull(), F.least(pct, F.lit(100.0)))


# Fixed value: how a number is written.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def to_number(text: Column) -> Column:
    """The number a text holds, or NULL; type letters as in ``12d`` make no number."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def integer_violation(text: Column) -> Column:
    """An integer feature rejects a decimal point and scientific notation."""
    t = F.lower(F.trim(text))
    return (t != "") & (t.contains(".") | t.contains("e") | to_number(text).isNull())


def coerce_features(
    df: DataFrame, columns: Sequence[str], integer_columns: Sequence[str] = ()
) -> DataFrame:
    """Adds ``<c>_number`` and ``<c>_error``; the text itself is kept."""
    out = {}
    for c in columns:
        text = F.col(f"`{c}`")
        bad = F.coalesce(integer_violation(text), F.lit(False)) if c in integer_columns else F.lit(False)
        out[f"{c}_number"] = F.when(~bad, to_number(text))
        out[f"{c}_error"] = F.when(
            bad, F.concat(F.lit(f'Invalid integer value for feature "{c}": "'), text, F.lit('"'))
        )
    return df.withColumns(out)


def parse_request(json: Column) -> Column:
    """Feature request as a map of texts."""
    return F.from_json(json, "map<string,string>")


def typed_request(json: Column) -> Column:
    """Feature request with the kinds its numbers and texts came in: struct(features, errors).

    ``features`` maps each name to struct(kind, number, text): kind ``int``, ``float`` or ``string``, the
    number (null for a text) and the text a category is looked up by. ``errors`` names, sorted, the features
    whose value is null, a list or an object; these are not in ``features``. A request that is no JSON object,
    or names a feature twice, has null features and one error; a null request is null. Booleans are the ints
    0 and 1. A whole number written with a point, like 1.0, is a float; from 19 digits on it counts as an int.
    """
    given = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    usable = "BIGINT|DECIMAL.*|DOUBLE|FLOAT|STRING|BOOLEAN"

    def kind_of(v: Column) -> Column:
        t = F.schema_of_variant(v)
        digits = F.regexp_extract(t, r"^DECIMAL\(([0-9]+),0\)$", 1)
        return F.when(t.isin("BIGINT", "BOOLEAN"), "int").when(t == "STRING", "string").when(
            digits.try_cast("int") > 18, "int").otherwise("float")

    def entry(_: Column, v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        flag = F.when(F.schema_of_variant(v) == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        number = F.when(kind_of(v) != "string", F.coalesce(flag, F.try_variant_get(v, "$", "double")))
        return F.struct(kind_of(v).alias("kind"), number.alias("number"), text.alias("text"))

    fits = lambda _, v: F.schema_of_variant(v).rlike(f"^({usable})$")
    features = F.transform_values(F.map_filter(given, fits), entry)
    bad = F.array_sort(F.map_keys(F.map_filter(given, lambda k, v: ~fits(k, v))))
    errors = F.transform(bad, lambda k: F.concat(F.lit("Value of feature '"), k, F.lit("' is neither a number nor a text")))
    broken = F.array(F.lit("The request is no JSON object with distinct names"))
    return F.when(json.isNotNull(), F.struct(features.alias("features"), F.coalesce(errors, broken).alias("errors")))


def _as_text(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_as_text(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _as_text(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), f.nullable) for f in dtype])
    return T.StringType() if isinstance(dtype, (T.FloatType, T.DoubleType)) else dtype


def to_decimal(df: DataFrame) -> DataFrame:
    """Every float at any depth of lists, maps and structs becomes its shortest decimal text.

    A decimal type has a fixed number of digits and would lose small and large numbers; the shortest
    text that reads back as the same float loses none.
    """
    return df.select(*[F.col(f"`{f.name}`").cast(_as_text(f.dataType)).alias(f.name) for f in df.schema.fields])


def to_double(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The texts of ``to_decimal`` as the floats they came from; ``schema`` is the one before."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
