"""Imputation, dictionaries, encoding, the full preparation and its metadata."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.schema import (
    categorical_columns,
    counts_as_number,
    fold_nan,
    numeric_columns,
    require_column,
)
from tabsmith.operators.detect import collect_rules, useless_columns
from tabsmith.operators.facts import union_all, value_counts
from tabsmith.operators.lookup import lookup
from tabsmith.operators.profile import numeric_stats
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.ranking import rank_distinct
from tabsmith.operators.split import train_test_split
from tabsmith.session import cut_lineage

# Texts the encoders use.
UNKNOWN = "Unknown"
MISSING_LABEL = "nan"
UNSEEN_CODE = -1
SPLIT_COLUMN = "_split"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def columns_with_missing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """One aggregate over the named columns."""
    if not columns:
        return []
    row = df.agg(*[F.bool_or(_q(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"m{i}"]]


# --- imputation ---------------------------------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; ``Unknown`` when there is none.

    Counts are shuffled, never whole groups, and one row per column comes back.
    """
    if not columns:
        return {}
    best = value_counts(df, columns).groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best")
    )
    found = {r["column_name"]: r["best"]["value"] for r in best.collect()}
    return {c: found.get(c, UNKNOWN) for c in columns}


def fill(df: DataFrame, values: Mapping[str, float | str | None]) -> DataFrame:
    """Replace missing values; a number filled with a fraction becomes a double."""
    out = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, value in values.items():
        if value is None:
            continue
        c = _q(name)
        out[name] = F.coalesce(c.cast("double") if isinstance(types[name], T.NumericType) else c, F.lit(value))
    return df.withColumns(out)


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns having missing values get the exact median; an all-missing one stays."""
    df = fold_nan(df)
    names = columns_with_missing(df, numeric_columns(df) if columns is None else columns)
    return fill(df, medians(df, names))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns_with_missing(df, categorical_columns(df) if columns is None else columns)
    return fill(df, modes(df, names))


def _named(prefix: str | Callable[[str], str], column: str) -> str:
    return prefix(column) if callable(prefix) else prefix + column


def impute_for_scoring(
    df: DataFrame,
    mode: str = "batch",
    fitted: Mapping[str, float | None] | None = None,
    columns: Sequence[str] | None = None,
    prefix: str | Callable[[str], str] = "",
) -> DataFrame:
    """Scoring-time imputation: median of the batch (or the fitted one), else 0; text ``Unknown``.

    ``fitted`` mode reads no data, which is what a stream needs. ``columns`` restricts it to
    ``prefix + name`` (or ``prefix(name)``) columns, ``fitted`` still using ``name``.
    """
    df = fold_nan(df)
    chosen = set(df.columns) if columns is None else {_named(prefix, c) for c in columns}
    numbers = [c for c in numeric_columns(df) if c in chosen]
    if mode == "batch":
        names = columns_with_missing(df, numbers)
        values = {c: 0.0 if v is None else v for c, v in medians(df, names).items()}
    elif mode == "fitted":
        known = {_named(prefix, c): v for c, v in (fitted or {}).items()}
        values = {c: 0.0 if known.get(c) is None else known[c] for c in numbers}
    else:
        raise ValueError(f"unknown imputation mode '{mode}'")
    values.update({c: UNKNOWN for c in categorical_columns(df) if c in chosen})
    return fill(df, values)


# --- dictionaries -------------------------------------------------------------------------------


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code): codes 0..k-1 in code point order of the distinct values."""
    parts = [
        df.where(_q(c).isNotNull())
        .select(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value"))
        .distinct()
        for c in columns
    ]
    return rank_distinct(union_all(parts), "column_name", "value", "code")


def target_labels(df: DataFrame, target: str) -> Column:
    """Text of the class; a missing target is the class ``nan``."""
    return F.coalesce(_q(target).cast("string"), F.lit(MISSING_LABEL))


def encode(
    df: DataFrame,
    codes: DataFrame,
    columns: Sequence[str],
    sizes: Mapping[str, tuple[int, int]] | None = None,
    prefix: str | Callable[[str], str] = "",
    streaming: bool = False,
) -> DataFrame:
    """Replace each column by its code, -1 for a value the dictionary does not hold.

    With ``prefix`` the columns encoded are ``prefix + name``, the dictionary still using ``name``.
    """
    if sizes is None:
        sizes = dictionary_sizes(codes)
    out = df
    for c in columns:
        one = codes.where(F.col("column_name") == c).select("value", F.col("code").alias("__code"))
        name = _named(prefix, c)
        out = lookup(out, one, _q(name).cast("string"), "value", "__code", sizes.get(c, (0, 0)), streaming)
        out = out.withColumn(name, F.coalesce("__code", F.lit(UNSEEN_CODE))).drop("__code")
    return out.select(*[_q(c) for c in df.columns])


def dictionary_sizes(codes: DataFrame) -> dict[str, tuple[int, int]]:
    """Entries and key bytes per dictionary; one row per encoded column."""
    rows = codes.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b")
    )
    return {r["column_name"]: (r["n"], r["b"]) for r in rows.collect()}


def encode_target(df: DataFrame, target: str, column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text target to codes; returns the table and the (code, label) mapping."""
    labelled = df.select(target_labels(df, target).alias(target))
    codes = cut_lineage(dictionary(labelled, [target]))
    name = column or target
    text = df.withColumn(name, target_labels(df, target))
    mapping = codes.select("code", F.col("value").alias("label"))
    one = codes.select("value", F.col("code").alias("__code"))
    out = lookup(text, one, _q(name), "value", "__code").withColumn(name, F.col("__code")).drop("__code")
    return out, mapping


def decode_target(df: DataFrame, mapping: DataFrame, code: str, label: str) -> DataFrame:
    """Adds the original label; a code without one is passed through as text."""
    out = lookup(df, mapping.select("code", F.col("label").alias("__label")), _q(code).cast("int"), "code", "__label")
    return out.withColumn(label, F.coalesce("__label", _q(code).cast("string"))).drop("__label")


# --- the full preparation -----------------------------------------------------------------------


@dataclass
class Prepared:
    """A prepared table and everything scoring needs to repeat the preparation."""

    df: DataFrame
    target: str
    problem_type: str
    class_count: int
    row_count: int
    feature_columns: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]
    dropped: dict[str, str]
    medians: dict[str, float | None]
    dictionary: DataFrame | None
    target_mapping: DataFrame | None
    raw: DataFrame
    sizes: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col(SPLIT_COLUMN) == "train").drop(SPLIT_COLUMN)

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col(SPLIT_COLUMN) == "test").drop(SPLIT_COLUMN)


def preprocess(
    df: DataFrame,
    target: str,
    keys: Sequence[str] | Column,
    test_size: float = 0.2,
    rules: Mapping[str, Row] | None = None,
    fit_on: str = "all",
) -> Prepared:
    """Detect and drop useless columns, impute, encode, split.

    Medians, modes and dictionaries come from the whole table, test rows included, or with
    ``fit_on="train"`` from the train part only (values seen only in test rows then get -1). Driver-side state is one record per
    column; the dictionaries stay a distributed table (reliably checkpointed, since every encoded
    column reads it). The returned table is lazy: projections and broadcast lookups over the scan.
    """
    require_column(df, target)
    df = fold_nan(df)
    rules = collect_rules(df) if rules is None else rules
    dropped = useless_columns(df, target, rules)
    features = [c for c in df.columns if c != target and c not in dropped]
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in features if isinstance(types[c], T.NumericType)]
    texts = [c for c in features if isinstance(types[c], T.StringType)]
    holed = {c for c in features if rules[c]["non_null"] < rules[c]["row_count"]}
    kind = rules[target]["problem_type"]
    split_by = target if kind == "classification" else None
    # split on the raw rows: the keys may be columns that are dropped or encoded below
    out = train_test_split(df, keys, split_by, test_size, SPLIT_COLUMN)
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not '{fit_on}'")
    base = df if fit_on == "all" else out.where(F.col(SPLIT_COLUMN) == "train")
    middle = medians(base, numbers)
    common = modes(base, [c for c in texts if c in holed])
    gaps = {**{c: middle[c] for c in numbers if c in holed}, **common}
    out = fill(out, gaps)

    codes, sizes = None, {}
    if texts:
        codes = cut_lineage(dictionary(fill(base, gaps), texts))
        sizes = dictionary_sizes(codes)
    if codes is not None:
        out = encode(out, codes, texts, sizes)
    mapping = None
    if kind == "classification" and not counts_as_number(types[target]):
        out, mapping = encode_target(out, target)
    target_holed = rules[target]["non_null"] < rules[target]["row_count"]
    out = out.select(*[_q(c) for c in features], _q(target), F.col(SPLIT_COLUMN))
    return Prepared(
        df=out, target=target, problem_type=kind,
        # a missing text target is a class of its own
        class_count=rules[target]["distinct_count"] + (1 if mapping is not None and target_holed else 0),
        row_count=rules[target]["row_count"], feature_columns=features, numeric_columns=numbers,
        categorical_columns=texts, dropped=dropped, medians=middle, dictionary=codes,
        target_mapping=mapping, raw=df, sizes=sizes,
    )


def feature_metadata(prepared: Prepared) -> DataFrame:
    """One row per feature in fitted order: type, whole category map, range and integer flag.

    The maps are records for people and requests; jobs over large dictionaries use ``feature_categories``.
    """
    spark = prepared.raw.sparkSession
    base = spark.createDataFrame(
        [
            (i, c, "categorical" if c in prepared.categorical_columns else "numeric")
            for i, c in enumerate(prepared.feature_columns)
        ],
        "position int, feature string, feature_type string",
    )
    stats = numeric_stats(prepared.raw, prepared.numeric_columns) if prepared.numeric_columns else None
    if stats is not None:
        base = base.join(stats.withColumnRenamed("column_name", "feature"), "feature", "left")
    else:
        base = base.withColumns({
            "min_value": F.lit(None).cast("double"), "max_value": F.lit(None).cast("double"),
            "is_integer": F.lit(None).cast("boolean"),
        })
    if prepared.dictionary is None:
        return base.withColumn("categories", F.lit(None).cast("map<string,int>"))
    maps = (
        feature_categories(prepared)
        .groupBy("feature")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "code")))).alias("categories"))
    )
    return base.join(maps, "feature", "left")


def feature_categories(prepared: Prepared) -> DataFrame:
    """(feature, value, code): the category maps as a long table, which no size of map makes one row."""
    return prepared.dictionary.select(F.col("column_name").alias("feature"), "value", "code")
