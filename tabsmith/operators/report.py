"""Reports as long tables (section, item, metric, value, text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.scalars import accuracy_band, r2_band
from tabsmith.functions.schema import badge, categorical_columns, coarse_type, numeric_columns
from tabsmith.operators import profile
from tabsmith.operators.detect import collect_rules, eda_exclusions
from tabsmith.operators.facts import union_all

Cell = tuple[str, Column, Column]


def _cells(df: DataFrame, section: str, item: Column, cells: Sequence[Cell]) -> DataFrame:
    """One output row per (input row, cell)."""
    structs = [
        F.struct(
            F.lit(section).alias("section"), item.cast("string").alias("item"), F.lit(m).alias("metric"),
            v.cast("double").alias("value"), t.cast("string").alias("text"),
        )
        for m, v, t in cells
    ]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _num(metric: str, c: Column) -> Cell:
    return metric, F.round(c.cast("double"), 4), F.lit(None)


def _text(metric: str, c: Column) -> Cell:
    return metric, F.lit(None), c


def _missing_pct() -> Column:
    rows = F.col("row_count")
    return F.when(rows > 0, (rows - F.col("non_null")) / rows * 100).otherwise(F.lit(0.0))


def facts_table(spark: SparkSession, rules: Mapping[str, Row]) -> DataFrame:
    """Collected facts as a table again."""
    fields = [
        "column_name string", "position int", "data_type string", "column_type string", "row_count bigint",
        "non_null bigint", "distinct_count bigint", "top_n bigint", "min_value double", "max_value double",
        "value_span bigint", "integer_like boolean", "code_rows bigint", "max_bytes bigint",
    ]
    names = [f.split()[0] for f in fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rules.values()], ", ".join(fields))


def eda_report(df: DataFrame, target: str) -> DataFrame:
    """Overview, target analysis, notes, correlation, columns, categories and numbers.

    Column facts are collected once (one row per column): they decide which sections exist and feed
    three of them as a small table.
    """
    rules = collect_rules(df)
    kind = rules[target]["problem_type"]
    facts = facts_table(df.sparkSession, rules)
    item = F.col("column_name")
    numbers = {f.name for f in df.schema.fields if badge(f.dataType) == "numeric"}
    badges = F.when(item.isin(list(numbers)), "numeric").otherwise("categorical") if numbers else F.lit("categorical")

    parts = [
        _cells(
            profile.dataset_overview(df, target, kind), "overview", F.lit("dataset"),
            [
                _num("rows", F.col("row_count")), _num("columns", F.col("column_count")),
                _num("numeric", F.col("numeric_count")), _num("categorical", F.col("categorical_count")),
                _text("target", F.col("target_column")), _text("problem_type", F.col("problem_type")),
                _num("memory_mb", F.col("memory_mb")),
            ],
        ),
        _cells(eda_exclusions(facts, target), "notes", item, [_text("excluded", F.col("reason"))]),
        _cells(profile.missing_warning(facts), "notes", F.lit("dataset"),
               [_num("columns_with_missing", F.col("columns_with_missing"))]),
        _cells(facts, "columns", item,
               [("unique", F.col("distinct_count"), badges), _num("missing_pct", _missing_pct())]),
    ]
    if kind == "classification":
        parts += [
            _cells(profile.class_distribution(df, target), "target", F.col("class"),
                   [_num("count", F.col("n")), _num("pct", F.col("pct"))]),
            _cells(profile.class_imbalance(df, target), "target", F.lit(target),
                   [("imbalance_ratio", F.col("imbalance_ratio"), F.col("severity"))]),
        ]
    else:
        stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        parts += [
            _cells(profile.describe(df, [target]), "target", item, [_num(s, F.col(s)) for s in stats]),
            _cells(profile.skewness_flag(df, target), "target", item,
                   [("skew", F.round("skew", 4), F.col("highly_skewed"))]),
            _cells(profile.histogram(df, [target], profile.TARGET_BINS), "target_histogram",
                   F.col("bin"), [_num("n", F.col("n"))]),
        ]
    numeric = numeric_columns(df)
    if target in numeric and len(numeric) > 1:
        parts.append(
            _cells(profile.target_correlation(df, target), "correlation", F.col("feature"),
                   [("pearson", F.round("correlation", 4), F.col("strength"))])
        )
    if categorical_columns(df):
        parts.append(_cells(profile.categorical_summary(df), "categorical", item,
                            [("count", F.col("n"), F.col("value"))]))
    rest = [c for c in numeric if c != target]
    if rest:
        parts.append(_cells(profile.numeric_summary(df, rest), "numeric", item,
                            [_num(s, F.col(s)) for s in ("mean", "std", "min", "median", "max")]))
    return union_all(parts)


def eda_minimal(df: DataFrame) -> DataFrame:
    """Fallback report: shape, type / missing / distinct per column, describe of the numbers."""
    facts = facts_table(df.sparkSession, collect_rules(df))
    item = F.col("column_name")
    parts = [
        _cells(df.agg(F.count(F.lit(1)).alias("n")), "shape", F.lit("dataset"),
               [_num("rows", F.col("n")), _num("columns", F.lit(len(df.columns)))]),
        _cells(facts, "columns", item, [
            _text("dtype", F.col("column_type")), _num("missing_pct", _missing_pct()),
            _num("unique", F.col("distinct_count")),
        ]),
    ]
    numeric = numeric_columns(df)
    if numeric:
        stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        parts.append(_cells(profile.describe(df, numeric), "describe", item, [_num(s, F.col(s)) for s in stats]))
    return union_all(parts)



# --- training report ----------------------------------------------------------------------------

# Metrics shown per problem type, in order.
CLASSIFICATION_METRICS = ("accuracy", "f1_score", "precision", "recall")
REGRESSION_METRICS = ("r2_score", "rmse", "mae")
REPORT_FEATURES = 15


def training_report(
    spark: SparkSession,
    run_id: str,
    problem_type: str,
    metrics: Mapping[str, object],
    importance: Sequence[tuple[str, float]],
    feature_columns: Sequence[str],
    dropped: Mapping[str, str],
    config: Mapping[str, object],
) -> DataFrame:
    """Summary, metrics, interpretation, importances, features used and excluded, configuration.

    Everything in it is already one small record of a finished run, so the table is built from
    literals.
    """
    rows: list[tuple[str, str, str, float | None, str | None]] = [
        ("summary", "run", "run_id", None, run_id),
        ("summary", "run", "problem_type", None, problem_type),
        ("summary", "run", "best_estimator", None, str(metrics.get("best_estimator", "Unknown"))),
        ("summary", "run", "training_time", float(metrics.get("training_time", 0.0)), None),
        ("summary", "run", "feature_count", float(len(feature_columns)), None),
    ]
    shown = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    for key in shown:
        value = metrics.get(key, 0)
        rows.append(("metrics", key, "value", None if value is None else float(value), None))
    head = shown[0]
    band = accuracy_band if problem_type == "classification" else r2_band
    top = sorted(importance, key=lambda kv: (-kv[1], kv[0]))[:REPORT_FEATURES]
    largest = max((v for _, v in top), default=0.0)
    for name, value in top:
        rows.append(("importance", name, "importance", float(value), None))
        rows.append(("importance", name, "pct_of_max", value / largest * 100 if largest > 0 else 0.0, None))
    rows += [("features", c, "used", None, None) for c in feature_columns]
    rows += [("features", c, "excluded", None, why) for c, why in dropped.items()]
    for key, value in config.items():
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        rows.append(("configuration", key, "setting", float(value) if number else None,
                     None if number else str(value)))
    table = spark.createDataFrame(rows, "section string, item string, metric string, value double, text string")
    verdict = (
        table.where((F.col("section") == "metrics") & (F.col("item") == head))
        .select(F.lit("metrics").alias("section"), F.lit(head).alias("item"),
                F.lit("interpretation").alias("metric"), F.lit(None).cast("double").alias("value"),
                band(F.coalesce(F.col("value"), F.lit(0.0))).alias("text"))
        .where("text IS NOT NULL")
    )
    return table.unionByName(verdict)
