"""Profile and exploratory-analysis operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.schema import badge, categorical_columns, coarse_type, numeric_columns
from tabsmith.operators.facts import column_facts, counting_key, union_all
from tabsmith.operators.quantiles import exact_quantiles

# Thresholds and sizes of the exploratory report.
MISSING_FLAG_PCT = 5.0
SAMPLE_VALUES = 3
SAMPLE_CHARS = 20
TOP_VALUES = 5
TOP_COLUMNS = 10
VALUE_CHARS = 30
TARGET_BINS = 20
FEATURE_BINS = 15
BAR_PIXELS = 40

# Pairs of columns whose correlation is computed in one aggregate.
PAIRS_PER_JOB = 64


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def as_double(name: str) -> Column:
    """The column as a double with NaN folded to NULL."""
    c = _q(name).cast("double")
    return F.when(~F.isnan(c), c)


def row_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("rows")).scalar()


def melt(one_row: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into a long table, one struct of columns per output row."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select(
        *[F.col(f"r.{n}").alias(n) for n in names]
    )


# --- counts -----------------------------------------------------------------------------------


def missing_pct(missing: Column, rows: Column) -> Column:
    return F.when(rows > 0, F.round(missing / rows * 100, 2)).otherwise(F.lit(0.0))


def column_stats(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Type, distinct non-missing values, missing count and percentage per column."""
    facts = column_facts(df) if facts is None else facts
    missing = F.col("row_count") - F.col("non_null")
    return facts.select(
        "column_name",
        "column_type",
        F.col("distinct_count").alias("unique_count"),
        missing.alias("missing"),
        missing_pct(missing, F.col("row_count")).alias("missing_pct"),
        "row_count",
        "position",
    )


def type_distribution(stats: DataFrame) -> DataFrame:
    """Columns per coarse type with their share, plus columns having missing values."""
    total = stats.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.groupBy("column_type").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.round(F.count(F.lit(1)) * 100.0 / F.first(total), 2).alias("share_pct"),
        F.count_if(F.col("missing") > 0).alias("with_missing"),
    )


def missing_list(stats: DataFrame, shown: int = 5) -> DataFrame:
    """Names of the first columns with missing values and how many more there are."""
    holed = stats.where("missing > 0")
    more = holed.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("m")).scalar()
    return (
        holed.orderBy("position")
        .limit(shown)
        .select("column_name", "missing_pct", more.alias("more_columns"))
    )


def cardinality_hint(stats: DataFrame) -> DataFrame:
    ratio = F.when(F.col("row_count") > 0, F.col("unique_count") / F.col("row_count"))
    return stats.select(
        "column_name",
        "unique_count",
        F.round(ratio * 100, 2).alias("unique_pct"),
        F.when(F.col("unique_count") <= 10, "low")
        .when(ratio < 0.05, "moderate")
        .otherwise("high")
        .alias("hint"),
    )


def logical_bytes(df: DataFrame) -> Column:
    """Aggregate expression: fixed widths plus the bytes of strings and array elements."""
    width = F.lit(0)
    for f in df.schema.fields:
        c = _q(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType):
            each = getattr(f.dataType.elementType, "typeName", lambda: "")()
            size = F.size(c) * (4 if each in ("float", "integer") else 8)
        elif isinstance(f.dataType, T.BooleanType):
            size = F.lit(1)
        elif isinstance(f.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            size = F.lit(4)
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(0))
    return F.coalesce(F.sum(width.cast("bigint")), F.lit(0))


def dataset_overview(df: DataFrame, target: str, problem_type: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_count"),
        F.lit(len(categorical_columns(df))).alias("categorical_count"),
        F.lit(target).alias("target_column"),
        F.lit(problem_type).alias("problem_type"),
        F.round(logical_bytes(df) / 1048576.0, 4).alias("memory_mb"),
    )


# --- numbers ----------------------------------------------------------------------------------


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(count, min, max, mean, sample deviation) per column; one aggregate, one row back."""
    aggs = []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        aggs += [
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
            F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
        ]
    # cleaned once per row, not once per aggregate
    row = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)]).agg(*aggs).first()
    return {c: tuple(row[f"{p}{i}"] for p in ("n", "lo", "hi", "a", "s")) for i, c in enumerate(columns)}


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None
) -> DataFrame:
    """Mean, sample deviation, min, exact median, max per numeric column other than the target.

    The answers are six numbers per column, so they are computed here and returned as a small table.
    """
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c != target]
    facts = _moments(df, names)
    medians = exact_quantiles(df, names, [0.5], {c: f[:3] for c, f in facts.items()})
    rows = [(c, facts[c][3], facts[c][4], facts[c][1], medians[c][0], facts[c][2]) for c in names]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, mean double, std double, min double, median double, max double"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles (linear interpolation, exact) and max per column."""
    facts = _moments(df, columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], {c: f[:3] for c, f in facts.items()})
    rows = [
        (c, facts[c][0], facts[c][3], facts[c][4], facts[c][1], *quartiles[c], facts[c][2]) for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, "
        "p75 double, max double",
    )


def adjusted_skewness(c: Column) -> Column:
    """Sample-adjusted skewness; Spark's ``skewness`` is the population form."""
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n >= 3, F.coalesce(factor * F.skewness(c), F.lit(0.0)))


def skewness_flag(df: DataFrame, column: str) -> DataFrame:
    return df.agg(adjusted_skewness(as_double(column)).alias("skew")).select(
        F.lit(column).alias("column_name"),
        "skew",
        F.coalesce(F.abs("skew") > 1, F.lit(False)).alias("highly_skewed"),
    )


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max and all-integer flag of the raw values; one aggregate, no shuffle of rows."""
    aggs, rows = [], []
    for i, name in enumerate(columns):
        c = as_double(name)
        aggs += [
            F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
            F.bool_and(c == F.floor(c)).alias(f"int{i}"),
        ]
        rows.append([F.lit(name), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"int{i}")])
    return melt(
        df.agg(*aggs), rows, ["column_name", "min_value", "max_value", "is_integer"]
    ).where("min_value IS NOT NULL")


def bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based equal-width bin of ``v`` in [lo, hi], last bin closed, edges at lo + i * step."""
    step = (hi - lo) / bins
    raw = F.least(F.floor((v - F.lit(lo)) * F.lit(bins / (hi - lo))), F.lit(bins - 1))
    down = (v < F.lit(lo) + raw * F.lit(step)).cast("int")
    up = ((v >= F.lit(lo) + (raw + 1) * F.lit(step)) & (raw != bins - 1)).cast("int")
    return (raw - down + up + 1).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width histogram of each column, empty bins included, with the bar height in pixels.

    Two passes: the ranges (two numbers per column), then per column a count by bin. A branch reads
    only its own column and sends at most ``bins`` rows per task.
    """
    spark = df.sparkSession
    ends = df.agg(
        *[F.min(as_double(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(as_double(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    grid, parts = [], []
    for i, name in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        step = (hi - lo) / bins
        grid += [
            (name, b + 1, lo + b * step, hi if b + 1 == bins else lo + (b + 1) * step)
            for b in range(bins)
        ]
        parts.append(
            df.where(as_double(name).isNotNull())
            .groupBy(bin_index(as_double(name), lo, hi, bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("column_name"), "bin", "n")
        )
    grid_df = spark.createDataFrame(
        grid, "column_name string, bin int, lower_edge double, upper_edge double"
    )
    if not parts:
        return grid_df.withColumns({"n": F.lit(0).cast("bigint"), "bar_height": F.lit(2)})
    counts = union_all(parts)
    tallest = counts.groupBy("column_name").agg(F.max("n").alias("top"))
    n = F.coalesce("n", F.lit(0))
    return (
        grid_df.join(counts, ["column_name", "bin"], "left")
        .join(tallest, "column_name", "left")
        .select(
            "column_name", "bin", "lower_edge", "upper_edge", n.cast("bigint").alias("n"),
            F.greatest(F.floor(n / F.col("top") * BAR_PIXELS), F.lit(2)).cast("int").alias("bar_height"),
        )
    )


def _corr_long(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson over rows where both columns are present; NULL (not an error) when either is constant.

    First pass: count, mean and range per column. Second pass: plain sums of values shifted by their
    mean, which keeps them well conditioned and cheap to update. Columns without missing values share
    their own two sums between all pairs; only pairs with a gap need sums of their own.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    rows = F.count(F.lit(1)).alias("rows")
    clean = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(names)])
    first = clean.agg(rows, *[
        e for i in range(len(names)) for e in (
            F.count(f"c{i}").alias(f"n{i}"), F.avg(f"c{i}").alias(f"m{i}"),
            F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        )
    ]).first()
    at = {c: i for i, c in enumerate(names)}
    full = {c for c in names if first[f"n{at[c]}"] == first["rows"]}
    varied = {c for c in names if first[f"n{at[c]}"] > 0 and first[f"lo{at[c]}"] < first[f"hi{at[c]}"]}
    shifted = clean.select(*[
        (F.col(f"c{i}") - F.lit(first[f"m{i}"] or 0.0)).alias(f"x{i}") for i in range(len(names))
    ])
    values: dict[tuple[str, str], float | None] = {p: None for p in pairs}
    values |= {(a, b): 1.0 for a, b in pairs if a == b and a in varied}
    open_pairs = [(a, b) for a, b in pairs if a != b and a in varied and b in varied]
    for start in range(0, len(open_pairs), PAIRS_PER_JOB):
        chunk = open_pairs[start : start + PAIRS_PER_JOB]
        aggs: dict[str, Column] = {}
        for a, b in chunk:
            i, j = at[a], at[b]
            x, y = F.col(f"x{i}"), F.col(f"x{j}")
            if a in full and b in full:
                for k, v in ((i, x), (j, y)):
                    aggs[f"s{k}"], aggs[f"q{k}"] = F.sum(v), F.sum(v * v)
                aggs[f"p{i}_{j}"] = F.sum(x * y)
                continue
            both = x.isNotNull() & y.isNotNull()
            xs, ys = F.when(both, x), F.when(both, y)
            aggs |= {
                f"n{i}_{j}": F.count(xs), f"p{i}_{j}": F.sum(x * y),
                f"sx{i}_{j}": F.sum(xs), f"qx{i}_{j}": F.sum(xs * xs),
                f"sy{i}_{j}": F.sum(ys), f"qy{i}_{j}": F.sum(ys * ys),
                f"cx{i}_{j}": F.min(xs) < F.max(xs), f"cy{i}_{j}": F.min(ys) < F.max(ys),
            }
        row = shifted.agg(*[e.alias(n) for n, e in aggs.items()]).first()
        for a, b in chunk:
            i, j = at[a], at[b]
            if a in full and b in full:
                n, sx, qx, sy, qy = first["rows"], row[f"s{i}"], row[f"q{i}"], row[f"s{j}"], row[f"q{j}"]
            else:
                n = row[f"n{i}_{j}"]
                if not n or not row[f"cx{i}_{j}"] or not row[f"cy{i}_{j}"]:
                    continue
                sx, qx, sy, qy = (row[f"{k}{i}_{j}"] for k in ("sx", "qx", "sy", "qy"))
            spread = math.sqrt(max(qx - sx * sx / n, 0.0)) * math.sqrt(max(qy - sy * sy / n, 0.0))
            if spread > 0:
                r = (row[f"p{i}_{j}"] - sx * sy / n) / spread
                values[a, b] = max(-1.0, min(1.0, r))
    return df.sparkSession.createDataFrame(
        [(a, b, v) for (a, b), v in values.items()],
        "left_column string, right_column string, correlation double",
    )


def corr_strength(r: Column) -> Column:
    return (
        F.when(r > 0.5, "Strong Positive")
        .when(r > 0.3, "Moderate Positive")
        .when(r < -0.5, "Strong Negative")
        .when(r < -0.3, "Moderate Negative")
        .otherwise("Weak")
    )


def target_correlation(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Strongest correlations with the target; only target pairs are computed."""
    others = [c for c in numeric_columns(df) if c != target]
    return (
        _corr_long(df, [(c, target) for c in others])
        .select(
            F.col("left_column").alias("feature"),
            "correlation",
            corr_strength(F.col("correlation")).alias("strength"),
        )
        .orderBy(F.abs("correlation").desc_nulls_last(), "feature")
        .limit(k)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form; each unordered pair is computed once and mirrored."""
    names = numeric_columns(df) if columns is None else list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    upper = _corr_long(df, pairs)
    both = F.array(
        F.struct(F.col("left_column"), F.col("right_column"), F.col("correlation")),
        F.struct(
            F.col("right_column").alias("left_column"), F.col("left_column").alias("right_column"),
            F.col("correlation"),
        ),
    )
    once = F.array(F.struct("left_column", "right_column", "correlation"))
    return upper.select(
        F.explode(F.when(F.col("left_column") == F.col("right_column"), once).otherwise(both)).alias("r")
    ).select("r.left_column", "r.right_column", "r.correlation")


# --- categories -------------------------------------------------------------------------------


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count per present class; the percentage is of all rows, missing ones included."""
    c = _q(target)
    return (
        df.where(c.isNotNull())
        .groupBy(c.cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("class", "n", F.round(F.col("n") / row_total(df) * 100, 4).alias("pct"))
    )


def imbalance_severity(ratio: Column) -> Column:
    return (
        F.when(ratio > 3, "imbalanced").when(ratio > 1.5, "slight").otherwise("balanced")
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    sizes = df.where(_q(target).isNotNull()).groupBy(_q(target)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("class_count"), F.max("n").alias("largest"), F.min("n").alias("smallest")
    ).select(
        "class_count", "largest", "smallest",
        F.round(F.col("largest") / F.col("smallest"), 4).alias("imbalance_ratio"),
        imbalance_severity(F.col("largest") / F.col("smallest")).alias("severity"),
    )


def categorical_summary(
    df: DataFrame, columns: Sequence[str] | None = None, first: int | None = TOP_COLUMNS
) -> DataFrame:
    """Top values of categorical columns: count, share of rows, number of other values.

    Given columns are all answered; without them the ``first`` categorical ones are (None: all).

    The top values come from a distributed take-ordered per column, so no column is ever sorted in
    one task.
    """
    names = categorical_columns(df)[:first] if columns is None else list(columns)
    total = row_total(df)
    parts = []
    for name in names:
        # long texts are counted by their digest; the shown prefix is all of the text that travels,
        # and ordering equal counts by it shows the same rows as ordering by the whole text
        groups = (
            df.where(_q(name).isNotNull())
            .groupBy(counting_key(name, df.schema[name].dataType).alias("k"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.substring(_q(name), 1, VALUE_CHARS)).alias("value"))
        )
        distinct = groups.agg(F.count(F.lit(1)).alias("d")).scalar()
        parts.append(
            groups.orderBy(F.col("n").desc(), "value")
            .limit(TOP_VALUES)
            .select(
                F.lit(name).alias("column_name"),
                "value",
                "n",
                F.round(F.col("n") / total * 100, 4).alias("pct"),
                distinct.alias("unique_count"),
                F.greatest(distinct - TOP_VALUES, F.lit(0)).cast("bigint").alias("more_values"),
            )
        )
    return union_all(parts)


def sample_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First non-missing values per column in the order of a named key, each cut short."""
    parts = []
    for name in columns:
        parts.append(
            df.where(_q(name).isNotNull())
            .select(*[_q(k).alias(f"k{i}") for i, k in enumerate(order_by)],
                    F.substring(_q(name).cast("string"), 1, SAMPLE_CHARS).alias("value"))
            .orderBy(*[f"k{i}" for i in range(len(order_by))], "value")
            .limit(SAMPLE_VALUES)
            .agg(
                F.array_join(
                    F.transform(
                        F.sort_array(
                            F.collect_list(F.struct(*[f"k{i}" for i in range(len(order_by))], "value"))
                        ),
                        lambda s: s["value"],
                    ),
                    ", ",
                ).alias("samples")
            )
            .select(F.lit(name).alias("column_name"), "samples")
        )
    return union_all(parts)


def eda_column_info(
    df: DataFrame, order_by: Sequence[str], excluded: Sequence[str], facts: DataFrame | None = None
) -> DataFrame:
    """Badge, missing share and flag, distinct count, samples and exclusion flag per column."""
    facts = column_facts(df) if facts is None else facts
    badges = F.lit("categorical")
    numbers = [f.name for f in df.schema.fields if badge(f.dataType) == "numeric"]
    if numbers:
        badges = F.when(F.col("column_name").isin(numbers), "numeric").otherwise("categorical")
    pct = F.when(
        F.col("row_count") > 0, (F.col("row_count") - F.col("non_null")) / F.col("row_count") * 100
    ).otherwise(F.lit(0.0))
    return facts.join(sample_values(df, df.columns, order_by), "column_name", "left").select(
        "column_name",
        badges.alias("badge"),
        F.round(pct, 4).alias("missing_pct"),
        (pct > MISSING_FLAG_PCT).alias("missing_flag"),
        F.col("distinct_count").alias("unique_count"),
        F.coalesce("samples", F.lit("")).alias("samples"),
        F.col("column_name").isin(list(excluded)).alias("excluded") if excluded else F.lit(False).alias("excluded"),
    )


def missing_warning(facts: DataFrame) -> DataFrame:
    holed = F.count_if(F.col("non_null") < F.col("row_count"))
    return facts.agg(holed.alias("columns_with_missing"))
