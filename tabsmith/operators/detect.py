"""Problem type, identifier / constant / duplicate / high-cardinality detection, exclusion reports.

Everything except duplicates is decided from column facts (one row per column), either lazily as
column expressions over the facts table or on the driver over the collected rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabsmith.functions.schema import id_name_match
from tabsmith.operators.facts import BRANCH_COLUMNS, COLUMNS_PER_JOB, column_facts, counting_key

# Decision thresholds.
CLASS_VALUES = 10
FEW_VALUES = 20
FEW_RATIO = 0.05
ID_UNIQUE_RATIO = 0.95
ID_CODE_SHARE = 0.9
QUASI_CONSTANT = 0.98
HIGH_CARDINALITY = 0.5
BUDGET_MIN, BUDGET_MAX = 60, 3600

# Reasons shown in the two reports.
REASON_QUASI = "constant or quasi-constant (>98% same value)"
REASON_DUPLICATE = "duplicate of another column"
REASON_ID = "identifier/ID column"
REASON_CARDINALITY = "high cardinality categorical"
EDA_ID = "ID/Identifier column"
EDA_CONSTANT = "Constant value (no variance)"
EDA_CARDINALITY = "High cardinality"


def _ratio() -> Column:
    return F.when(F.col("row_count") > 0, F.col("distinct_count") / F.col("row_count"))


def _is_number() -> Column:
    return (F.col("column_type") == "numeric") | (F.col("data_type") == "boolean")


def _is_text() -> Column:
    return F.col("data_type") == "string"


def problem_type_rule() -> Column:
    """Trainer rule over a facts table."""
    few = (F.col("distinct_count") < FEW_VALUES) & (_ratio() < FEW_RATIO)
    return (
        F.when((F.col("row_count") == 0) | ~_is_number(), "classification")
        .when(F.col("integer_like") & (F.col("distinct_count") <= CLASS_VALUES), "classification")
        .when(few, "classification")
        .otherwise("regression")
    )


def preview_rule(variant: str = "service") -> Column:
    """Preview rule, ``service`` or ``screen``; they differ on dates and on all-missing numbers."""
    few = (F.col("distinct_count") < FEW_VALUES) | (_ratio() < FEW_RATIO)
    if variant == "service":
        few = few & (F.col("distinct_count") > 0)
        other = F.lit("classification")
    elif variant == "screen":
        other = F.when(F.col("column_type") == "categorical", "classification").otherwise("regression")
    else:
        raise ValueError(f"unknown preview variant '{variant}'")
    number = F.when(few, "classification").otherwise("regression")
    return F.when(F.col("column_type") == "numeric", number).otherwise(other)


def id_rule() -> Column:
    """Identifier by name, by consecutive unique integers, or by nearly unique code-like strings."""
    by_number = F.col("data_type").isin("bigint", "int") & sequential_rule()
    code_share = F.when(F.col("non_null") > 0, F.col("code_rows") / F.col("non_null"))
    by_text = _is_text() & (_ratio() > ID_UNIQUE_RATIO) & (code_share > ID_CODE_SHARE)
    return id_name_match(F.col("column_name")) | by_number | F.coalesce(by_text, F.lit(False))


def sequential_rule() -> Column:
    """All values present, distinct and consecutive, without sorting; true of no row or one row."""
    unique = F.col("distinct_count") == F.col("row_count")
    dense = F.coalesce(F.col("value_span") == F.col("distinct_count") - 1, F.col("row_count") == 0)
    return unique & dense


def constant_rule() -> Column:
    return F.col("distinct_count") <= 1


def quasi_constant_rule(tolerance: float = QUASI_CONSTANT) -> Column:
    return F.coalesce(F.col("top_n") / F.nullif(F.col("row_count"), F.lit(0)) >= tolerance, F.lit(False))


def high_cardinality_rule(threshold: float = HIGH_CARDINALITY) -> Column:
    return _is_text() & F.coalesce(_ratio() > threshold, F.lit(False))


def time_budget(rows: Column, override: Column | None = None) -> Column:
    """Search seconds by row count; an explicit request must lie within the allowed range."""
    tier = F.when(rows < 1000, 120).when(rows < 10000, 300).when(rows < 50000, 600).otherwise(1200)
    if override is None:
        return tier
    bad = (override < BUDGET_MIN) | (override > BUDGET_MAX)
    error = F.raise_error(F.lit(f"time budget must be within {BUDGET_MIN}-{BUDGET_MAX} seconds"))
    return F.when(bad, error.cast("int")).otherwise(F.coalesce(override, tier))


def selection_metric_rule(problem_type: Column, classes: Column) -> Column:
    return (
        F.when(problem_type == "regression", "r2").when(classes > 2, "accuracy").otherwise("f1")
    )


# --- facts and verdicts on the driver (one row per column) --------------------------------------


def with_rules(facts: DataFrame) -> DataFrame:
    return facts.select(
        "*",
        problem_type_rule().alias("problem_type"),
        id_rule().alias("is_id"),
        constant_rule().alias("is_constant"),
        quasi_constant_rule().alias("is_quasi_constant"),
        high_cardinality_rule().alias("is_high_cardinality"),
    )


def collect_rules(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Row]:
    """Facts and verdicts, a few columns per job; wide tables in one."""
    names = list(df.columns if columns is None else columns)
    step = COLUMNS_PER_JOB if len(names) <= BRANCH_COLUMNS else len(names)
    out: dict[str, Row] = {}
    for at in range(0, len(names), step):
        for row in with_rules(column_facts(df, names[at : at + step])).collect():
            out[row["column_name"]] = row
    return {n: out[n] for n in names}


def problem_type(df: DataFrame, target: str) -> str:
    return collect_rules(df, [target])[target]["problem_type"]


# --- duplicates ---------------------------------------------------------------------------------


def duplicate_columns(
    df: DataFrame, columns: Sequence[str] | None = None, facts: Mapping[str, Row] | None = None
) -> dict[str, str]:
    """Later column -> earlier column with the same type and the same value in every row.

    A fingerprint that ignores row order (two sums of value hashes and the missing count) groups the
    columns that could be equal; only pairs inside such a group are compared row by row. Both steps
    are plain aggregates without a shuffle of rows.
    """
    fields = {f.name: f for f in df.schema.fields}
    names = list(df.columns if columns is None else columns)
    if len(names) < 2:
        return {}
    if facts is not None:
        # equal columns share type and counts; a column alone in its class needs no fingerprint
        sizes: dict[tuple, list[str]] = {}
        for n in names:
            r = facts[n]
            sizes.setdefault((r["data_type"], r["non_null"], r["distinct_count"], r["top_n"]), []).append(n)
        names = [n for group in sizes.values() if len(group) > 1 for n in group]
        if not names:
            return {}
        order = {n: i for i, n in enumerate(df.columns)}
        names.sort(key=order.get)
    aggs = []
    for i, name in enumerate(names):
        h = F.xxhash64(counting_key(name, fields[name].dataType))
        aggs += [
            F.sum(F.pmod(h, F.lit(1_000_003))).alias(f"a{i}"),
            F.bit_xor(h).alias(f"b{i}"),
            F.count(F.col(f"`{name}`")).alias(f"n{i}"),
        ]
    prints = df.agg(*aggs).first()
    alike: dict[tuple, list[str]] = {}
    for i, name in enumerate(names):
        key = (fields[name].dataType.simpleString(), prints[f"a{i}"], prints[f"b{i}"], prints[f"n{i}"])
        alike.setdefault(key, []).append(name)
    pairs = [
        (first, later)
        for group in alike.values()
        for x, first in enumerate(group)
        for later in group[x + 1 :]
    ]
    if not pairs:
        return {}
    def same(a: str, b: str) -> Column:
        ka, kb = (counting_key(n, fields[n].dataType) for n in (a, b))
        return F.coalesce(F.bool_and(ka.eqNullSafe(kb)), F.lit(True))
    verdict = df.agg(*[same(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    out: dict[str, str] = {}
    for i, (first, later) in enumerate(pairs):
        if verdict[f"p{i}"] and first not in out and later not in out:
            out[later] = first
    return out


# --- exclusion reports --------------------------------------------------------------------------


def useless_columns(df: DataFrame, target: str, rules: Mapping[str, Row] | None = None) -> dict[str, str]:
    """Column -> reason, precedence quasi-constant, duplicate, identifier, high cardinality."""
    rules = collect_rules(df) if rules is None else rules
    features = [c for c in df.columns if c != target]
    reasons = {c: REASON_QUASI for c in features if rules[c]["is_quasi_constant"]}
    rest = [c for c in features if c not in reasons]
    for c in duplicate_columns(df, rest, rules):
        reasons[c] = REASON_DUPLICATE
    for c in features:
        if c in reasons:
            continue
        if rules[c]["is_id"]:
            reasons[c] = REASON_ID
        elif rules[c]["is_high_cardinality"]:
            reasons[c] = f"{REASON_CARDINALITY} ({rules[c]['distinct_count']} unique values)"
    return reasons


def reasons_table(df: DataFrame, reasons: Mapping[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(reasons.items()), "column_name string, reason string"
    )


def eda_exclusions(facts: DataFrame, target: str) -> DataFrame:
    """Column and reason, precedence identifier, constant, high cardinality; lazy over facts."""
    reason = (
        F.when(id_rule(), EDA_ID)
        .when(constant_rule(), EDA_CONSTANT)
        .when(
            high_cardinality_rule(),
            F.concat(F.lit(f"{EDA_CARDINALITY} ("), F.col("distinct_count").cast("string"), F.lit(" unique values)")),
        )
    )
    return (
        facts.where(F.col("column_name") != target)
        .select("column_name", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )
