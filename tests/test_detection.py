import pytest

from tabsmith.functions.schema import (
    badge, categorical_columns, coarse_type, column_types, is_id_name, missing_columns, numeric_columns,
    project_features, require_column, split_xy,
)
from tabsmith.operators import detect, profile
from tabsmith.operators.facts import column_facts


@pytest.mark.parametrize("schema,values,expected", [
    ("c int", [0, 1, 0, 1], "classification"),
    ("c int", [1, 2, 1, 2], "classification"),
    ("c bigint", list(range(4)), "classification"),
    ("c bigint", list(range(10)) * 10, "classification"),
    ("c int", [-1, 0, 1, 0], "classification"),
    ("c double", [0.0, 1.0, 2.0], "classification"),
    ("c boolean", [True, False, True], "classification"),
    ("c string", ["cat", "dog"], "classification"),
    ("c double", [35.5, 42.1, 38.7, 41.2], "regression"),
    ("c bigint", list(range(100)), "regression"),
    ("c double", [-1.5, -2.25, -3.75], "regression"),
    ("c double", [1e-5, 2e-5, 3.5e-5], "regression"),
    ("c int", [1], "classification"),
    ("c int", [5] * 5, "classification"),
    ("c double", [1.0, 2.0, 3.0, 4.0, 5.0], "classification"),
    ("c double", [3.14] * 5, "regression"),
    ("c double", [0.0, 1.0, None, 0.0], "classification"),
    ("c double", [1.5, None, 2.5, 3.7], "regression"),
    ("c int", list(range(11)) * 5, "regression"),
])
def test_problem_type(frame, schema, values, expected):
    assert detect.problem_type(frame(schema, values), "c") == expected


def test_problem_type_of_empty_table(spark):
    assert detect.problem_type(spark.createDataFrame([], "c double"), "c") == "classification"


@pytest.mark.parametrize("name", ["id", "customer_id", "user_id", "order_id", "uuid", "transaction_id", " ID ", "row_num", "order_paid"])
def test_id_names(name):
    assert is_id_name(name)


@pytest.mark.parametrize("name", ["age", "income", "price", "category", "is_active"])
def test_other_names(name):
    assert not is_id_name(name)


@pytest.mark.parametrize("schema,values,expected", [
    ("c bigint", list(range(1, 11)), True),
    ("c int", [3, 1, 2], True),
    ("c smallint", [1, 2, 3], False),
    ("c bigint", [1, 3, 5], False),
    ("c bigint", [1, 1, 2], False),
    ("c double", [1.0, 2.0, 3.0], False),
    ("c bigint", [7], True),
    ("c bigint", [1, 2, None], False),
    ("c bigint", [-(2**62), 2**62], False),
    ("c string", [f"code-{i}" for i in range(50)], True),
    ("c string", [f"two words {i}" for i in range(50)], False),
    ("c string", ["a", "b"] * 20, False),
])
def test_id_by_data(frame, schema, values, expected):
    assert detect.collect_rules(frame(schema, values))["c"]["is_id"] is expected


@pytest.mark.parametrize("schema,values,expected", [
    ("c double", [None, None], True), ("c int", [4, 4, 4], True), ("c int", [4, 5], False),
])
def test_constant(frame, schema, values, expected):
    assert detect.collect_rules(frame(schema, values))["c"]["is_constant"] is expected


def test_constant_when_empty(spark):
    assert detect.collect_rules(spark.createDataFrame([], "c int"))["c"]["is_constant"]


@pytest.mark.parametrize("distinct,expected", [(5, False), (6, True)])
def test_high_cardinality_is_strict(frame, distinct, expected):
    values = [f"v {i % distinct}" for i in range(10)]
    assert detect.collect_rules(frame("c string", values))["c"]["is_high_cardinality"] is expected


def test_quasi_constant_boundary(frame):
    df = frame("a int, b int", [0] * 98 + [1, 2], [0] * 97 + [1, 2, 3])
    rules = detect.collect_rules(df)
    assert rules["a"]["is_quasi_constant"] and not rules["b"]["is_quasi_constant"]


def test_long_texts_are_counted_by_digest(frame):
    long = ["x" * 1000 + str(i % 3) for i in range(30)]
    row = column_facts(frame("c string", long)).first()
    assert (row["distinct_count"], row["top_n"], row["max_bytes"]) == (3, 10, 1001)


def test_nan_is_missing_and_not_distinct(frame):
    row = column_facts(frame("c double", [1.0, float("nan"), None, 1.0])).first()
    assert (row["row_count"], row["non_null"], row["distinct_count"], row["max_value"]) == (4, 2, 1, 1.0)


def test_duplicates_need_equal_rows_not_equal_sets(frame):
    df = frame("a int, b int, c int, d bigint", [1, 2, 3], [1, 2, 3], [3, 2, 1], [1, 2, 3])
    assert detect.duplicate_columns(df) == {"b": "a"}


def test_duplicates_with_missing_values(frame):
    df = frame("a string, b string, c string", ["x", None, "y"], ["x", None, "y"], ["x", "y", None])
    assert detect.duplicate_columns(df) == {"b": "a"}


def test_exclusion_order(frame):
    n = 100
    df = frame(
        "user_id int, copy_id int, fixed int, name string, age int, target int",
        list(range(n)), list(range(n)), [1] * n, [f"name {i}" for i in range(n)], [i % 40 for i in range(n)],
        [i % 2 for i in range(n)],
    )
    found = detect.useless_columns(df, "target")
    assert found == {
        "fixed": detect.REASON_QUASI, "copy_id": detect.REASON_DUPLICATE, "user_id": detect.REASON_ID,
        "name": "high cardinality categorical (100 unique values)",
    }
    report = {r["column_name"]: r["reason"] for r in detect.eda_exclusions(column_facts(df), "target").collect()}
    assert report == {
        "user_id": detect.EDA_ID, "copy_id": detect.EDA_ID, "fixed": detect.EDA_CONSTANT,
        "name": "High cardinality (100 unique values)",
    }


@pytest.mark.parametrize("rows,seconds", [(500, 120), (1000, 300), (10000, 600), (100000, 1200)])
def test_budget(spark, rows, seconds):
    from pyspark.sql import functions as F

    assert spark.range(1).select(detect.time_budget(F.lit(rows)).alias("b")).first()["b"] == seconds


def test_budget_override_is_checked(spark):
    from pyspark.sql import functions as F

    ask = lambda v: spark.range(1).select(detect.time_budget(F.lit(5), F.lit(v)).alias("b")).first()["b"]
    assert ask(60) == 60
    with pytest.raises(Exception, match="time budget"):
        ask(59)


def test_types_and_projection(spark):
    df = spark.sql("SELECT 1 AS a, 1.5D AS b, 'x' AS c, true AS d, current_date() AS e, array(1) AS f")
    assert column_types(df) == {
        "a": "numeric", "b": "numeric", "c": "categorical", "d": "categorical", "e": "datetime", "f": "categorical"
    }
    assert numeric_columns(df) == ["a", "b"] and categorical_columns(df) == ["c"]
    assert badge(df.schema["d"].dataType) == "numeric" and coarse_type(df.schema["d"].dataType) == "categorical"
    assert project_features(df, ["c", "a"]).columns == ["c", "a"]
    assert missing_columns(["z", "a", "y"], df.columns) == ["z", "y"]
    with pytest.raises(ValueError, match="Missing required columns"):
        project_features(df, ["z"])
    with pytest.raises(ValueError, match="not found"):
        require_column(df, "nope")
    x, y = split_xy(df, "a")
    assert "a" not in x.columns and y.columns == ["a"]


def test_profile_edges(frame, spark):
    empty = profile.column_stats(spark.createDataFrame([], "c int")).first()
    assert (empty["unique_count"], empty["missing"], empty["missing_pct"]) == (0, 0, 0.0)
    one = profile.class_imbalance(frame("c int", [1] * 5), "c").first()
    assert (one["imbalance_ratio"], one["severity"]) == (1.0, "balanced")
    skewed = profile.class_imbalance(frame("c int", [0] * 90 + [1] * 10), "c").first()
    assert (skewed["imbalance_ratio"], skewed["severity"]) == (9.0, "imbalanced")
    matrix = profile.correlation_matrix(frame("a double, b double", [1.0, 1.0, 1.0], [1.0, 2.0, 3.0]))
    values = {(r["left_column"], r["right_column"]): r["correlation"] for r in matrix.collect()}
    assert values["a", "b"] is None and values["a", "a"] is None and values["b", "b"] == pytest.approx(1.0)
    flat = profile.histogram(frame("c double", [2.0, 2.0, None]), ["c"], 20).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0] * 10 + [2] + [0] * 9
    assert profile.skewness_flag(frame("c double", [1.0, 2.0]), "c").first()["skew"] is None


def test_histogram_matches_numpy(frame):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(3).normal(size=500)]
    got = [r["n"] for r in profile.histogram(frame("c double", values), ["c"], 15).orderBy("bin").collect()]
    assert got == list(np.histogram(values, bins=15)[0])
