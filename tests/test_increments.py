"""Mergeable profiles, blocked correlations, permutation importance."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabsmith.operators import gram, increments, profile
from tabsmith.operators.permutation import number_rows, permutation_importance, permutations
from tabsmith.sources.records import find_record, profile_record, store_record


def _profile(spark, tmp_path, *loads):
    data, store = str(tmp_path / "data"), str(tmp_path / "profile")
    for i, df in enumerate(loads):
        df.coalesce(1).write.parquet(f"{data}/load={i}")
        assert len(increments.update_profile(spark, store, data)) == 1
    return data, store


def test_merged_profile_is_that_of_all_rows(spark, tmp_path):
    schema = "a int, b double, c string"
    rows = [[(i % 7, None if i % 3 == 0 else i + 1e9, f"t{i % 11}") for i in range(lo, hi)] for lo, hi in ((0, 50), (50, 51), (51, 400))]
    data, store = _profile(spark, tmp_path, *[spark.createDataFrame(r, schema) for r in rows])
    merged = increments.current_profile(spark, store)
    whole = spark.createDataFrame(sum(rows, []), schema)
    keys = ("column_name", "column_type", "missing", "missing_pct", "row_count", "position", "unique_count")
    got = {r["column_name"]: r for r in increments.approximate_stats(merged).collect()}
    for want in profile.column_stats(whole).collect():
        have = got[want["column_name"]]
        assert [have[k] for k in keys[:-1]] == [want[k] for k in keys[:-1]]
        assert abs(have["unique_count"] - want["unique_count"]) <= max(1, want["unique_count"] * increments.DISTINCT_ERROR)
    got = {r["column_name"]: r for r in increments.approximate_describe(merged).collect()}
    for want in profile.describe(whole, ["a", "b"]).collect():
        have = got[want["column_name"]]
        assert [have[k] for k in ("count", "min", "max")] == [want[k] for k in ("count", "min", "max")]
        assert math.isclose(have["mean"], want["mean"], rel_tol=1e-12) and math.isclose(have["std"], want["std"], rel_tol=1e-9)
        for q in ("p25", "p50", "p75"):
            (lo, hi), = increments.rank_bounds(whole, want["column_name"], [have[q]])
            assert lo - increments.RANK_ERROR <= int(q[1:]) / 100 <= hi + increments.RANK_ERROR
    assert increments.update_profile(spark, store, data) == []
    store_record(profile_record(None, "d", "f", stats=increments.approximate_stats(merged)), str(tmp_path / "records"))
    record = find_record(spark, str(tmp_path / "records"), "d").first()
    assert record["row_count"] == 400 and record["column_stats"]["c"]["unique"] == 11 and record["columns"] == ["a", "b", "c"]


def test_columns_that_come_go_or_are_empty(spark, tmp_path):
    first = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    second = spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (float("nan"), None)], "b double, c string")
    none = spark.createDataFrame([], "a int, b double")
    _, store = _profile(spark, tmp_path, first, second, none)
    merged = increments.current_profile(spark, store)
    got = {r["column_name"]: (r["row_count"], r["missing"], r["unique_count"]) for r in increments.approximate_stats(merged).collect()}
    assert got == {"a": (5, 3, 2), "b": (5, 3, 1), "c": (5, 3, 1)}
    described = {r["column_name"]: r for r in increments.approximate_describe(merged).collect()}
    assert described["b"]["count"] == 2 and described["b"]["p50"] == 0.0 and described["a"]["std"] == pytest.approx(2**-0.5)


def test_type_that_changes_is_categorical_and_all_missing_has_no_quartile(spark):
    state = increments.sketch_columns(spark.createDataFrame([(1, None)], "a int, b double")).withColumn("batch", F.lit("x")).unionAll(
        increments.sketch_columns(spark.createDataFrame([("u", None)], "a string, b double")).withColumn("batch", F.lit("y")))
    merged = increments.merge_sketches(state)
    assert {r["column_name"]: r["column_type"] for r in merged.collect()} == {"a": "categorical", "b": "numeric"}
    row = increments.approximate_describe(merged).first()
    assert row["count"] == 0 and row["mean"] is None and row["p50"] is None and row["std"] is None


def test_lost_batch_is_ignored_and_rewritten_file_is_an_error(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "a int")
    data, store = _profile(spark, tmp_path, one)
    increments.sketch_columns(one).withColumn("batch", F.lit("b-lost")).write.parquet(f"{store}/sketches/b-lost")
    assert increments.current_profile(spark, store).first()["row_count"] == 1
    known = increments.known_files(spark, store).withColumn("length", F.col("length") + 1)
    moved = str(tmp_path / "other")
    known.write.parquet(f"{moved}/files")
    with pytest.raises(Exception, match="rewritten since it was profiled"):
        increments.update_profile(spark, moved, data)


def test_many_columns_are_sketched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(increments, "COLUMNS_PER_AGGREGATE", 2)
    df = spark.range(10).select(*[(F.col("id") % k).alias(f"c{k}") for k in range(1, 6)])
    got = increments.approximate_stats(increments.merge_sketches(increments.sketch_columns(df).withColumn("batch", F.lit("b"))))
    assert {r["column_name"]: r["unique_count"] for r in got.collect()} == {f"c{k}": k for k in range(1, 6)}


@pytest.mark.parametrize("block", [3, 512])
def test_blocked_correlations(spark, block):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(200, 6)) + 1e6, columns=list("abcdef"))
    frame["b"] = frame["a"] * 2 + rng.normal(size=200)
    frame.loc[frame.index % 3 == 0, "c"] = np.nan
    frame["e"] = 0.1
    frame["f"] = np.where(frame.index % 3 == 0, frame["f"], 4.0)  # constant wherever c is present
    frame["none"] = np.nan
    df = spark.createDataFrame(frame).repartition(3)
    got = {(r[0], r[1]): r[2] for r in gram.correlation_matrix(df, list(frame.columns), block).collect()}
    want = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, list(frame.columns)).collect()}
    assert got.keys() == want.keys() and len(got) == 49
    for pair, r in want.items():
        assert (got[pair] is None) == (r is None), pair
        assert r is None or got[pair] == pytest.approx(r, abs=1e-9)
    assert gram.correlation_matrix(df.limit(0), ["a", "b"]).collect() == [] and gram.correlation_matrix(df, []).collect() == []


def test_five_hundred_columns_in_one_block(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(60, 500))
    df = spark.createDataFrame([(v.tolist(),) for v in values], "x array<double>").select(*[F.col("x")[i].alias(f"c{i}") for i in range(500)])
    got = gram.correlation_matrix(df).toPandas().pivot(index="left_column", columns="right_column", values="correlation")
    names = [f"c{i}" for i in range(500)]
    assert np.abs(got.loc[names, names].to_numpy() - np.corrcoef(values.T)).max() < 1e-9


def _held_out(spark, n=150):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] + x[:, 1]
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)


def test_permutation_importance_against_brute_force(spark):
    data = _held_out(spark)
    model = LinearRegression(maxIter=5).fit(data.withColumn("label", F.col("label") + F.rand(3)))
    rows = sorted((r["__k"], r["features"].toArray(), r["label"]) for r in number_rows(data)[0].collect())
    assert [r[0] for r in rows] == list(range(150))
    # rows are numbered by position, which is the same again for the same stored table
    got = {r["feature"]: r for r in permutation_importance(model, data, ["p", "q", "r"], "label", False, 2).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    predict = lambda m: m @ model.coefficients.toArray() + model.intercept
    base = ((predict(x) - y) ** 2).sum()
    falls = {f: [] for f in range(3)}
    for j, step in enumerate(permutations(3, 2, 150)):
        moved = x.copy()
        for k in range(150):
            moved[step.target(k, 150), j % 3] = x[k, j % 3]
        assert sorted(moved[:, j % 3]) == sorted(x[:, j % 3])
        falls[j % 3].append((((predict(moved) - y) ** 2).sum() - base) / ((y - y.mean()) ** 2).sum())
    for f, name in enumerate("pqr"):
        assert got[name]["importance"] == pytest.approx(np.mean(falls[f]), rel=1e-9, abs=1e-12)
        assert got[name]["std_error"] == pytest.approx(np.std(falls[f], ddof=1) / 2**0.5, rel=1e-6, abs=1e-12)
    assert list(got) == ["p", "q", "r"] and got["p"]["rows"] == 150


def test_unused_feature_is_exactly_zero_and_edge_cases(spark):
    data = _held_out(spark, 60).withColumn("label", (F.col("label") > 0).cast("double"))
    model = LogisticRegression(maxIter=5).fit(data)
    constant = data.withColumn("features", array_to_vector(F.concat(F.slice(vector_to_array("features"), 1, 2), F.array(F.lit(4.0)))))
    got = {r["feature"]: r["importance"] for r in permutation_importance(model, constant, ["p", "q", "r"], "label", True).collect()}
    assert got["r"] == 0.0 and got["p"] > 0.1
    assert permutation_importance(model, data.limit(0), ["p", "q", "r"], "label", True).collect() == []
    assert permutation_importance(model, data, [], "label", True).collect() == []
    one = permutation_importance(model, data.limit(1), ["p", "q", "r"], "label", True).collect()
    assert [r["importance"] for r in one] == [0.0, 0.0, 0.0]
    same = permutation_importance(LinearRegression(maxIter=1).fit(data), data.withColumn("label", F.lit(1.0)), ["p", "q", "r"], "label", False)
    assert [r["importance"] for r in same.collect()] == [None, None, None]
