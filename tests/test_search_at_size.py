"""What keeps the search fast on larger tables: rows in all tasks, and levels summed by tasks."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.operators import models, prepare, trees


def test_every_task_of_a_fit_has_rows(spark, monkeypatch):
    rows = [(float(i % 13), float(i * 7 % 11), ["a", "b"][i % 3 == 0], i) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, cls string, k int").coalesce(1)
    made = prepare.preprocess(df, "cls", ["k"])
    seen = {}

    def stop(train, *_, **__):
        seen["rows"] = train.select(F.input_file_name()).distinct().count()
        raise KeyboardInterrupt

    monkeypatch.setattr(models, "select_model", stop)
    with pytest.raises(KeyboardInterrupt):
        models.fit_package(made, 60.0)
    assert seen["rows"] == spark.sparkContext.defaultParallelism


def test_a_level_sends_one_row_per_task_and_node(spark):
    """Rows of a task are summed before they leave it, whatever their number and that of the trees."""
    level = trees.Level(1, np.zeros((4, 2, 1), np.int64), np.full((4, 2, 1), 5.0))
    state = spark.range(0, 4000, 1, 2).select(
        F.array((F.col("id") % 10).cast("double")).alias("x"), (F.col("id") % 3).cast("double").alias("y"),
        F.array(F.lit(1), F.lit(2), F.lit(0), (1 + F.col("id") % 2).cast("int")).alias("at"))
    ranges, left = trees.node_ranges(state, level, 3), trees.split_statistics(state, level, 3)
    assert set(ranges) == {(0, 1), (1, 2), (3, 1), (3, 2)} == set(left)
    assert ranges[0, 1].tolist() == [1334, 1333, 1333, 0, 9] and ranges[3, 2][-2:].tolist() == [1, 9]
    assert left[0, 1].sum() == 2400 and left[3, 1].sum() == 1200


def test_missing_numbers_stand_above_all_others(spark):
    level = trees.Level(0, np.zeros((1, 1, 1), np.int64), np.full((1, 1, 1), 1.0))
    state = spark.createDataFrame([([1.0], 0.0, [0]), ([float("nan")], 0.0, [0])], "x array<double>, y double, at array<int>")
    found = trees.node_ranges(state, level, 2)[0, 0]
    assert found[2] == 1.0 and math.isnan(found[3])
    assert trees.split_statistics(state, level, 2)[0, 0].tolist() == [[1.0, 0.0]]


def test_missing_values_and_targets_are_left_out(spark):
    level = trees.Level(0, np.array([[[0, 1]]]), np.array([[[2.0, 2.0]]]))
    rows = [([1.0, None], 1.0, [0]), ([None, None], 0.0, [0]), ([3.0, None], None, [0])]
    state = spark.createDataFrame(rows, "x array<double>, y double, at array<int>").coalesce(1)
    for classes, moments, left in ((2, [1, 1], [0, 1]), (0, [3, 1, 1], [1, 1, 1])):
        found = trees.node_ranges(state, level, classes)[0, 0]
        assert found[: len(moments) + 2].tolist() == [*moments, 1, 3] and np.isnan(found[-2:]).all()
        assert trees.split_statistics(state, level, classes)[0, 0].tolist() == [left, [0] * len(left)]


def test_large_forests_do_not_travel_in_the_plan(spark):
    """The arrays of a forest are data of the tasks, not constants of the expression every row interprets."""
    forest = trees.Trees.empty(40, 10, 2)
    forest.value[:] = 0.5
    df = spark.createDataFrame([([0.0],)], "x array<double>")
    model = trees.TreesModel(forest, trees.AVERAGE)
    out = model.transform(df.select(array_to_vector("x").alias("features")))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert out.first()["probability"].toArray().tolist() == [0.5, 0.5]
