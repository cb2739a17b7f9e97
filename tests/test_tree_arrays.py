"""What Python workers load and keep while trees grow, and the sums they make."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.operators import tree_arrays, trees


def test_workers_import_no_spark_for_the_arrays_of_trees():
    code = "import sys, tabsmith.operators.tree_arrays; print([m for m in sys.modules if m.startswith(('pyspark', 'pandas'))])"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], check=True)
    assert found.stdout.strip() == "[]"
    for task_side in (trees.leaves, trees.averages, trees.Trees, trees.Level, trees._binned, trees._residuals):
        assert task_side.__module__ == "tabsmith.operators.tree_arrays"


@pytest.mark.parametrize(("estimator", "step"), [(trees.SoftmaxBoosting(2, 2, 2), "_round"), (trees.ExtraTrees(2, 2, 3), "split_statistics")])
def test_a_fit_that_fails_leaves_no_stored_blocks(spark, monkeypatch, estimator, step):
    """A candidate cut off at the deadline must not keep its blocks while the best one is refitted."""
    data = spark.range(0, 200, 1, 2).select(
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
        (F.col("id") % 2).cast("double").alias("label"))
    stored = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray())
    before, met = stored(), []

    def stop(*_, **__):
        met.append(stored() - before)
        raise RuntimeError("cut off")

    monkeypatch.setattr(trees, step, stop)
    with pytest.raises(RuntimeError, match="cut off"):
        estimator.fit(data)
    assert met[0] and not stored() & met[0]


@pytest.mark.parametrize("nodes", [1, 3, 40])
@pytest.mark.parametrize("columns", [1, 2, 5])
def test_two_columns_counted_at_a_time_give_the_sums_of_each(nodes, columns):
    rng = np.random.default_rng(3)
    node, bins = rng.integers(0, nodes, 500), rng.integers(0, 32, (columns, 500)).astype(np.int8)
    weight = rng.normal(size=500)
    found = tree_arrays._by_bin(node, bins, (None, weight), nodes, 32)
    want = np.zeros((2, nodes, columns, 32))
    for j in range(columns):
        for i in range(500):
            want[:, node[i], j, bins[j, i]] += 1, weight[i]
    assert (found[0] == want[0]).all() and np.allclose(found[1], want[1], atol=1e-12)


def test_residuals_of_rows_with_and_without_a_known_class():
    raw = np.array([[0.0, 1.0, -1.0], [2.0, 0.0, 0.5], [0.1, 0.2, 0.3]])
    kept = raw.copy()
    r, lost = tree_arrays._residuals(np.array([1.0, 0.0, 7.0]), raw)
    p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    assert np.allclose(r.T, [[0, 1, 0], [1, 0, 0], [0, 0, 0]] - p) and (raw == kept).all()
    assert lost == pytest.approx(-np.log(p[0, 1]) - np.log(p[1, 0]) - np.log(1e-300))
    one, _ = tree_arrays._residuals(np.array([0.0]), kept[:1])
    assert np.allclose(one[:, 0], r[:, 0] + [1, -1, 0]) and (kept == raw).all()


def test_ranges_are_the_same_with_and_without_missing_values_elsewhere(spark):
    """Rows without gaps are not sorted; the ranges are those of rows beside a gap, which are."""
    level = trees.Level(1, np.array([[[0], [0]]]))
    rows = [([float(v), 0.0], float(v % 2), [1 + v % 2]) for v in range(9)] + [([float("inf"), 0.0], 0.0, [1]), ([-float("inf"), 0.0], 0.0, [2])]
    schema = "x array<double>, y double, at array<int>"
    plain = trees.node_ranges(spark.createDataFrame(rows, schema).coalesce(1), level, 2)
    gaps = trees.node_ranges(spark.createDataFrame([*rows, ([1.0, None], None, [0])], schema).coalesce(1), level, 2)
    assert {k: v.tolist() for k, v in plain.items()} == {k: v.tolist() for k, v in gaps.items()}
    assert plain[0, 1].tolist() == [6, 0, 0, float("inf")] and plain[0, 2].tolist() == [1, 4, -float("inf"), 7]
