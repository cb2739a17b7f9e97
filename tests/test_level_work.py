"""What a level of trees costs: no walk from the root, no walk below the level, small nodes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor

from tabsmith.operators import models, trees


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forests_keep_the_nodes_of_their_rows(spark, kind):
    forests = [e for _, e in models.search_space(kind, 3) if isinstance(e, RandomForestClassifier | RandomForestRegressor)]
    assert len(forests) == 3 and all(e.getCacheNodeIds() for e in forests)


def test_rows_are_walked_to_the_level_only():
    forest = trees.Trees.empty(1, 3, 1)
    forest.feature[0, [0, 2]], forest.threshold[0, [0, 2]] = [1, 0], [0.5, 2.0]
    x = np.array([[1.0, 0.0], [2.0, 1.0], [3.0, 1.0]])
    assert trees.leaves(forest, x, 0).tolist() == [[0, 0, 0]]
    assert trees.leaves(forest, x, 1).tolist() == [[1, 2, 2]]
    assert trees.leaves(forest, x).tolist() == [[1, 5, 6]]


def test_nodes_are_small_and_stored_by_tree():
    batch = pa.RecordBatch.from_pydict({"x": pa.array([[1.0], [2.0]]), "y": pa.array([0.0, 1.0])})
    for depth, kind in ((10, np.int16), (13, np.int16), (14, np.int32)):
        at = trees._stacked(2, 3, depth)(batch)[3]
        assert at.shape == (3, 2) and at.dtype == kind
        assert 2 ** (depth + 1) - 2 <= np.iinfo(kind).max


def test_level_sums_are_those_of_sorted_rows():
    """Targets of no class, missing values and rows of closed nodes, against plain loops."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 3)).round(1), rng.integers(-1, 4, 200) / 1.0
    y[:20], y[20:30] = 0.5, np.nan
    x[rng.random(x.shape) < 0.1] = np.nan
    at = rng.integers(0, 7, (2, 200)).astype(np.int16)
    level = trees.Level(2, rng.integers(0, 3, (2, 4, 2)), rng.normal(size=(2, 4, 2)))

    class Blocks:
        def getNumPartitions(self):  # noqa: N802
            return 1

        def mapPartitions(self, run):  # noqa: N802
            self.out = run(iter([(x[:90], None, y[:90], at[:, :90]), (x[90:], None, y[90:], at[:, 90:])]))
            return self

        def collect(self):
            return list(self.out)

    ranges, left = trees.node_ranges(Blocks(), level, 3), trees.split_statistics(Blocks(), level, 3)
    assert set(ranges) == {(t, n) for t in range(2) for n in range(3, 7)} == set(left)
    for t, n in ranges:
        rows = at[t] == n
        assert ranges[t, n][:3].tolist() == [(y[rows] == k).sum() for k in range(3)]
        for j in range(2):
            values = x[rows, level.feature[t, n - 3, j]]
            assert ranges[t, n][3 + 2 * j] == np.nanmin(values) and np.array_equal(ranges[t, n][4 + 2 * j], values.max(), equal_nan=True)
            assert left[t, n][j].tolist() == [(y[rows][values <= level.threshold[t, n - 3, j]] == k).sum() for k in range(3)]
