"""Boosting of several classes: bins from all rows, all trees of a round in one pass per level."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.operators import trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 5, 900), rng.normal(size=900).round(2), np.zeros(900)]).astype(float)
    y = (x[:, 0] > 2) + 2 * (x[:, 1] > 0.7) * (rng.random(900) < 0.8)
    y = np.minimum(y, 2).astype(float)
    rows = [(a.tolist(), b) for a, b in zip(x, y.tolist())]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(5)
    return x, y, df.select(array_to_vector("x").alias("features"), "y")


def test_few_values_are_parted_one_by_one(spark):
    """A value of one row among thousands keeps its border; many values give bins of about equal size."""
    df = spark.range(0, 20_000, 1, 4).select(F.array(
        F.when(F.col("id") == 7, 9.0).otherwise((F.col("id") % 2).cast("double")), F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    few, many, one = trees.bin_edges(df, 3)
    assert few.tolist() == [0.5, 5.0] and len(one) == 0 and len(many) == trees.BINS - 1
    assert np.diff(many, prepend=0, append=20_000) == pytest.approx(20_000 / trees.BINS, rel=0.1)
    # as many values as bins, then one more
    edge = df.select(F.array(F.floor(F.col("x")[1] % 32), F.floor(F.col("x")[1] % 33)).cast("array<double>").alias("x"))
    assert [len(e) for e in trees.bin_edges(edge, 2)] == [31, 31]


def test_splits_are_the_best_of_all_bins(table):
    x, y, df = table
    grown, start, losses, _ = trees.boost(df, "y", 3, 1, 2, 0.5, 1)
    edges = trees.bin_edges(df.select(F.col("y"), trees.vector_to_array("features").alias("x")), 3)
    raw = np.tile(start, (len(y), 1))
    p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    r = (y[:, None] == np.arange(3)) - p

    def best(rows, k):
        found = []
        for j, cuts in enumerate(edges):
            for c in cuts:
                left = rows & (x[:, j] <= c)
                right = rows & ~left
                if left.any() and right.any():
                    found.append((sum(r[s, k].sum() ** 2 / s.sum() for s in (left, right)), j, c, left, right))
        return max(found, key=lambda f: f[0])

    for k in range(3):
        _, j, c, left, right = best(np.ones(len(y), bool), k)
        assert (grown.feature[k, 0], grown.threshold[k, 0]) == (j, c)
        for node, rows in ((1, left), (2, right)):
            _, j, c, *parts = best(rows, k)
            if grown.feature[k, node] < 0:
                assert np.ptp(r[rows, k]) == pytest.approx(0)
                continue
            assert (grown.feature[k, node], grown.threshold[k, node]) == (j, c)
            for child, part in zip((2 * node + 1, 2 * node + 2), parts):
                size = np.abs(r[part, k])
                newton = 2 / 3 * r[part, k].sum() / (size * (1 - size)).sum()
                assert grown.value[k, child, 0] == pytest.approx(0.5 * np.clip(newton, -4, 4))


def test_a_round_takes_one_pass_per_level(table, monkeypatch):
    _, _, df = table
    passes, level = [], trees._level
    monkeypatch.setattr(trees, "_level", lambda *a: passes.append(a[2]) or level(*a))
    trees.boost(df, "y", 3, 2, 3, 0.1, 1)
    assert passes == [0, 1, 2, 0, 1, 2, 0]
    # wide tables take several passes with the same outcome
    monkeypatch.setattr(trees, "SUM_BYTES", 1)
    wide = trees.boost(df, "y", 3, 1, 2, 0.1, 1)
    monkeypatch.undo()
    whole = trees.boost(df, "y", 3, 1, 2, 0.1, 1)
    assert (wide[0].feature == whole[0].feature).all() and wide[2] == pytest.approx(whole[2])


def test_extra_trees_draw_for_open_nodes_only(spark, monkeypatch):
    rows = [([float(i % 16)], float(i % 16 >= 9 and i % 2)) for i in range(160)]
    df = spark.createDataFrame(rows, "x array<double>, y double").select(array_to_vector("x").alias("features"), "y")
    drawn, made = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: drawn.append(seed[1:]) or made(seed))
    grown, _ = trees.grow_extra(df, "y", 2, 3, 4, 1, 7)
    split = {(t, int(n)) for t in range(3) for n in np.flatnonzero(grown.feature[t] >= 0)}
    assert set(drawn) == {(t, 0) for t in range(3)} | {(t, 2 * n + c) for t, n in split if n < 7 for c in (1, 2)}
    assert len(drawn) < 3 * 15
