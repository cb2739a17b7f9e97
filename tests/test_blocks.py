"""Trees grow over stored blocks of arrays: a level plans no query, and sums are whole however they are added."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.operators import trees


@pytest.fixture(scope="module")
def table(spark):
    rows = [([float(i * 37 % 101), float(i * 53 % 97)], float(i * 37 % 101 > 60) + float(i * 53 % 97 > 50)) for i in range(600)]
    return spark.createDataFrame(rows, "x array<double>, y double").repartition(6).select(array_to_vector("x").alias("features"), "y").cache()


def grown(table, rounds, depth):
    return trees.boost(table, "y", 3, rounds, depth, 0.1, 1), trees.grow_extra(table, "y", 3, 3, depth, 1, 7)


def test_levels_plan_no_queries(table, monkeypatch):
    """Rounds and levels cost jobs over the blocks, not queries of their own."""
    planned, frame = [], type(table)
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: planned.append(1) or run(self, *a, **k))
    sizes = []
    for rounds, depth in ((1, 1), (3, 3)):
        planned.clear()
        grown(table, rounds, depth)
        sizes.append(len(planned))
    assert sizes[0] == sizes[1] == 3  # distinct values for bins, blocks of each family


def test_sums_added_in_tasks_are_the_same(table, monkeypatch):
    (one, _, losses, _), (extra, _) = grown(table, 2, 3)
    monkeypatch.setattr(trees, "SENT_BYTES", 0)
    (two, _, again, _), (spread, _) = grown(table, 2, 3)
    for a, b in ((one, two), (extra, spread)):
        assert (a.feature == b.feature).all() and a.threshold == pytest.approx(b.threshold) and a.value == pytest.approx(b.value)
    assert again == pytest.approx(losses)


def test_blocks_end_by_rows_and_hold_all(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 1)
    df = spark.range(0, 25_000, 1, 1).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("y"))
    small = trees._blocks(df, trees._stacked(2, 1)).map(lambda b: b[0][:, 0].tolist()).collect()
    assert [v for b in small for v in b] == list(range(25_000)) and len(small) > 1
    monkeypatch.undo()
    assert trees._blocks(df, trees._stacked(2, 1)).count() == 1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x array<double>, y double")
    level = trees.Level(0, np.zeros((1, 1, 1), np.int64), np.zeros((1, 1, 1)))
    state = empty.withColumn("at", F.array(F.lit(0)))
    assert trees.node_ranges(state, level, 2) == {} == trees.split_statistics(state, level, 2)
