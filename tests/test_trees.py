"""Tree families grown by aggregates, and the search under its budget."""

import time

import numpy as np
import pytest
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.operators import models, scoring, trees
from tabsmith.session import scratch_path
from tabsmith.sources.packages import load_package, save_package
from tabsmith.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def data(spark):
    rows = [(float(i * 37 % 101), float(i * 53 % 97), float(i % 7), float(i * 37 % 101 > 60) + float(i % 2 and i * 53 % 97 > 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumnRenamed("y", models.LABEL).cache()


def local(data):
    rows = data.select("a", "b", "c", models.LABEL).collect()
    return np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])


def walked(model_trees, t, x):
    node = 0
    while model_trees.feature[t, node] >= 0:
        node = 2 * node + (1 if x[model_trees.feature[t, node]] <= model_trees.threshold[t, node] else 2)
    return node


@pytest.mark.parametrize("classes", [3, 0])
def test_extra_trees_against_brute_force(data, classes):
    """Every node holds exactly the statistics of its rows, and thresholds lie inside the ranges of their node."""
    x, y = local(data)
    model = trees.ExtraTrees(classes, trees=3, depth=4, min_rows=5, label=models.LABEL).fit(data)
    grown = model.trees
    for t in range(3):
        inside = {0: np.arange(len(x))}
        for node in range(grown.width):
            rows = inside.get(node)
            if rows is None:
                continue
            value = [np.mean(y[rows] == k) for k in range(3)] if classes else [y[rows].mean()]
            assert grown.value[t, node] == pytest.approx(value)
            f, mark = grown.feature[t, node], grown.threshold[t, node]
            if f >= 0:
                column = x[rows, f]
                assert column.min() <= mark < column.max()
                inside[2 * node + 1], inside[2 * node + 2] = rows[column <= mark], rows[column > mark]
                assert min(len(inside[2 * node + 1]), len(inside[2 * node + 2])) >= 5
        assert grown.feature[t, 0] >= 0
    want = np.array([np.mean([grown.value[t, walked(grown, t, r)] for t in range(3)], 0) for r in x])
    got = model.transform(data).collect()
    if classes:
        assert np.array([r["probability"].toArray() for r in got]) == pytest.approx(want)
        assert [r["prediction"] for r in got] == want.argmax(1).tolist()
    else:
        assert [r["prediction"] for r in got] == pytest.approx(want[:, 0])
    assert sum(model.importances) == pytest.approx(1.0) and model.importances[2] < max(model.importances)


def test_extra_trees_repeat_their_draws(data):
    one, two = (trees.ExtraTrees(3, trees=2, depth=2, label=models.LABEL).fit(d).trees for d in (data, data.repartition(3)))
    assert (one.feature == two.feature).all() and one.threshold == pytest.approx(two.threshold)
    constant = data.withColumn(models.LABEL, F.lit(1.0))
    assert (trees.ExtraTrees(3, trees=2, depth=2, label=models.LABEL).fit(constant).trees.feature == trees.LEAF).all()


def test_boosting_falls_every_round(data, spark):
    model = trees.SoftmaxBoosting(3, rounds=4, depth=3, step=0.5, label=models.LABEL).fit(data)
    assert len(model.losses) == 5 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    x, y = local(data)
    got = model.transform(data).collect()
    p = np.array([r["probability"].toArray() for r in got])
    assert p.sum(1) == pytest.approx(1.0, abs=1e-12)
    assert -np.log(p[np.arange(len(y)), y.astype(int)]).mean() == pytest.approx(model.losses[-1])
    raw = np.array([[model.start[k] + sum(model.trees.value[t, walked(model.trees, t, r), 0] for t in range(k, model.trees.count, 3)) for k in range(3)] for r in x])
    want = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    assert p == pytest.approx(want)
    path = scratch_path(spark, "stage")
    PipelineModel([model]).write().overwrite().save(path)
    again = PipelineModel.load(path).stages[0]
    assert again.losses == model.losses and [r["probability"] for r in again.transform(data).collect()] == [r["probability"] for r in got]


@pytest.mark.parametrize("name", ["gbt", "extra"])
def test_packages_of_own_families(spark, name):
    rows = [(float(i % 7), float(i % 3), ["a", "b", "c"][i % 3], i) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, z double, cls string, k int")
    space = [("extra", trees.ExtraTrees(3, 3, 3, label=models.LABEL))] if name == "extra" else [("gbt", trees.SoftmaxBoosting(3, 2, 2, label=models.LABEL))]
    run = models.run_training(df, "cls", ["k"], 120, families=space)
    assert run.package.best_estimator == name and sum(v for _, v in run.package.importance) == pytest.approx(1.0)
    path = scratch_path(spark, "package") + ".model"
    save_package(run.package, path)
    loaded = load_package(path)
    want = sorted((r["k"], r["prediction_label"], r["confidence"]) for r in scoring.score(df, run.package, "fitted").collect())
    assert sorted((r["k"], r["prediction_label"], r["confidence"]) for r in scoring.score(df, loaded, "fitted").collect()) == want
    source, out = scratch_path(spark, "source"), scratch_path(spark, "out")
    df.write.parquet(source)
    score_stream(spark.readStream.schema(df.schema).parquet(source), loaded, out, scratch_path(spark, "check"), once=True).awaitTermination()
    assert sorted((r["k"], r["prediction_label"], r["confidence"]) for r in spark.read.parquet(out).collect()) == want


def test_families_have_their_names():
    for kind, classes in (("classification", 3), ("classification", 2), ("regression", 0)):
        space = dict(models.search_space(kind, classes))
        assert isinstance(space["extra"], trees.ExtraTrees) and isinstance(space["extra trees=40 depth=10"], trees.ExtraTrees)
    assert isinstance(dict(models.search_space("classification", 3))["gbt"], trees.SoftmaxBoosting)


class Slow(Estimator):
    """Fits a tree after jobs that take about this many seconds."""

    def __init__(self, seconds, then=None, error=None):
        super().__init__()
        self.seconds, self.then, self.error = seconds, then, error

    def _fit(self, dataset):
        if self.error:
            raise self.error
        spark = dataset.sparkSession
        for _ in range(int(self.seconds * 5)):
            _sleep(spark, 0.2)
        return self.then.fit(dataset)


def _sleep(spark, seconds):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    spark.range(0, 1, 1, 1).mapInArrow(wait, "id long").collect()


@pytest.fixture(scope="module")
def quick(data):
    return data.select("features", models.LABEL), models.candidates("classification", 3)[0][1]


def test_deadline_cuts_candidates_off(quick):
    df, tree = quick
    families = [("quick", tree), ("slow", Slow(60, tree)), ("slower", Slow(90, tree)), ("never", tree)]
    began = time.monotonic()
    found = models.select_model(df, "classification", 3, 12.0, families=families, parallel=2)
    assert time.monotonic() - began < 12.0 * 1.1 and found.seconds < 12.0 * 1.1
    assert "quick" in {t[0] for t in found.trials} and {n for n, _, why in found.cut_off if why == "deadline"} >= {"slow", "slower"}
    assert found.refitted and found.best in {"quick", "never"}
    assert not df.sparkSession.sparkContext.getJobTags()


def test_a_refit_that_would_pass_the_budget_leaves_the_trial_model(quick):
    df, tree = quick

    class Twice(Slow):
        fits = 0

        def _fit(self, dataset):
            Twice.fits += 1
            self.seconds = 0.2 if Twice.fits == 1 else 60
            return super()._fit(dataset)

    found = models.select_model(df, "classification", 3, 10.0, families=[("twice", Twice(0, tree))])
    assert not found.refitted and found.seconds < 11.0 and found.model.transform(df).count() == df.count()


def test_patience_follows_the_order(quick):
    df, tree = quick
    bad = models.candidates("classification", 3)[1][1].copy().setMaxIter(0)
    families = [("tree", tree), ("late", Slow(3, bad)), ("bad", bad), ("tree again", tree), ("more", bad)]
    found = models.select_model(df, "classification", 3, 600.0, patience=2, families=families)
    assert [t[0] for t in found.trials] == ["tree", "late", "bad"] and found.best == "tree"
    assert all(why == "patience" for _, _, why in found.cut_off)


def test_failing_candidates(quick):
    df, tree = quick
    bad = Slow(0, error=RuntimeError("no fit"))
    found = models.select_model(df, "classification", 3, 600.0, families=[("bad", bad), ("tree", tree)])
    assert [t[0] for t in found.trials] == ["tree"] and [(n, why) for n, _, why in found.cut_off] == [("bad", "failed")]
    with pytest.raises(RuntimeError, match="no fit"):
        models.select_model(df, "classification", 3, 600.0, families=[("bad", bad)])
