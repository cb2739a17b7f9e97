"""Candidate search under a time budget, refit, importances and the training job."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators import metrics as M
from tabsmith.operators.detect import time_budget
from tabsmith.operators.permutation import permutation_importance
from tabsmith.operators.prepare import SPLIT_COLUMN, Prepared, preprocess
from tabsmith.operators.trees import ExtraTrees, SoftmaxBoosting
from tabsmith.session import scratch_path

FEATURE_PREFIX = "_x_"


def internal_name(feature: str) -> str:
    """Column of a feature inside the model: without the characters that names are parsed by."""
    return FEATURE_PREFIX + feature.replace("%", "%25").replace(".", "%2E").replace("`", "%60")


LABEL = "_label"
PATIENCE = 6
FOLDS = 10
SEED = 42
#: Bytes of vectors in a file of the prepared table, which is read by one task.
PART_BYTES = 32 << 20
#: Candidates fitted at the same time.
PARALLEL = 3
#: The refit is expected to take this many times the trial of the same candidate.
REFIT_SHARE = 1.2
#: Rows keep the nodes they are in, so a level does not walk them down every tree again.
FOREST = {"cacheNodeIds": True}


def model_input(c: Column, dtype: T.DataType) -> Column:
    """A prepared feature as a double: times become epoch seconds, what is still missing becomes 0."""
    if isinstance(dtype, T.TimestampNTZType):
        c = c.cast("timestamp")
    if isinstance(dtype, T.DateType):
        c = F.unix_date(c)
    return F.coalesce(c.cast("double"), F.lit(0.0))


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Plain numbers in, so no column is taken for a nominal one whatever its codes are."""
    return VectorAssembler(inputCols=[internal_name(c) for c in features], outputCol="features")


def with_inputs(df: DataFrame, features: Sequence[str], sources: dict[str, str] | None = None) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    source = sources or {c: c for c in features}
    return df.withColumns({
        internal_name(c): model_input(F.col(f"`{source[c]}`"), types[source[c]]) for c in features
    })


def candidates(problem_type: str, class_count: int) -> list[tuple[str, Estimator]]:
    """Model families, cheapest first."""
    cols = {"featuresCol": "features", "labelCol": LABEL}
    if problem_type == "regression":
        return [
            ("linear", LinearRegression(regParam=1e-6, **cols)),
            ("tree", DecisionTreeRegressor(maxDepth=6, seed=SEED, **cols)),
            ("rf", RandomForestRegressor(numTrees=20, maxDepth=6, seed=SEED, **FOREST, **cols)),
            ("gbt", GBTRegressor(maxIter=10, maxDepth=4, seed=SEED, **cols)),
        ]
    boosted: Estimator = GBTClassifier(maxIter=10, maxDepth=4, seed=SEED, **cols)
    if class_count > 2:
        boosted = SoftmaxBoosting(class_count, rounds=10, depth=4, seed=SEED, label=LABEL)
    return [
        ("tree", DecisionTreeClassifier(maxDepth=6, seed=SEED, **cols)),
        ("linear", LogisticRegression(maxIter=20, **cols)),
        ("rf", RandomForestClassifier(numTrees=20, maxDepth=6, seed=SEED, **FOREST, **cols)),
        ("gbt", boosted),
    ]


def search_space(problem_type: str, class_count: int, seed: int = SEED) -> list[tuple[str, Estimator]]:
    """What the search tries: every family once, cheapest first, then more settings in a seeded order."""
    cols = {"featuresCol": "features", "labelCol": LABEL, "seed": seed}
    regression = problem_type == "regression"
    forest = RandomForestRegressor if regression else RandomForestClassifier
    single = DecisionTreeRegressor if regression else DecisionTreeClassifier
    boosting = GBTRegressor if regression else GBTClassifier

    def boosted(rounds: int, depth: int, step: float = 0.1) -> Estimator:
        if not regression and class_count > 2:
            return SoftmaxBoosting(class_count, rounds, depth, step, seed, LABEL)
        return boosting(maxIter=rounds, maxDepth=depth, stepSize=step, **cols)

    def extra(trees: int, depth: int) -> Estimator:
        return ExtraTrees(0 if regression else max(class_count, 2), trees, depth, seed=seed, label=LABEL)

    first = candidates(problem_type, class_count)
    first.append(("extra", extra(20, 6)))
    more = [
        ("tree depth=10 rows=5", single(maxDepth=10, minInstancesPerNode=5, **cols)),
        ("rf trees=40 depth=10", forest(numTrees=40, maxDepth=10, **FOREST, **cols)),
        ("rf trees=40 depth=8 rows=10", forest(numTrees=40, maxDepth=8, minInstancesPerNode=10, **FOREST, **cols)),
        ("extra trees=40 depth=10", extra(40, 10)),
        ("gbt rounds=20 depth=5", boosted(20, 5)),
        ("gbt rounds=30 depth=3 step=0.05", boosted(30, 3, 0.05)),
    ]
    random.Random(seed).shuffle(more)
    return first + more


def judged_fold(train: DataFrame, fold: Column) -> int | None:
    """A fold that leaves rows on both sides; None where the rows are too few for any."""
    sizes = {r["fold"]: r["n"] for r in train.groupBy(fold.alias("fold")).agg(F.count("*").alias("n")).collect()}
    return min(sizes) if len(sizes) > 1 else None


def selection_metric(problem_type: str, class_count: int) -> str:
    if problem_type == "regression":
        return "r2"
    return "accuracy" if class_count > 2 else "f1"


def metric_value(scored: DataFrame, metric: str) -> float:
    if metric == "accuracy":
        row = M.classification_metrics(scored.withColumn("prediction", F.col("prediction").cast("int")).withColumn(LABEL, F.col(LABEL).cast("int")), LABEL, "prediction").first()
        return float(row["accuracy"] or 0.0)
    if metric == "f1":
        ints = scored.select(F.col(LABEL).cast("int").alias(LABEL), F.col("prediction").cast("int").alias("prediction"))
        return float(M.binary_f1(ints, LABEL, "prediction").first()["f1"])
    row = M.regression_metrics(scored, LABEL, "prediction").first()
    if metric == "r2":
        return float(row["r2_score"])
    if metric in ("rmse", "mae"):
        return -float(row[metric])
    raise ValueError(f"unknown metric '{metric}'")


@dataclass
class Search:
    """``trials`` are the judged candidates in their order, ``cut_off`` the others that were started: name, seconds, why."""

    model: Model
    best: str
    metric: str
    trials: list[tuple[str, float, float]]
    seconds: float
    cut_off: list[tuple[str, float, str]] = field(default_factory=list)
    refitted: bool = True


class _Attempt(threading.Thread):
    """One piece of work in a thread of its own, whose Spark jobs carry a tag by which they are cancelled."""

    def __init__(self, context, work: Callable[[], object]):
        super().__init__(daemon=True)
        self.context, self.work, self.tag = context, work, f"tabsmith-{uuid.uuid4().hex}"
        self.began, self.seconds = time.monotonic(), 0.0
        self.result: object = None
        self.error: Exception | None = None

    def run(self) -> None:
        self.context.addJobTag(self.tag)
        try:
            self.result = self.work()
        except Exception as e:  # noqa: BLE001 - the search decides what an error means
            self.error = e
        finally:
            self.seconds = time.monotonic() - self.began
            self.context.clearJobTags()

    @staticmethod
    def cancel(attempts: Sequence[_Attempt]) -> None:
        """Cancel all of them until their threads have ended: between two jobs of a fit there is nothing to cancel."""
        while alive := [a for a in attempts if a.is_alive()]:
            for a in alive:
                a.context.cancelJobsWithTag(a.tag)
            alive[0].join(0.05)


def select_model(
    train: DataFrame,
    problem_type: str,
    class_count: int,
    budget_s: float,
    metric: str = "auto",
    patience: int = PATIENCE,
    families: list[tuple[str, Estimator]] | None = None,
    parallel: int = PARALLEL,
) -> Search:
    """Fit candidates (all of ``search_space`` by default) on nine tenths of ``train`` (columns features, label), judge them on the rest,
    refit the best on all of it.

    ``parallel`` candidates are fitted at a time. The budget is wall-clock time of search and refit: when only
    the time the refit needs is left, what still runs is cancelled, and a refit that would pass the budget is
    cancelled too and leaves the model of the trial. One candidate, the first of those running, is always
    finished. The search also stops after ``patience`` candidates, in their order, without a gain, whatever
    later ones gave; so without a deadline the choice does not depend on which of them ended first. A
    candidate that fails is left out; if all fail, the first error is raised. The tenth is chosen by a hash
    of the row.
    """
    wanted = selection_metric(problem_type, class_count) if metric == "auto" else metric
    start = time.monotonic()
    context = train.sparkSession.sparkContext
    fold = F.pmod(F.xxhash64("features", LABEL), F.lit(FOLDS))
    rows = train.select("features", LABEL, fold.alias("fold")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        judged = judged_fold(rows, F.col("fold"))
        # very few rows: they are fitted and judged together
        fit_part, judge_part = (rows, rows) if judged is None else (rows.where(F.col("fold") != judged), rows.where(F.col("fold") == judged))

        def attempt(estimator: Estimator) -> tuple[float, Model]:
            model = estimator.fit(fit_part)
            return metric_value(model.transform(judge_part), wanted), model

        queue = families or search_space(problem_type, class_count)
        attempts: dict[int, _Attempt] = {}
        spent = lambda: time.monotonic() - start
        while True:
            done = [i for i, a in attempts.items() if not a.is_alive()]
            judged_ones = [i for i in sorted(done) if attempts[i].error is None]
            ahead = _before_patience(attempts, patience)
            best = max((i for i in judged_ones if i in ahead.kept), key=lambda i: (attempts[i].result[0], -i), default=None)
            reserve = 0.0 if best is None else REFIT_SHARE * attempts[best].seconds
            late = spent() + reserve >= budget_s
            if (late and best is not None) or ahead.ended or (len(done) == len(queue)):
                break
            running = [i for i in attempts if attempts[i].is_alive()]
            if late and running:
                _Attempt.cancel([attempts[i] for i in running[1:]])
                running = running[:1]
            if len(attempts) < len(queue) and len(running) < (1 if late else parallel):
                i = len(attempts)
                attempts[i] = _Attempt(context, lambda estimator=queue[i][1]: attempt(estimator))
                attempts[i].start()
                continue
            time.sleep(0.02)
        # when time ran out every judged candidate counts, else those before patience ended
        counted = [i for i in judged_ones if i in ahead.kept] if ahead.ended else judged_ones
        why = {i: "patience" if ahead.ended else "deadline" for i in attempts if i not in counted}
        for i in why:
            if not attempts[i].is_alive() and attempts[i].error is not None and not late:
                why[i] = "failed"
        _Attempt.cancel([attempts[i] for i in why])
        if not counted:
            raise next(a.error for a in attempts.values() if a.error is not None)
        best = max(counted, key=lambda i: (attempts[i].result[0], -i))
        trials = [(queue[i][0], attempts[i].result[0], attempts[i].seconds) for i in counted]
        cut_off = [(queue[i][0], attempts[i].seconds, why[i]) for i in sorted(why)]
        refit = _Attempt(context, lambda: queue[best][1].fit(rows))
        refit.start()
        refit.join(max(budget_s - spent(), 0.0))
        _Attempt.cancel([refit])
        model = attempts[best].result[1] if refit.error is not None or refit.result is None else refit.result
        return Search(model, queue[best][0], wanted, trials, spent(), cut_off, refit.result is not None)
    finally:
        rows.unpersist()


@dataclass
class _Ahead:
    kept: set[int]
    ended: bool


def _before_patience(attempts: dict[int, _Attempt], patience: int) -> _Ahead:
    """The candidates, in their order, up to the one that exhausts the patience; later ones do not count."""
    best, stale, kept = None, 0, set(attempts)
    for i in range(len(attempts)):
        if attempts[i].is_alive():
            break
        if attempts[i].error is None and (best is None or attempts[i].result[0] > best):
            best, stale = attempts[i].result[0], 0
        else:
            stale += 1
        if best is not None and stale >= patience:
            return _Ahead(set(range(i + 1)), True)
    return _Ahead(kept, False)


def feature_importance(
    model: Model, features: Sequence[str], train: DataFrame | None = None, held_out: DataFrame | None = None,
    problem_type: str = "regression",
) -> list[tuple[str, float]]:
    """(feature, importance) falling. Trees: their own; linear: |coefficient| x deviation; one-vs-rest:
    the average of its parts; otherwise, where held-out rows are given, the shares of what exchanging each
    feature between them costs; otherwise equal weights."""
    if not features:
        return []
    values: list[float] | None = None
    if hasattr(model, "featureImportances"):
        values = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "models"):
        parts = [dict(feature_importance(m, features, train)) for m in model.models]
        values = [sum(p[f] for p in parts) / len(parts) for f in features]
    elif hasattr(model, "coefficientMatrix") or hasattr(model, "coefficients"):
        if hasattr(model, "coefficientMatrix"):
            size = [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
        else:
            size = [abs(float(v)) for v in model.coefficients.toArray()]
        spread = [1.0] * len(features)
        if train is not None:
            row = train.agg(Summarizer.std(F.col("features")).alias("s")).first()
            spread = [0.0] * len(features) if row["s"] is None else [float(v) for v in row["s"].toArray()]
        weighted = [s * d for s, d in zip(size, spread)]
        total = sum(weighted)
        values = [v / total for v in weighted] if total > 0 else None
    elif held_out is not None:
        lost = permutation_importance(model, held_out, features, LABEL, problem_type == "classification").collect()
        kept = {r["feature"]: max(r["importance"] or 0.0, 0.0) for r in lost}
        total = sum(kept.values())
        values = [kept[f] / total for f in features] if total > 0 else None
    if values is None:
        values = [1.0 / len(features)] * len(features)
    return sorted(zip(features, values), key=lambda kv: (-kv[1], kv[0]))


@dataclass
class Package:
    """Everything scoring needs; see ``tabsmith.sources.packages`` for its stored form."""

    pipeline: PipelineModel
    problem_type: str
    target: str
    feature_columns: list[str]
    categorical_columns: list[str]
    numeric_columns: list[str]
    medians: dict[str, float | None]
    dictionary: DataFrame | None
    labels: DataFrame | None
    label_is_text: bool
    importance: list[tuple[str, float]]
    best_estimator: str
    sizes: dict[str, tuple[int, int]] = field(default_factory=dict)


@dataclass
class TrainingRun:
    job_id: str
    package: Package
    metrics: dict[str, object]
    trials: list[tuple[str, float, float]]
    prepared: Prepared
    test: DataFrame
    config: dict[str, object]
    cut_off: list[tuple[str, float, str]] = field(default_factory=list)


def labelled(prepared: Prepared) -> tuple[DataFrame, DataFrame | None]:
    """The prepared table with a 0..k-1 label, and the (code, label) table of a classification."""
    df, target = prepared.df, prepared.target
    if prepared.problem_type == "regression":
        return df.withColumn(LABEL, F.col(f"`{target}`").cast("double")), None
    if prepared.target_mapping is not None:
        return df.withColumn(LABEL, F.col(f"`{target}`").cast("double")), prepared.target_mapping
    # a numeric target is a classification only with fewer than 20 distinct values
    classes = sorted(r[0] for r in df.select(f"`{target}`").where(F.col(f"`{target}`").isNotNull()).distinct().collect())
    spark = df.sparkSession
    mapping = spark.createDataFrame([(i, str(v)) for i, v in enumerate(classes)], "code int, label string")
    code = F.lit(None).cast("double")
    for i, v in enumerate(classes):
        code = F.when(F.col(f"`{target}`") == F.lit(v), float(i)).otherwise(code)
    return df.withColumn(LABEL, code), mapping


def fit_package(prepared: Prepared, budget_s: float, metric: str = "auto", patience: int = PATIENCE,
                families: list[tuple[str, Estimator]] | None = None) -> tuple[Package, Search, DataFrame]:
    """Search on the train part; returns the package, the search and the labelled test part.

    The labelled table is written once to the shared folder as vectors: every candidate makes several
    passes over it and none should repeat the encoding joins or assemble the vectors again.
    """
    spark = prepared.df.sparkSession
    features = prepared.feature_columns
    table, labels = labelled(prepared)
    slim = assembler(features).transform(with_inputs(table, features)).select("features", LABEL, SPLIT_COLUMN)
    path = scratch_path(spark, "prepared")
    # the shuffles before end in as few tasks as the rows fill, and every fit would run in those
    parts = max(spark.sparkContext.defaultParallelism, -(-prepared.row_count * (len(features) + 2) * 8 // PART_BYTES))
    slim.where(F.col(LABEL).isNotNull()).repartition(parts).write.parquet(path)
    stored = spark.read.parquet(path)
    train = stored.where(F.col(SPLIT_COLUMN) == "train").select("features", LABEL)
    test = stored.where(F.col(SPLIT_COLUMN) == "test").select("features", LABEL)
    search = select_model(train, prepared.problem_type, prepared.class_count, budget_s, metric, patience, families)
    package = Package(
        pipeline=PipelineModel([assembler(features), search.model]),
        problem_type=prepared.problem_type, target=prepared.target, feature_columns=features,
        categorical_columns=prepared.categorical_columns, numeric_columns=prepared.numeric_columns,
        medians=prepared.medians, dictionary=prepared.dictionary, labels=labels,
        label_is_text=prepared.target_mapping is not None,
        importance=feature_importance(search.model, features, train, test, prepared.problem_type),
        best_estimator=search.best, sizes=prepared.sizes,
    )
    return package, search, test


def evaluate(model: Model, test: DataFrame, problem_type: str) -> dict[str, float]:
    """Metrics on the held-out part."""
    scored = model.transform(test).select(LABEL, "prediction")
    if problem_type == "classification":
        ints = scored.select(F.col(LABEL).cast("int").alias(LABEL), F.col("prediction").cast("int").alias("prediction"))
        row = M.classification_metrics(ints, LABEL, "prediction").first()
    else:
        row = M.regression_metrics(scored, LABEL, "prediction").first()
    return {k: float(v) for k, v in row.asDict().items()}


def run_training(
    df: DataFrame,
    target: str,
    keys: Sequence[str] | Column,
    budget_s: float | None = None,
    metric: str = "auto",
    patience: int = PATIENCE,
    families: list[tuple[str, Estimator]] | None = None,
    job_id: str | None = None,
) -> TrainingRun:
    """Prepare, search, evaluate; the record of the run and its package."""
    prepared = preprocess(df, target, keys)
    if budget_s is None:
        one = df.sparkSession.range(1).select(time_budget(F.lit(prepared.row_count)).alias("b"))
        budget_s = float(one.first()["b"])
    package, search, test = fit_package(prepared, budget_s, metric, patience, families)
    values: dict[str, object] = dict(evaluate(search.model, test, prepared.problem_type))
    values["training_time"] = search.seconds
    values["best_estimator"] = search.best
    config = {
        "time_budget": budget_s, "rows": prepared.row_count, "columns": len(df.columns),
        "metric": search.metric, "best_estimator": search.best,
    }
    return TrainingRun(job_id or uuid.uuid4().hex, package, values, search.trials, prepared, test, config, search.cut_off)


def trial_table(run: TrainingRun) -> DataFrame:
    """One row per candidate that was started, also of those that were cut off or failed (without a score)."""
    spark = run.prepared.df.sparkSession
    kind, best = run.package.problem_type, run.package.best_estimator
    rows = [(kind, n, s, n == best, "judged", t) for n, s, t in run.trials]
    rows += [(kind, n, None, False, why, t) for n, t, why in run.cut_off]
    return spark.createDataFrame(rows, "problem_type string, family string, score double, is_best boolean, state string, seconds double")
