import pytest
from pyspark.sql import functions as F

from tabsmith.operators import ledger, metrics, models, scoring
from tabsmith.operators.split import train_test_split
from tabsmith.operators.job import JobPaths, status_events, training_job
from tabsmith.plans import modelling
from tabsmith.session import scratch_path
from tabsmith.sources.packages import load_package, save_package
from tabsmith.sources.tables import discover, discovered_paths, read_table, write_predictions
from tabsmith.streaming.runs import RunFollower
from tabsmith.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(600).select(
        F.col("id").alias("row_id"),
        F.when(F.expr("id % 11 <> 0"), (F.expr("(id * 37) % 101") / 10.0)).alias("size"),
        F.expr("CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'green' END").alias("color"),
        F.expr("CASE WHEN (id * 37) % 101 > 50 THEN 'big' ELSE 'small' END").alias("y"),
    )


@pytest.fixture(scope="module")
def run(table):
    families = models.candidates("classification", 2)[:2]
    return models.run_training(table, "y", ["row_id"], 60, families=families)


def test_search_learns_an_easy_rule(run):
    assert run.metrics["accuracy"] > 0.85
    assert run.package.best_estimator in {"tree", "linear"} and run.config["metric"] == "f1"
    total = sum(v for _, v in run.package.importance)
    assert total == pytest.approx(1.0) and run.package.importance[0][0] == "size"


def test_package_round_trip_and_stream_agree_with_batch(spark, table, run):
    path = scratch_path(spark, "test-package") + ".model"
    save_package(run.package, path)
    loaded = load_package(path)
    want = {r["row_id"]: (r["prediction_label"], r["confidence"]) for r in scoring.score(table, run.package, "fitted").collect()}
    got = {r["row_id"]: (r["prediction_label"], r["confidence"]) for r in scoring.score(table, loaded, "fitted").collect()}
    assert got == want and set(v[0] for v in want.values()) == {"big", "small"}

    source = scratch_path(spark, "test-source")
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = scratch_path(spark, "test-scored")
    score_stream(stream, loaded, out, scratch_path(spark, "test-check"), once=True).awaitTermination()
    streamed = {r["row_id"]: (r["prediction_label"], r["confidence"]) for r in spark.read.parquet(out).collect()}
    assert streamed == want
    with pytest.raises(ValueError, match="fitted"):
        scoring.score(stream, loaded, "batch")


def test_package_path_is_checked(spark, run):
    with pytest.raises(ValueError, match="Expected a path"):
        save_package(run.package, "/tmp/nowhere.zip")
    with pytest.raises(FileNotFoundError):
        load_package(scratch_path(spark, "absent") + ".model")


def test_probabilities(table, run):
    scored = scoring.probability_map(scoring.score(table, run.package), run.package).first()
    assert set(scored["probability_map"]) == {"big", "small"}
    assert sum(scored["probability_map"].values()) == pytest.approx(1.0)
    assert scored["confidence"] == pytest.approx(max(scored["probability_map"].values()))
    shaped = scoring.shape_prediction(scoring.score(table, run.package), "classification").first()
    assert set(shaped["class_probabilities"]) == {"0", "1"}


def test_scoring_needs_every_feature(table, run):
    with pytest.raises(ValueError, match="Missing required columns"):
        scoring.score(table.drop("size"), run.package)


def test_regression_and_budget(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), F.expr("(id * 31) % 97 + 0.25").alias("a"), F.expr("(id * 17) % 89 + 0.5").alias("b"),
    ).withColumn("y", F.expr("3 * a + 2 * b + 0.001 * (row_id % 7)"))
    # a spent budget still finishes one candidate
    done = models.run_training(df, "y", ["row_id"], 0.0)
    assert [t[0] for t in done.trials] == ["linear"] and done.metrics["r2_score"] > 0.99


def test_numeric_target_with_odd_codes(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.expr("(id * 31) % 97 + 0.5").alias("a"),
    ).withColumn("y", F.expr("CASE WHEN a > 60 THEN 1 WHEN a > 30 THEN 0 ELSE -1 END"))
    done = models.run_training(df, "y", ["row_id"], 60, families=models.candidates("classification", 3)[:1])
    scored = scoring.score(df, done.package)
    assert {r["prediction_label"] for r in scored.select("prediction_label").distinct().collect()} == {"-1", "0", "1"}
    assert done.metrics["accuracy"] > 0.9
    assert scoring.class_names(done.package) == ["class_0", "class_1", "class_2"]


def test_metrics_by_hand(frame):
    df = frame("y int, p int", [0, 0, 1, 1, 2], [0, 1, 1, 1, 0])
    row = metrics.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == pytest.approx(0.6) and row["recall"] == pytest.approx(0.6)
    assert row["precision"] == pytest.approx((0.5 * 2 + 2 / 3 * 2 + 0) / 5)
    flat = metrics.regression_metrics(frame("y double, p double", [2.0, 2.0], [2.0, 2.0]), "y", "p").first()
    assert (flat["r2_score"], flat["rmse"]) == (1.0, 0.0)
    off = metrics.regression_metrics(frame("y double, p double", [2.0, 2.0], [2.0, 3.0]), "y", "p").first()
    assert off["r2_score"] == 0.0


def test_job_records_success_and_failure(spark, table):
    root = scratch_path(spark, "test-job")
    families = models.candidates("classification", 2)[:1]
    done = training_job(table, "y", ["row_id"], root, 60, families=families, job_id="good")
    with pytest.raises(ValueError):
        training_job(table, "absent", ["row_id"], root, job_id="bad")
    paths = JobPaths(root)
    states = {r["job_id"]: r for r in ledger.apply_status(status_events(spark, paths)).collect()}
    assert states["good"]["status"] == "completed" and states["good"]["error_message"] is None
    assert states["bad"]["status"] == "failed" and "absent" in states["bad"]["error_message"]
    record = spark.read.parquet(paths.records).first()
    assert record["feature_columns"] == done.package.feature_columns
    assert record["categorical_mappings"]["color"] == {"blue": 0, "green": 1, "red": 2}
    assert load_package(paths.artifact("good", "package.model")).best_estimator == "tree"


def test_follower_over_several_batches(spark):
    events = [
        ("a", "pending", 1), ("b", "running", 2), ("a", "running", 3), ("c", "pending", 4), ("a", "completed", 5),
        ("b", "failed", 6), ("a", "running", 7), ("c", "running", 8),
    ]
    df = spark.createDataFrame([(j, s, i, i) for j, s, i in events], "job_id string, status string, ts bigint, event_id bigint")
    source = scratch_path(spark, "test-events")
    for at in range(0, len(events), 3):
        df.where(F.col("ts").between(at + 1, at + 3)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    follower = RunFollower(scratch_path(spark, "test-follow"))
    job = follower.start(stream, scratch_path(spark, "test-follow-check"), once=True)
    job.awaitTermination()
    last = job.lastProgress.batchId
    got = {r["job_id"]: (r["status"], r["finished"]) for r in follower.result(spark, last).collect()}
    assert last == 2 and got == {"a": ("completed", True), "b": ("failed", True), "c": ("running", False)}
    # the state carries open runs only
    assert [r["job_id"] for r in spark.read.parquet(f"{follower.path}/open/batch={last}").collect()] == ["c"]


def test_csv_reading(spark):
    root = scratch_path(spark, "test-csv")
    rows = [("1", "x", "1.5", "True"), ("NA", "y", "nan", "False"), ("3", "N/A", "2", "True")]
    spark.createDataFrame(rows, "a string, b string, c string, d string").coalesce(1).write.option("header", True).csv(root)
    df = read_table(spark, discovered_paths(spark, root))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "boolean"}
    assert sorted(r["b"] or "" for r in df.collect()) == ["", "x", "y"]
    typed = read_table(spark, root, "a int, b string, c double, d boolean")
    assert dict(typed.dtypes)["a"] == "int" and typed.where("a IS NULL").count() == 1
    assert discover(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        discovered_paths(spark, root, "*.tsv")


def test_prediction_sink(spark, table, run):
    path = scratch_path(spark, "test-sink")
    write_predictions(scoring.score(table, run.package), path, "csv")
    assert read_table(spark, path).count() == table.count()


def test_boosted_classes_have_probabilities(spark):
    rows = [(float(i % 7), float(i % 3), ["a", "b", "c"][i % 3], i) for i in range(240)]
    df = spark.createDataFrame(rows, "x double, y double, cls string, k int")
    families = [f for f in models.candidates("classification", 3) if f[0] == "gbt"]
    run = models.run_training(df, "cls", ["k"], 60, families=families)
    got = scoring.score(df, run.package).collect()
    assert all(r["confidence"] == max(r["probabilities"]) and abs(sum(r["probabilities"]) - 1) < 1e-9 for r in got)
    assert {r["prediction_label"] for r in got} == {"a", "b", "c"}


def test_split_with_missing_keys(spark):
    df = spark.createDataFrame([(None if i % 10 < 3 else i, "ab"[i % 2]) for i in range(200)], "k int, c string")
    for target in (None, "c"):
        out = train_test_split(df, ["k"], target)
        assert out.where("_split = 'test'").count() >= 40
        assert out.where("k IS NULL").select("_split").distinct().count() <= (1 if target is None else 2)


def test_names_with_dots_and_blanks(spark, tmp_path):
    rows = [(float(i % 7), "uv"[i % 2], float(i % 3), ["a", "b"][i % 2], i) for i in range(120)]
    df = spark.createDataFrame(rows, "`sepal.length` double, `a kind` string, `per%cent` double, `the.class` string, k int")
    families = models.candidates("classification", 2)[:1]
    run = training_job(df, "the.class", ["k"], str(tmp_path), 30, families=families)
    got = scoring.score(df, run.package)
    assert got.columns[:5] == df.columns and got.where("prediction_label IS NULL").count() == 0


def test_search_tries_all_families(spark):
    rows = [(float(i % 7), float(i % 5), float(i % 3 == 0), i) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, z double, y double, k int")
    space = models.search_space("classification", 2)
    run = models.run_training(df, "y", ["k"], 600, patience=99)
    tried = [name for name, _, _ in run.trials]
    assert sorted(tried) == sorted(name for name, _ in space) and len(tried) >= 10
    assert {name.split()[0] for name in tried} == {"linear", "tree", "rf", "gbt", "extra"}
    assert models.search_space("regression", 0)[0][0] == "linear"
    assert [n for n, _ in models.search_space("regression", 0)] == [n for n, _ in models.search_space("regression", 0)]


def test_registered_training_runs_the_whole_search(spark, monkeypatch):
    """No registered query shortens the list of families or the budget."""
    seen = []

    def record(df, target, keys, *args, **kwargs):
        seen.append((args, {k: v for k, v in kwargs.items() if k != "job_id"}))
        raise RuntimeError("seen")

    monkeypatch.setattr(models, "run_training", record)
    monkeypatch.setattr(modelling, "training_job", lambda df, target, keys, root, *a, **k: record(df, target, keys, *a, **k))
    monkeypatch.setattr(modelling, "holed_lineitem", lambda *a: None)
    monkeypatch.setattr(modelling, "holed_orders", lambda *a: None)
    monkeypatch.setattr(modelling, "load", lambda *a: spark.range(1).selectExpr("id l_partkey", "id l_discount"))
    monkeypatch.setattr(modelling, "_RUNS", {})
    for run in (lambda: modelling.trained(spark, "x", "cls"), lambda: modelling.trained(spark, "x", "reg"),
                lambda: modelling.flagship(spark, "x"), lambda: modelling.training_job_query(spark, "x")):
        with pytest.raises(RuntimeError, match="seen"):
            run()
    assert seen == [((), {})] * 4
