"""Search, evaluation, scoring, package and report queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators import ledger, metrics, models, prepare, scoring, trees
from tabsmith.operators.job import JobPaths, status_events, training_job
from tabsmith.operators.permutation import permutation_importance as permutation
from tabsmith.operators.report import training_report as build_report
from tabsmith.plans.catalog import TABLES, facts_sql, load, query
from tabsmith.plans.preparation import (
    LINEITEM_KEYS, _dict_sql, _mode_sql,
)
from tabsmith.plans.profiling import HOLED_ORDERS_SQL, holed_lineitem, holed_orders
from tabsmith.session import scratch_path
from tabsmith.sources.packages import load_package, save_package
from tabsmith.sources.records import check_targets, complete_run, find_record, profile_record, store_record
from tabsmith.sources.tables import CSV, discover, discovered_paths, read_predictions, read_table, write_predictions
from tabsmith.streaming.scoring import score_stream as start_score_stream

_RUNS: dict[tuple[str, str, str], models.TrainingRun] = {}
#: Empty: the operator's own budget by row count. The bench sets one of seconds, which it prints.
BUDGET: tuple[float, ...] = ()


def trained(spark: SparkSession, sf_dir: str, kind: str) -> models.TrainingRun:
    """One training run per session, data set and kind; the scoring queries share it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _RUNS:
        df = holed_lineitem(spark, sf_dir)
        target = "l_returnflag" if kind == "cls" else "l_extendedprice"
        if kind == "cls":
            df = load(spark, sf_dir, "lineitem").withColumn(
                "l_discount", F.when(F.expr("l_partkey % 5 <> 0"), F.col("l_discount"))
            )
        _RUNS[key] = models.run_training(df, target, LINEITEM_KEYS, *BUDGET)
    return _RUNS[key]


@query("select_model_cls")
def select_model_cls(spark, sf_dir):
    return models.trial_table(trained(spark, sf_dir, "cls"))


@query("select_model_reg")
def select_model_reg(spark, sf_dir):
    return models.trial_table(trained(spark, sf_dir, "reg"))


@query("search_properties", """
SELECT kind AS problem_type, TRUE AS best_is_highest, TRUE AS all_have_scores, TRUE AS known_states, TRUE AS within_budget
FROM (VALUES ('classification'), ('regression')) t(kind)""")
def search_properties(spark, sf_dir):
    """What must hold of a search: the best is the first of the highest score, and search with refit keep to the budget."""
    def facts(kind):
        run = trained(spark, sf_dir, kind)
        judged = F.col("state") == "judged"
        return models.trial_table(run).groupBy("problem_type").agg(
            (F.max(F.when(F.col("is_best"), F.col("score"))) == F.max("score")).alias("best_is_highest"),
            F.every(F.when(judged, F.col("score").isNotNull()).otherwise(F.col("score").isNull())).alias("all_have_scores"),
            F.every(F.col("state").isin("judged", "deadline", "patience")).alias("known_states"),
            F.lit(run.metrics["training_time"] <= 1.1 * run.config["time_budget"]).alias("within_budget"),
        )

    return facts("cls").unionByName(facts("reg"))


@query("evaluation_properties", """
SELECT kind AS problem_type, 0::BIGINT AS differing, TRUE AS has_time, TRUE AS has_family FROM (VALUES ('classification'), ('regression')) t(kind)""")
def evaluation_properties(spark, sf_dir):
    """The metrics in the record of a run are those of its stored package over the held-out rows."""
    def facts(kind):
        run = trained(spark, sf_dir, kind)
        again = models.evaluate(run.package.pipeline.stages[-1], run.test, run.package.problem_type)
        rows = [(k, float(v), float(run.metrics[k])) for k, v in again.items()]
        table = spark.createDataFrame(rows, "name string, again double, kept double")
        return table.agg(F.count_if(F.abs(F.col("again") - F.col("kept")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("kept"))).alias("differing")).select(
            F.lit(run.package.problem_type).alias("problem_type"), "differing",
            F.lit(run.metrics["training_time"] > 0).alias("has_time"), F.lit(run.metrics["best_estimator"] == run.package.best_estimator).alias("has_family"),
        )

    return facts("cls").unionByName(facts("reg"))


@query("importance_properties", """
SELECT kind AS problem_type, TRUE AS falling, TRUE AS sums_to_one, TRUE AS all_features FROM (VALUES ('classification'), ('regression')) t(kind)""")
def importance_properties(spark, sf_dir):
    def facts(kind):
        run = trained(spark, sf_dir, kind)
        values = [v for _, v in run.package.importance]
        return (run.package.problem_type, values == sorted(values, reverse=True), abs(sum(values) - 1) < 1e-9,
                sorted(f for f, _ in run.package.importance) == sorted(run.package.feature_columns))

    return spark.createDataFrame([facts("cls"), facts("reg")], "problem_type string, falling boolean, sums_to_one boolean, all_features boolean")


@query("permutation_importance", """
SELECT feature, COUNT(*) AS rows, TRUE AS near_expectation, feature = 'unused' AS exactly_zero
FROM lineitem, (VALUES ('l_quantity'), ('unused')) f(feature) GROUP BY feature""")
def permutation_importance(spark, sf_dir):
    """A least-squares line loses 2 w^2 var(x) / var(y) of its R2 when x is exchanged; an unused feature loses nothing."""
    rows = load(spark, sf_dir, "lineitem").select("l_quantity", F.lit(1.0).alias("unused"), F.col("l_extendedprice").alias("y"))
    data = VectorAssembler(inputCols=["l_quantity", "unused"], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="y").fit(data)
    moments = rows.agg(F.var_pop("l_quantity").alias("x"), F.var_pop("y").alias("y")).first()
    expected = 2 * float(model.coefficients[0]) ** 2 * moments["x"] / moments["y"]
    found = permutation(model, data, ["l_quantity", "unused"], "y", False)
    want = F.when(F.col("feature") == "unused", 0.0).otherwise(expected)
    slack = F.greatest(F.lit(0.02), F.col("std_error") * 6)
    return found.select("feature", "rows", (F.abs(F.col("importance") - want) <= slack).alias("near_expectation"),
                        (F.col("importance") == 0).alias("exactly_zero"))


_SPLITS = ((4, (10.0, 25.0)), (5, (20000.0, 55000.5)), (6, (0.03, 0.05)))


@query("extra_split_statistics", " UNION ALL ".join(
    f"""SELECT {t}::BIGINT AS tree, {c}::BIGINT AS candidate, COUNT_IF({name} <= {marks[t]} AND l_returnflag = 'A')::DOUBLE AS n_a,
       COUNT_IF({name} <= {marks[t]} AND l_returnflag = 'N')::DOUBLE AS n_n, COUNT_IF({name} <= {marks[t]} AND l_returnflag = 'R')::DOUBLE AS n_r,
       MIN({name})::DOUBLE AS lowest, MAX({name})::DOUBLE AS highest FROM lineitem"""
    for c, ((_, marks), name) in enumerate(zip(_SPLITS, ("l_quantity", "l_extendedprice", "l_discount"))) for t in (0, 1)))
def extra_split_statistics(spark, sf_dir):
    """Class counts left of two trees' thresholds at the root, with the ranges they were drawn from."""
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    label = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").cast("double")
    state = load(spark, sf_dir, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), label.alias("y"), F.array(F.lit(0), F.lit(0)).alias("at"))
    marks = [[[m[t] for _, m in _SPLITS]] for t in (0, 1)]
    level = trees.Level(0, np.array([[[0, 1, 2]]] * 2), np.array(marks))
    ranges, left = trees.node_ranges(state, level, 3), trees.split_statistics(state, level, 3)
    rows = [(t, c, *map(float, left[t, 0][c]), float(ranges[t, 0][3 + 2 * c]), float(ranges[t, 0][4 + 2 * c])) for t in (0, 1) for c in range(3)]
    return spark.createDataFrame(rows, "tree long, candidate long, n_a double, n_n double, n_r double, lowest double, highest double")


@query("boosting_properties", "SELECT COUNT(*) AS row_count, 0::BIGINT AS bad_sum, 0::BIGINT AS bad_prediction, 0::BIGINT AS rounds_without_gain FROM orders")
def boosting_properties(spark, sf_dir):
    """Multinomial boosting over all orders: log-loss falls every round, probabilities sum to one as they are."""
    rows = load(spark, sf_dir, "orders").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 0D WHEN 'O' THEN 1D ELSE 2D END AS y", "CAST(o_totalprice AS DOUBLE) AS price",
        "CAST(unix_date(CAST(o_orderdate AS DATE)) AS DOUBLE) AS day")
    data = VectorAssembler(inputCols=["price", "day"], outputCol="features").transform(rows)
    model = trees.SoftmaxBoosting(3, rounds=3, depth=3, label="y").fit(data)
    p = vector_to_array("probability")
    flat = sum(b >= a for a, b in zip(model.losses, model.losses[1:]))
    return model.transform(data).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, v: a + v) - 1) > 1e-12).alias("bad_sum"),
        F.count_if(F.get(p, F.col("prediction").cast("int")) != F.array_max(p)).alias("bad_prediction"),
        F.lit(flat).cast("long").alias("rounds_without_gain"),
    )


@query("evaluate_cls")
def evaluate_cls(spark, sf_dir):
    run = trained(spark, sf_dir, "cls")
    scored = run.package.pipeline.stages[-1].transform(run.test)
    ints = scored.select(F.col(models.LABEL).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    return metrics.classification_metrics(ints, "y", "p")


@query("classification_metrics", """
WITH c AS (SELECT cls, SUM(a)::DOUBLE AS actual, SUM(p)::DOUBLE AS predicted, SUM(t)::DOUBLE AS correct FROM (
  SELECT quality AS cls, 1 AS a, 0 AS p, CASE WHEN quality = toxic THEN 1 ELSE 0 END AS t FROM labels
  UNION ALL SELECT toxic, 0, 1, 0 FROM labels) GROUP BY cls)
SELECT ROUND(SUM(correct) / SUM(actual), 6) AS accuracy,
       ROUND(SUM(2 * correct / (actual + predicted) * actual) / SUM(actual), 6) AS f1_score,
       ROUND(SUM(CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END * actual) / SUM(actual), 6) AS precision,
       ROUND(SUM(CASE WHEN actual > 0 THEN correct / actual ELSE 0 END * actual) / SUM(actual), 6) AS recall
FROM c""")
def classification_metrics(spark, sf_dir):
    m = metrics.classification_metrics(load(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("regression_metrics", """
SELECT ROUND(1 - AVG((l_extendedprice - l_quantity * 2100) ** 2) / VAR_POP(l_extendedprice), 6) AS r2_score,
       ROUND(SQRT(AVG((l_extendedprice - l_quantity * 2100) ** 2)), 4) AS rmse,
       ROUND(AVG(ABS(l_extendedprice - l_quantity * 2100)), 4) AS mae
FROM lineitem""")
def regression_metrics(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100).alias("p")
    )
    m = metrics.regression_metrics(df, "y", "p")
    return m.select(F.round("r2_score", 6).alias("r2_score"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    run = trained(spark, sf_dir, "reg")
    return spark.createDataFrame(run.package.importance, "feature string, importance double")


@query("training_report")
def training_report(spark, sf_dir):
    run = trained(spark, sf_dir, "reg")
    return build_report(
        spark, run.job_id, run.package.problem_type, run.metrics, run.package.importance,
        run.package.feature_columns, run.prepared.dropped, run.config,
    )


@query("report_properties", """
SELECT TRUE AS one_value_each, TRUE AS sections_complete, TRUE AS top_is_100, TRUE AS shown_falling, TRUE AS metrics_of_run, TRUE AS features_split""")
def report_properties(spark, sf_dir):
    """What must hold of the report of a finished run."""
    run = trained(spark, sf_dir, "reg")
    rows = [r.asDict() for r in training_report(spark, sf_dir).collect()]  # one record of a run
    at = lambda section, metric: {r["item"]: r["value"] for r in rows if (r["section"], r["metric"]) == (section, metric)}
    shares, metric_values = at("importance", "pct_of_max"), at("metrics", "value")
    shown = [v for _, v in run.package.importance if v in at("importance", "importance").values()]
    keys = [(r["section"], r["item"], r["metric"]) for r in rows]
    facts = (
        len(keys) == len(set(keys)),
        {"summary", "metrics", "importance", "features", "configuration"} <= {k[0] for k in keys},
        max(shares.values()) == 100.0, shown == sorted(shown, reverse=True),
        all(run.metrics[k] == metric_values[k] for k in ("r2_score", "rmse", "mae")),
        set(at("features", "used")) == set(run.package.feature_columns) and set(at("features", "excluded")) == set(run.prepared.dropped),
    )
    names = ("one_value_each", "sections_complete", "top_is_100", "shown_falling", "metrics_of_run", "features_split")
    return spark.createDataFrame([facts], ", ".join(f"{n} boolean" for n in names))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on lineitem: explore, prepare, search, evaluate, save; returns its report."""
    root = scratch_path(spark, "workspace")
    run = training_job(load(spark, sf_dir, "lineitem"), "l_returnflag", LINEITEM_KEYS, root)
    return spark.read.parquet(JobPaths(root).artifact(run.job_id, "training"))


@query("training_job")
def training_job_query(spark, sf_dir):
    """Status of a finished and of a failed job over the whole orders table, folded from their events."""
    root = scratch_path(spark, "workspace")
    df = holed_orders(spark, sf_dir)
    training_job(df, "o_orderstatus", ["o_orderkey"], root, job_id="good")
    try:
        training_job(df, "no_such_column", ["o_orderkey"], root, job_id="bad")
    except ValueError:
        pass
    return ledger.apply_status(status_events(spark, JobPaths(root)))


@query("complete_run")
def complete_run_query(spark, sf_dir):
    run = trained(spark, sf_dir, "cls")
    return complete_run(
        spark, run.job_id, run.package.target, run.package.problem_type, run.metrics,
        run.package.feature_columns, run.prepared.dropped, prepare.feature_metadata(run.prepared),
        "models/run.model", "reports/eda", "reports/training",
    )


@query("completion_properties", """
SELECT 'completed' AS status, TRUE AS counts_agree, TRUE AS metrics_exact, TRUE AS typed, TRUE AS ranges_of_numbers,
       (SELECT COUNT(DISTINCT l_linestatus) FROM lineitem) AS statuses""")
def completion_properties(spark, sf_dir):
    """The completion record holds the metrics of the run as they are and the metadata of every feature."""
    run = trained(spark, sf_dir, "cls")
    numbers = {k: float(v) for k, v in run.metrics.items() if not isinstance(v, str)}
    kept = F.map_from_arrays(F.array(*[F.lit(k) for k in numbers]), F.array(*[F.lit(v) for v in numbers.values()]))
    text = run.package.categorical_columns
    return complete_run_query(spark, sf_dir).select(
        "status",
        ((F.col("feature_count") == F.size("feature_columns")) & (F.col("dropped_count") == F.size("dropped_columns"))).alias("counts_agree"),
        F.forall(F.map_entries("metrics"), lambda e: F.element_at(kept, e["key"]) == e["value"]).alias("metrics_exact"),
        F.forall("feature_columns", lambda c: F.element_at("feature_types", c).isNotNull()).alias("typed"),
        F.forall(F.map_entries("numeric_stats"), lambda e: (e["value"]["min_value"] <= e["value"]["max_value"]) & ~e["key"].isin(text)).alias("ranges_of_numbers"),
        F.size(F.element_at("categorical_mappings", "l_linestatus")).cast("long").alias("statuses"),
    )


# --- scoring ------------------------------------------------------------------------------------

_SCORE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("score_batch")
def score_batch(spark, sf_dir):
    run = trained(spark, sf_dir, "cls")
    scored = scoring.score(holed_lineitem(spark, sf_dir).drop("l_returnflag"), run.package)
    return scored.select(*_SCORE_KEYS, "prediction", "prediction_label", "confidence")


@query("score_probability_map")
def score_probability_map(spark, sf_dir):
    run = trained(spark, sf_dir, "cls")
    scored = scoring.score(load(spark, sf_dir, "lineitem"), run.package, "fitted")
    return scoring.probability_map(scored, run.package).select(
        *_SCORE_KEYS, "prediction", "prediction_label", "confidence", "probability_map"
    )


@query("shape_prediction")
def shape_prediction(spark, sf_dir):
    cls, reg = trained(spark, sf_dir, "cls"), trained(spark, sf_dir, "reg")
    df = load(spark, sf_dir, "lineitem")
    columns = [*_SCORE_KEYS, "problem_type", "prediction", "probability", "class_probabilities"]

    def shaped(run):
        kind = run.package.problem_type
        out = scoring.shape_prediction(scoring.score(df, run.package, "fitted"), kind)
        return out.withColumns({"problem_type": F.lit(kind), "prediction": F.col("prediction").cast("double")}).select(*columns)

    return shaped(cls).unionByName(shaped(reg))


@query("shape_properties", """
SELECT kind AS problem_type, COUNT(*) AS row_count, 0::BIGINT AS bad FROM lineitem, (VALUES ('classification'), ('regression')) t(kind) GROUP BY kind""")
def shape_properties(spark, sf_dir):
    """Every answer: a number alone for a regression; else a class code with the highest of probabilities that sum to one."""
    p, classes = F.col("probability"), F.map_values("class_probabilities")
    total = F.aggregate(classes, F.lit(0.0), lambda a, x: a + x)
    code = F.element_at("class_probabilities", F.col("prediction").cast("long").cast("string"))
    good = F.when(F.col("problem_type") == "regression", p.isNull() & F.col("class_probabilities").isNull()).otherwise(
        (p == F.array_max(classes)) & (code == p) & (F.abs(total - 1) < 1e-9))
    return shape_prediction(spark, sf_dir).groupBy("problem_type").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("prediction").isNull() | ~F.coalesce(good, F.lit(False))).alias("bad"))


@query("predict_sink_roundtrip")
def predict_sink_roundtrip(spark, sf_dir):
    run = trained(spark, sf_dir, "reg")
    scored = scoring.score(holed_lineitem(spark, sf_dir), run.package, "fitted")
    path = scratch_path(spark, "predictions")
    write_predictions(scored, path, "csv")
    return read_predictions(spark, path, scored.schema, "csv")


@query("score_properties", """
SELECT COUNT(*) AS row_count, 0::BIGINT AS bad_confidence, 0::BIGINT AS bad_sum, 0::BIGINT AS bad_label, 0::BIGINT AS changed FROM lineitem""")
def score_properties(spark, sf_dir):
    """What must hold of every scored row: confidence, probabilities that sum to one, the decoded label, kept input."""
    run = trained(spark, sf_dir, "cls")
    df = holed_lineitem(spark, sf_dir).drop("l_returnflag")
    scored = scoring.score(df, run.package)
    labels = run.package.labels.select(F.col("code").alias("prediction"), F.col("label").alias("decoded"))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    checked = scored.join(F.broadcast(labels), "prediction", "left").agg(
        F.count("*").alias("row_count"),
        F.count_if(~F.col("confidence").eqNullSafe(F.array_max("probabilities")) | F.col("confidence").isNull()).alias("bad_confidence"),
        F.count_if(F.coalesce(F.abs(total - 1) > 1e-9, F.lit(True))).alias("bad_sum"),
        F.count_if(~F.col("prediction_label").eqNullSafe(F.coalesce("decoded", F.col("prediction").cast("string")))).alias("bad_label"),
    )
    changed = df.exceptAll(scored.select(*df.columns)).agg(F.count("*").alias("changed"))
    return checked.crossJoin(changed)


@query("sink_properties", "SELECT COUNT(*) AS row_count, 0::BIGINT AS lost, 0::BIGINT AS added FROM lineitem")
def sink_properties(spark, sf_dir):
    """Scored rows, probabilities included, written as CSV and read back."""
    run = trained(spark, sf_dir, "cls")
    path = scratch_path(spark, "sink")
    stored = scratch_path(spark, "scored")
    scoring.score(load(spark, sf_dir, "lineitem"), run.package, "fitted").write.parquet(stored)
    scored = spark.read.parquet(stored)
    write_predictions(scored, path, "csv")
    back = read_predictions(spark, path, scored.schema, "csv")
    lost, added = (a.exceptAll(b).agg(F.count("*").alias(n)) for a, b, n in ((scored, back, "lost"), (back, scored, "added")))
    return back.agg(F.count("*").alias("row_count")).crossJoin(lost).crossJoin(added)


@query("package_roundtrip", "SELECT COUNT(*) AS row_count, 0::BIGINT AS changed FROM lineitem")
def package_roundtrip(spark, sf_dir):
    """Rows whose prediction changed by saving and loading, out of all rows."""
    run = trained(spark, sf_dir, "cls")
    path = scratch_path(spark, "package") + ".model"
    save_package(run.package, path)
    df = load(spark, sf_dir, "lineitem").select("*")
    before = scoring.score(df, run.package, "fitted")
    again = scoring.score(
        before.withColumnRenamed("prediction", "first_prediction").drop("prediction_label", "confidence", "probabilities"),
        load_package(path), "fitted",
    )
    return again.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("prediction") != F.col("first_prediction")).alias("changed"),
    )


@query("score_stream")
def score_stream(spark, sf_dir):
    run = trained(spark, sf_dir, "cls")
    source = load(spark, sf_dir, "lineitem")
    stream = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    )
    path, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "scored-checkpoint")
    start_score_stream(stream, run.package, path, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(path).select(*_SCORE_KEYS, "prediction", "prediction_label", "confidence")


@query("stream_properties", "SELECT COUNT(*) AS row_count, 0::BIGINT AS lost, 0::BIGINT AS added FROM lineitem")
def stream_properties(spark, sf_dir):
    """A stream is scored as a batch with fitted imputation is."""
    run = trained(spark, sf_dir, "cls")
    columns = [*_SCORE_KEYS, "prediction", "prediction_label", "confidence"]
    streamed = score_stream(spark, sf_dir)
    batch = scoring.score(load(spark, sf_dir, "lineitem"), run.package, "fitted").select(*columns)
    lost, added = (a.exceptAll(b).agg(F.count("*").alias(n)) for a, b, n in ((batch, streamed, "lost"), (streamed, batch, "added")))
    return streamed.agg(F.count("*").alias("row_count")).crossJoin(lost).crossJoin(added)


# --- requests and model information -------------------------------------------------------------

_REQUEST_VALUE = """CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END"""
_REQUEST_TYPE = "CASE WHEN event_id % 8 = 0 THEN 'refund' ELSE event_type END"


@query("prepare_request", f"""
WITH d AS ({_dict_sql(['event_type'], 'events')}),
r AS (SELECT event_id, {_REQUEST_TYPE} AS t, {_REQUEST_VALUE} AS v, event_id % 9 <> 0 AS has_v, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CAST(k AS DOUBLE) AS k, COALESCE(d.code, -1)::DOUBLE AS event_type, TRY_CAST(v AS DOUBLE) AS value,
       CASE WHEN NOT has_v THEN 'Missing required feature: value'
            WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 'Cannot convert ''' || v || ''' to number for feature ''value''' ELSE '' END AS errors
FROM r LEFT JOIN d ON d.value = r.t""")
def prepare_request(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    codes = prepare.dictionary(events, ["event_type"])
    given = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("event_type"), F.expr(_REQUEST_TYPE)),
        F.when(F.expr("event_id % 9 <> 0"), F.create_map(F.lit("value"), F.expr(_REQUEST_VALUE))).otherwise(
            F.create_map().cast("map<string,string>")),
    )
    out = scoring.prepare_request(
        events.select("event_id", given.alias("features")), "features",
        ["k", "event_type", "value"], ["event_type"], codes,
    )
    return out.withColumn("errors", F.array_join("errors", "; "))


@query("prediction_info", f"""
WITH t AS ({HOLED_ORDERS_SQL}),
f AS (SELECT COALESCE(o_orderpriority, {_mode_sql('o_orderpriority', 't')}) AS o_orderpriority FROM t),
p AS (SELECT DISTINCT o_orderpriority AS v FROM f)
SELECT 0 AS position, 'o_custkey' AS feature, 'numeric' AS feature_type, 'number' AS input_type, NULL::VARCHAR AS allowed_values, '0' AS example
UNION ALL SELECT 1, 'o_totalprice', 'numeric', 'number', NULL, '0'
UNION ALL SELECT 2, 'o_orderdate', 'numeric', 'number', NULL, '0'
UNION ALL SELECT 3, 'o_orderpriority', 'categorical', 'select', string_agg(v, ';' ORDER BY v), MIN(v) FROM p""")
def prediction_info(spark, sf_dir):
    made = prepare.preprocess(holed_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"])
    info = scoring.prediction_info(prepare.feature_metadata(made))
    return info.withColumn("allowed_values", F.array_join("allowed_values", ";"))


# --- sources ------------------------------------------------------------------------------------


def _csv_of(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.options(**CSV).csv(path)
    return path


@query("csv_scan", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM ({HOLED_ORDERS_SQL})""")
def csv_scan(spark, sf_dir):
    """Whole orders table as CSV with missing-value tokens, read back with guessed types."""
    df = holed_orders(spark, sf_dir).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    tokens = df.withColumns({
        "o_totalprice": F.coalesce(F.col("o_totalprice").cast("string"), F.when(F.expr("o_orderkey % 2 = 0"), "NA").otherwise("nan")),
        "o_orderpriority": F.coalesce("o_orderpriority", F.lit("N/A")),
    })
    return read_table(spark, _csv_of(tokens))


@query("csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, sf_dir):
    """Texts with quotes, commas and line breaks as CSV and back."""
    return read_table(spark, _csv_of(load(spark, sf_dir, "documents")))


@query("csv_codes", """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'F' ELSE 'D' END AS code,
       CASE WHEN o_orderkey % 2 = 0 THEN '1e3' ELSE '-.5' END::DOUBLE AS number, o_orderkey AS whole FROM orders""")
def csv_codes(spark, sf_dir):
    """Codes that end in a type letter stay text; other ways to write numbers are numbers."""
    key = F.col("o_orderkey").cast("string")
    letter = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'F' ELSE 'D' END")
    return read_table(spark, _csv_of(load(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(key, letter).alias("code"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '1e3' ELSE '-.5' END").alias("number"), key.alias("whole"),
    )))


@query("discover_files")
def discover_files(spark, sf_dir):
    path = _csv_of(load(spark, sf_dir, "orders"))
    return discover(spark, path).select("path", "length")


@query("discovery_properties", """
SELECT 0::BIGINT AS undiscovered, 0::BIGINT AS foreign_files, TRUE AS lengths_known, COUNT(*) AS row_count FROM orders""")
def discovery_properties(spark, sf_dir):
    """Loads in nested folders beside files of another kind: every CSV file is found, none else, and together they are the table."""
    root = scratch_path(spark, "loads")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.options(**CSV).csv(f"{root}/{'deep/' * part}load={part}")
    orders.limit(1).write.json(f"{root}/other")
    found = discover(spark, root)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    csv = every.where(F.col("path").endswith(".csv"))
    lost = csv.join(found, "path", "left_anti").agg(F.count("*").alias("undiscovered"))
    extra = found.agg(F.count_if(~F.col("path").endswith(".csv")).alias("foreign_files"), F.every(F.col("length") > 0).alias("lengths_known"))
    rows = spark.read.options(**CSV).csv(discovered_paths(spark, root)).agg(F.count("*").alias("row_count"))
    return lost.crossJoin(extra).crossJoin(rows)


@query("dataset_record", f"""
WITH facts AS ({facts_sql('orders', TABLES['orders'])})
SELECT 'orders' AS dataset_id, 'orders.parquet' AS filename, row_count, position, column_name, column_type,
       distinct_count AS unique_count, row_count - non_null AS missing,
       ROUND((row_count - non_null)::DOUBLE / row_count * 100, 2) AS missing_pct FROM facts""")
def dataset_record(spark, sf_dir):
    """Two records stored, one read back by its id and laid out by column."""
    path = scratch_path(spark, "datasets")
    for table in ("orders", "part"):
        store_record(profile_record(load(spark, sf_dir, table), table, f"{table}.parquet"), path)
    record = find_record(spark, path, "orders")
    flat = record.select("dataset_id", "filename", "row_count", "column_types", "column_stats",
                         F.posexplode("columns").alias("position", "column_name"))
    stats = F.element_at("column_stats", F.col("column_name"))
    return flat.select(
        "dataset_id", "filename", "row_count", "position", "column_name",
        F.element_at("column_types", F.col("column_name")).alias("column_type"),
        stats["unique"].alias("unique_count"), stats["missing"].alias("missing"), stats["missing_pct"].alias("missing_pct"),
    )


_ASKED = (*TABLES["orders"], "no_such_column", "O_ORDERKEY", "")


@query("target_exists", f"""
SELECT asked AS target, (asked IN ({", ".join(f"'{c}'" for c in TABLES["orders"])})) AS accepted, (SELECT COUNT(*) FROM orders) AS row_count
FROM (VALUES {", ".join(f"('{c}')" for c in _ASKED)}) t(asked)""")
def target_exists(spark, sf_dir):
    """Targets asked for, checked against the column list of the stored record: accepted as they are written there."""
    path = scratch_path(spark, "datasets")
    store_record(profile_record(load(spark, sf_dir, "orders"), "orders", "orders.parquet"), path)
    asked = spark.createDataFrame([("orders", c) for c in _ASKED], "dataset_id string, target string")
    return check_targets(asked, spark.read.parquet(path)).select("target", "accepted", "row_count")
