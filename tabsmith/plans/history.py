"""Run-history queries over a ledger derived from orders and events.

The ledger view is one SQL text that both engines run: Spark receives the table as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions import scalars
from tabsmith.operators import ledger
from tabsmith.operators.detect import collect_rules
from tabsmith.operators.facts import union_all
from tabsmith.operators.report import facts_table
from tabsmith.plans.catalog import TABLES, facts_sql, load, query
from tabsmith.session import scratch_path
from tabsmith.streaming import stateful
from tabsmith.streaming.runs import RunFollower

RUNS_SQL = """
SELECT job_id, dataset_id, user_id, created_at, status, target_column, problem_type, dataset_name, tags, notes,
       CASE WHEN status = 'completed' AND problem_type = 'classification' THEN score END AS accuracy,
       CASE WHEN status = 'completed' AND problem_type = 'classification' THEN score * 0.99 END AS f1_score,
       CASE WHEN status = 'completed' AND problem_type = 'classification' THEN score * 0.98 END AS `precision`,
       CASE WHEN status = 'completed' AND problem_type = 'classification' THEN score * 0.97 END AS recall,
       CASE WHEN status = 'completed' AND problem_type = 'regression' THEN score END AS r2_score,
       CASE WHEN status = 'completed' AND problem_type = 'regression' THEN (1 - score) * 10 END AS rmse,
       CASE WHEN status = 'completed' AND problem_type = 'regression' THEN (1 - score) * 8 END AS mae,
       CASE WHEN status = 'completed' THEN CAST(run_no % 600 AS DOUBLE) END AS training_time,
       CASE WHEN status = 'completed' THEN CASE WHEN run_no % 3 = 0 THEN 'gbt' WHEN run_no % 3 = 1 THEN 'rf' ELSE '' END END AS best_estimator,
       CASE WHEN status = 'completed' AND run_no % 4 = 0 THEN TRUE WHEN run_no % 4 = 1 THEN FALSE END AS deployed,
       CASE WHEN status = 'completed' AND run_no % 4 = 0 THEN created_at END AS deployed_at,
       CASE WHEN run_no % 3 <> 2 THEN 'models/' || job_id || '.model' END AS model_path,
       CASE WHEN run_no % 6 <> 5 AND status = 'completed' THEN 'portable/' || job_id END AS portable_path,
       CASE WHEN run_no % 5 = 0 THEN NULL ELSE 'eda/' || job_id END AS eda_report_path,
       CASE WHEN run_no % 5 = 0 THEN 'report/' || job_id END AS report_path,
       CASE WHEN run_no % 7 <> 0 THEN 'training/' || job_id END AS training_report_path,
       CASE WHEN run_no % 10 <> 0 THEN split('a,b,c', ',') END AS feature_columns
FROM (
  SELECT o_orderkey AS run_no, CAST(o_orderkey AS STRING) AS job_id, CAST(o_custkey AS STRING) AS dataset_id,
         CAST(o_custkey % 40 AS STRING) AS user_id, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status,
         'target' AS target_column,
         CASE WHEN o_orderkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type,
         'orders' AS dataset_name,
         CASE WHEN o_orderkey % 9 <> 0 THEN split(replace(lower(o_orderpriority), '-', ' '), ' ') END AS tags,
         CASE WHEN o_orderkey % 8 = 0 THEN 'note ' || CAST(o_orderkey AS STRING) END AS notes,
         CASE WHEN o_orderkey % 50 = 0 THEN CAST(0.0 AS DOUBLE) ELSE o_totalprice / 500000.0 END AS score
  FROM {orders})"""

RUNS_DUCK = RUNS_SQL.replace("{orders}", "orders").replace("`precision`", '"precision"').replace(
    "500000.0", "500000.0::DOUBLE").replace("0.99", "0.99::DOUBLE").replace("0.98", "0.98::DOUBLE").replace("0.97", "0.97::DOUBLE")
WITH_RUNS = f"WITH runs AS ({RUNS_DUCK})"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # literals such as 0.99 are decimals in Spark SQL; the ledger keeps doubles
    df = spark.sql(RUNS_SQL.replace("500000.0", "500000.0D").replace("0.99", "0.99D").replace("0.98", "0.98D").replace("0.97", "0.97D"),
                   orders=load(spark, sf_dir, "orders"))
    return df


def text_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def duck_time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


EVENTS_SQL = """
SELECT CAST(user_id AS STRING) AS job_id, ts, event_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed at ' || CAST(event_id AS STRING) END AS message
FROM {events}"""
WITH_EVENTS = f"WITH ev AS ({EVENTS_SQL.replace('{events}', 'events')})"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_SQL, events=load(spark, sf_dir, "events"))


# --- counts, listing, filters -------------------------------------------------------------------


@query("status_counts", WITH_RUNS + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'completed') AS completed,
       COUNT(*) FILTER (WHERE status = 'running') AS running, COUNT(*) FILTER (WHERE status = 'failed') AS failed FROM runs""")
def status_counts(spark, sf_dir):
    return ledger.status_counts(runs(spark, sf_dir))


_PAGE = f"SELECT job_id, user_id, status, {duck_time('created_at')}"


@query("list_runs_page1", WITH_RUNS + f"""
{_PAGE} FROM (SELECT * FROM runs ORDER BY created_at DESC, job_id DESC LIMIT 20)""")
def list_runs_page1(spark, sf_dir):
    return ledger.list_runs(runs(spark, sf_dir)).select("job_id", "user_id", "status", text_time("created_at"))


@query("list_runs_page2", WITH_RUNS + f"""
{_PAGE} FROM (SELECT * FROM runs ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 20)""")
def list_runs_page2(spark, sf_dir):
    table = runs(spark, sf_dir)
    last = ledger.list_runs(table).collect()[-1]
    page = ledger.list_runs(table, after=(last["created_at"], last["job_id"]))
    return page.select("job_id", "user_id", "status", text_time("created_at"))


@query("runs_for_user", WITH_RUNS + f"""
SELECT job_id, dataset_id, status, target_column, problem_type, dataset_name, {duck_time('created_at')} FROM runs WHERE user_id = '7'""")
def runs_for_user(spark, sf_dir):
    return ledger.runs_for_user(runs(spark, sf_dir), "7").withColumn("created_at", text_time("created_at"))


@query("filter_runs", WITH_RUNS + """
SELECT job_id, status, array_to_string(tags, ',') AS tags FROM runs WHERE status = 'completed' AND list_contains(tags, 'urgent')""")
def filter_runs(spark, sf_dir):
    picked = ledger.filter_runs(runs(spark, sf_dir), "completed", "urgent")
    return picked.select("job_id", "status", F.array_join("tags", ",").alias("tags"))


@query("all_tags", WITH_RUNS + " SELECT DISTINCT UNNEST(tags) AS tag FROM runs")
def all_tags(spark, sf_dir):
    return ledger.all_tags(runs(spark, sf_dir))


@query("run_summary", WITH_RUNS + """
SELECT job_id, dataset_id, status, problem_type,
       NULLIF(CASE WHEN problem_type = 'classification' THEN accuracy ELSE r2_score END, 0.0) AS primary_metric,
       NULLIF(training_time, 0.0) AS training_time, NULLIF(best_estimator, '') AS best_estimator FROM runs""")
def run_summary(spark, sf_dir):
    return ledger.run_summary(runs(spark, sf_dir))


@query("run_detail", WITH_RUNS + """
SELECT job_id, dataset_id, status, target_column, problem_type, COALESCE(deployed, FALSE) AS deployed,
       CASE WHEN status = 'completed' THEN model_path END AS model_location,
       CASE WHEN status = 'completed' THEN portable_path END AS portable_location,
       CASE WHEN status = 'completed' THEN COALESCE(eda_report_path, report_path) END AS eda_report_location,
       CASE WHEN status = 'completed' THEN training_report_path END AS training_report_location FROM runs""")
def run_detail(spark, sf_dir):
    return ledger.run_detail(runs(spark, sf_dir))


@query("scorable_runs", WITH_RUNS + """
SELECT job_id, reason IS NULL AS scorable, reason FROM (SELECT job_id,
  CASE WHEN NOT COALESCE(deployed, FALSE) THEN 'not deployed' WHEN portable_path IS NULL THEN 'no portable model'
       WHEN COALESCE(len(feature_columns), 0) = 0 THEN 'no feature columns' END AS reason FROM runs)""")
def scorable_runs(spark, sf_dir):
    return ledger.scorable(runs(spark, sf_dir))


# --- joins --------------------------------------------------------------------------------------


@query("run_dataset_join", WITH_RUNS + """
SELECT job_id, dataset_id, c_name AS filename, c_nationkey AS owner FROM runs LEFT JOIN customer ON dataset_id = CAST(c_custkey AS VARCHAR)""")
def run_dataset_join(spark, sf_dir):
    datasets = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_name").alias("filename"), F.col("c_nationkey").alias("owner")
    )
    return ledger.with_dataset(runs(spark, sf_dir), datasets).select("job_id", "dataset_id", "filename", "owner")


_CHOSEN = "SELECT DISTINCT CAST(l_orderkey AS STRING) AS job_id FROM lineitem WHERE l_quantity >= 49"


def _chosen(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return df.select(F.col("l_orderkey").cast("string").alias("job_id")).distinct()


@query("select_runs_semi", WITH_RUNS + f"""
SELECT job_id, problem_type FROM runs WHERE status = 'completed' AND job_id IN ({_CHOSEN})""")
def select_runs_semi(spark, sf_dir):
    return ledger.select_runs(runs(spark, sf_dir), _chosen(spark, sf_dir)).select("job_id", "problem_type")


@query("purge_runs_anti", WITH_RUNS + f"""
SELECT job_id, dataset_id, job_id IN ({_CHOSEN}) AS removed,
       CASE WHEN job_id IN ({_CHOSEN}) THEN (model_path IS NOT NULL)::INTEGER + (portable_path IS NOT NULL)::INTEGER
         + (COALESCE(eda_report_path, report_path) IS NOT NULL)::INTEGER + (training_report_path IS NOT NULL)::INTEGER ELSE 0 END AS artifacts FROM runs""")
def purge_runs_anti(spark, sf_dir):
    kept, removed = ledger.purge_runs(runs(spark, sf_dir), _chosen(spark, sf_dir))
    return kept.select("job_id", "dataset_id", F.lit(False).alias("removed"), F.lit(0).alias("artifacts")).unionByName(
        removed.select("job_id", "dataset_id", F.lit(True).alias("removed"), "artifacts")
    )


@query("compare_runs", WITH_RUNS + """,
newest AS (SELECT * FROM runs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 6),
lead AS (SELECT problem_type FROM newest ORDER BY created_at DESC, job_id DESC LIMIT 1),
long AS (
  SELECT 'classification' AS kind, 'accuracy' AS metric, job_id, accuracy AS value FROM newest
  UNION ALL SELECT 'classification', 'f1_score', job_id, f1_score FROM newest
  UNION ALL SELECT 'classification', 'precision', job_id, "precision" FROM newest
  UNION ALL SELECT 'classification', 'recall', job_id, recall FROM newest
  UNION ALL SELECT 'regression', 'r2_score', job_id, r2_score FROM newest
  UNION ALL SELECT 'regression', 'rmse', job_id, rmse FROM newest
  UNION ALL SELECT 'regression', 'mae', job_id, mae FROM newest)
SELECT metric, job_id, value, COALESCE(value = CASE WHEN metric IN ('rmse', 'mae') THEN MIN(value) OVER (PARTITION BY metric)
       ELSE MAX(value) OVER (PARTITION BY metric) END, FALSE) AS is_best
FROM long JOIN lead ON kind = problem_type""")
def compare_runs(spark, sf_dir):
    table = runs(spark, sf_dir)
    newest = ledger.list_runs(ledger.filter_runs(table, "completed"), limit=6).select("job_id").collect()
    return ledger.compare_runs(table, [r["job_id"] for r in newest])


# --- writes -------------------------------------------------------------------------------------


_DATA = ("orders", "part", "customer")


@query("create_runs", f"""
WITH facts AS ({' UNION ALL '.join(facts_sql(t, TABLES[t], t) for t in _DATA)}),
req AS (SELECT table_name AS dataset_id, column_name AS target_column FROM facts
        UNION ALL SELECT DISTINCT table_name, 'no_such_column' FROM facts
        UNION ALL SELECT DISTINCT 'lost_' || table_name, column_name FROM facts),
j AS (SELECT req.*, row_count, CASE WHEN dataset_id IN ('orders', 'part', 'customer') THEN dataset_id || '.parquet' END AS dataset_name,
       CASE WHEN f.column_name IS NULL THEN NULL WHEN column_type <> 'numeric' THEN 'classification'
            WHEN distinct_count > 0 AND (distinct_count < 20 OR distinct_count::DOUBLE / row_count < 0.05) THEN 'classification' ELSE 'regression' END AS problem_type
      FROM req LEFT JOIN facts f ON f.table_name = dataset_id AND f.column_name = target_column),
e AS (SELECT *, CASE WHEN dataset_name IS NULL THEN 'Dataset not found' WHEN problem_type IS NULL THEN 'Target column not found in dataset' END AS error FROM j)
SELECT dataset_id, target_column, dataset_name, 'default' AS user_id, CASE WHEN error IS NULL THEN 'pending' END AS status, problem_type,
       CASE WHEN error IS NULL THEN CASE WHEN row_count < 1000 THEN 120 WHEN row_count < 10000 THEN 300 WHEN row_count < 50000 THEN 600 ELSE 1200 END END AS estimated_time,
       error FROM e""")
def create_runs(spark, sf_dir):
    # one row per column, used three times below
    facts = union_all([
        facts_table(spark, collect_rules(load(spark, sf_dir, t))).withColumn("dataset_id", F.lit(t)) for t in _DATA
    ])
    names = facts.select("dataset_id").distinct()
    asked = facts.select("dataset_id", F.col("column_name").alias("target_column"))
    requests = asked.unionByName(names.withColumn("target_column", F.lit("no_such_column"))).unionByName(
        asked.withColumn("dataset_id", F.concat(F.lit("lost_"), "dataset_id"))
    )
    datasets = names.withColumn("dataset_name", F.concat("dataset_id", F.lit(".parquet")))
    return ledger.create_runs(requests, datasets, facts).drop("job_id", "created_at", "updated_at")


@query("latest_state", WITH_EVENTS + f"""
SELECT job_id, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status,
       arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS error_message,
       strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM ev GROUP BY job_id""")
def latest_state(spark, sf_dir):
    return ledger.latest_state(run_events(spark, sf_dir)).withColumn("updated_at", text_time("updated_at"))


@query("apply_status", WITH_EVENTS + """
SELECT job_id, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status,
       strftime(MAX(ts) FILTER (WHERE status = 'running'), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(MAX(ts) FILTER (WHERE status IN ('completed', 'failed')), '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
       arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS error_message,
       strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM ev GROUP BY job_id""")
def apply_status(spark, sf_dir):
    out = ledger.apply_status(run_events(spark, sf_dir))
    return out.withColumns({c: text_time(c) for c in ("started_at", "completed_at", "updated_at")})


_FOLLOWED_SQL = WITH_EVENTS + """,
f AS (SELECT job_id, COALESCE(arg_min(status, (ts, event_id)) FILTER (WHERE status IN ('completed', 'failed')), arg_max(status, (ts, event_id))) AS status,
       COALESCE(MIN(ts) FILTER (WHERE status IN ('completed', 'failed')), MAX(ts)) AS ts,
       BOOL_OR(status IN ('completed', 'failed')) AS finished FROM ev WHERE status IS NOT NULL GROUP BY job_id)
SELECT job_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, finished FROM f"""


@query("follow_runs", _FOLLOWED_SQL)
def follow_runs(spark, sf_dir):
    source = load(spark, sf_dir, "events")
    raw = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    follower = RunFollower(scratch_path(spark, "followed"))
    # the view's SQL reads a table parameter, which a stream can be as well
    stream = spark.sql(EVENTS_SQL, events=raw)
    job = follower.start(stream, scratch_path(spark, "followed-checkpoint"), once=True)
    job.awaitTermination()
    last = job.lastProgress.batchId if job.lastProgress else 0
    return follower.result(spark, last).withColumn("ts", text_time("ts"))


@query("follow_runs_stateful", _FOLLOWED_SQL)
def follow_runs_stateful(spark, sf_dir):
    source = load(spark, sf_dir, "events")
    raw = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ends, checkpoint = scratch_path(spark, "ended"), scratch_path(spark, "ended-checkpoint")
    followed = stateful.follow(spark.sql(EVENTS_SQL, events=raw))
    stateful.start(followed, ends, checkpoint, once=True).awaitTermination()
    out = stateful.ended_runs(spark, ends).unionByName(stateful.open_runs(spark, checkpoint))
    return out.select("job_id", "status", text_time("ts").alias("ts"), "finished")


_NEW_TAGS = """CASE WHEN run_no % 13 = 0 THEN split('1,2,3,4,5,6,7,8,9,10,11', ',') WHEN run_no % 17 = 0 THEN split('ok, ', ',')
     WHEN run_no % 19 = 0 THEN split(repeat('x', 51), ',') WHEN run_no % 2 = 0 THEN split('baseline,v2', ',') END"""
_NEW_NOTES = """CASE WHEN run_no % 23 = 0 THEN repeat('n', 1001) WHEN run_no % 8 = 0 AND run_no % 3 = 0 THEN '  '
     WHEN run_no % 7 = 0 THEN 'seen again' END"""


@query("update_meta", WITH_RUNS + f""",
u AS (SELECT CAST(run_no AS STRING) AS job_id, {_NEW_TAGS} AS new_tags, {_NEW_NOTES} AS new_notes
      FROM (SELECT o_orderkey AS run_no FROM orders WHERE o_orderkey % 5 <> 0)),
e AS (SELECT runs.job_id, tags, notes, new_tags, new_notes,
   CASE WHEN len(new_tags) > 10 THEN 'Maximum 10 tags allowed per job'
        WHEN len(list_filter(new_tags, lambda t: trim(t) = '')) > 0 THEN 'Tags cannot be empty or whitespace'
        WHEN len(list_filter(new_tags, lambda t: length(t) > 50)) > 0 THEN 'Each tag must be 50 characters or less'
        WHEN length(new_notes) > 1000 THEN 'Notes must be 1000 characters or less' END AS error
   FROM runs LEFT JOIN u USING (job_id))
SELECT job_id, array_to_string(CASE WHEN error IS NULL AND new_tags IS NOT NULL THEN new_tags ELSE tags END, ',') AS tags,
       CASE WHEN error IS NULL AND trim(new_notes) = '' THEN NULL WHEN error IS NULL AND new_notes IS NOT NULL THEN new_notes ELSE notes END AS notes,
       error FROM e""")
def update_meta(spark, sf_dir):
    updates = load(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").withColumnRenamed("o_orderkey", "run_no").selectExpr(
        "CAST(run_no AS STRING) AS job_id", f"{_NEW_TAGS} AS new_tags", f"{_NEW_NOTES} AS new_notes"
    )
    out = ledger.update_meta(runs(spark, sf_dir), updates)
    return out.select("job_id", F.array_join("tags", ",").alias("tags"), "notes", "error")


@query("set_deployed", WITH_RUNS + """,
q AS (SELECT CAST(o_orderkey AS STRING) AS job_id, o_orderkey % 6 <> 0 AS deploy, o_orderdate + INTERVAL 1 DAY AS requested_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0),
r AS (SELECT *, CASE WHEN deploy IS NOT NULL AND status <> 'completed' THEN 'Cannot deploy job with status ''' || status || ''''
        WHEN deploy AND portable_path IS NULL THEN 'No portable model available for this job' END AS reason FROM runs LEFT JOIN q USING (job_id)),
d AS (SELECT job_id, reason, deploy IS NOT NULL AND reason IS NULL AS change, deploy, requested_at, deployed, deployed_at FROM r)
SELECT job_id, CASE WHEN change THEN deploy ELSE COALESCE(deployed, FALSE) END AS deployed,
       strftime(CASE WHEN change AND deploy THEN requested_at WHEN change THEN NULL ELSE deployed_at END, '%Y-%m-%d %H:%M:%S.%f') AS deployed_at, reason FROM d""")
def set_deployed(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0").selectExpr(
        "CAST(o_orderkey AS STRING) AS job_id", "o_orderkey % 6 <> 0 AS deploy", "o_orderdate + INTERVAL 1 DAY AS requested_at"
    )
    out = ledger.set_deployed(runs(spark, sf_dir), requests)
    return out.select("job_id", "deployed", text_time("deployed_at"), "reason")


# --- small rankings and scalars -----------------------------------------------------------------


@query("top_importance", """
WITH imp AS (SELECT p_name AS feature, SUM(l_extendedprice) / (SELECT SUM(l_extendedprice) FROM lineitem) AS importance
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
top AS (SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 15)
SELECT feature, ROUND(importance, 8) AS importance, ROUND(importance / (SELECT MAX(importance) FROM top) * 100, 4) AS pct_of_max,
       FLOOR(importance / (SELECT MAX(importance) FROM top) * 30)::INTEGER AS bar_length FROM top""")
def top_importance(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    total = items.agg(F.sum("l_extendedprice").alias("s")).scalar()
    # summed per part first: one row per part and task reaches the join, whatever the part's share
    per_part = items.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"))
    imp = per_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("feature")).agg(
        F.sum("s").alias("s")).select("feature", (F.col("s") / total).alias("importance"))
    top = ledger.top_importance(imp, 15)
    return top.select("feature", F.round("importance", 8).alias("importance"), F.round("pct_of_max", 4).alias("pct_of_max"), "bar_length")


@query("rank_probabilities", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq FROM embeddings),
p AS (SELECT vec_id, UNNEST(sq) AS v, UNNEST(range(len(sq))) AS code FROM s),
n AS (SELECT vec_id, code, v, SUM(v) OVER (PARTITION BY vec_id) AS total FROM p)
SELECT vec_id, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY v DESC, code)::INTEGER AS rank, 'class_' || code AS class, ROUND(v / total, 6) AS probability FROM n""")
def rank_probabilities(spark, sf_dir):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    df = load(spark, sf_dir, "embeddings").select("vec_id", squares.alias("sq")).select(
        "vec_id", F.transform("sq", lambda v: v / F.aggregate("sq", F.lit(0.0), lambda a, x: a + x)).alias("probabilities")
    )
    out = ledger.rank_probabilities(df, "vec_id", "probabilities")
    return out.withColumn("probability", F.round("probability", 6))


@query("metric_band", WITH_RUNS + """
SELECT job_id, CASE WHEN accuracy >= 0.9 THEN 'high' WHEN accuracy >= 0.7 THEN 'medium' WHEN accuracy IS NOT NULL THEN 'low' END AS band,
       CASE WHEN accuracy >= 0.9 THEN 'excellent' WHEN accuracy >= 0.7 THEN 'good' ELSE 'moderate' END AS accuracy_band,
       CASE WHEN r2_score >= 0.8 THEN 'excellent' WHEN r2_score >= 0.5 THEN 'moderate' END AS r2_band FROM runs""")
def metric_band(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "job_id", scalars.metric_band(F.col("accuracy")).alias("band"),
        scalars.accuracy_band(F.col("accuracy")).alias("accuracy_band"), scalars.r2_band(F.col("r2_score")).alias("r2_band"),
    )


@query("elapsed_seconds", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS written,
       CASE WHEN event_id % 50 <> 0 THEN (event_id % 90000)::BIGINT END AS seconds FROM events""")
def elapsed_seconds(spark, sf_dir):
    ev = load(spark, sf_dir, "events").withColumn("utc", F.col("ts").cast("timestamp"))
    written = scalars.iso_utc(F.col("utc"))
    # the same instant without zone, with Z, and with an offset; the end lies before the start for some
    plain = F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.expr("event_id % 3 = 0"), plain).when(F.expr("event_id % 3 = 1"), F.concat(plain, F.lit("Z"))).otherwise(written)
    end = F.expr("utc + make_dt_interval(0, 0, 0, CAST(event_id % 90000 AS DECIMAL(18,6)))")
    early = F.expr("utc - INTERVAL 5 SECOND")
    return ev.select(
        "event_id", written.alias("written"),
        scalars.elapsed_s(scalars.parse_utc(text), F.when(F.expr("event_id % 50 <> 0"), end).otherwise(early)).alias("seconds"),
    )


@query("string_scalars", """
SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, lower(p_brand) AS lowered, suffix(p_type, 'Y') AS ends_y,
       substring(p_name, 1, 8) AS cut8, upper(substring(lower(p_type), 1, 1)) || substring(lower(p_type), 2) AS capital,
       regexp_matches(p_brand, '#1[0-9]$') AS matched FROM part""")
def string_scalars(spark, sf_dir):
    low = F.lower("p_type")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.lower("p_brand").alias("lowered"),
        F.col("p_type").endswith("Y").alias("ends_y"), F.substring("p_name", 1, 8).alias("cut8"),
        F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1000000)).alias("capital"),
        F.col("p_brand").rlike("#1[0-9]$").alias("matched"),
    )


@query("numeric_scalars", """
SELECT o_orderkey, ROUND(o_totalprice / 7, 2) AS rounded, FLOOR(o_totalprice)::BIGINT AS floored,
       ABS(o_totalprice - 250000) AS distance, LEAST(o_totalprice / 4000, 100.0) AS bar,
       FLOOR((o_custkey + o_totalprice) / 2 + 0.5)::BIGINT AS placeholder FROM orders""")
def numeric_scalars(spark, sf_dir):
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(price / 7, 2).alias("rounded"), F.floor(price).alias("floored"),
        F.abs(price - 250000).alias("distance"), scalars.bar_width(price / 4000).alias("bar"),
        scalars.placeholder(F.col("o_custkey"), price).alias("placeholder"),
    )


@query("decimal_roundtrip", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 7 AS seventh, l_discount / 1e12::DOUBLE AS tiny,
       l_tax * 1e30::DOUBLE AS huge, l_extendedprice * 2 AS twice FROM lineitem""")
def decimal_roundtrip(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 7).alias("seventh"),
        (F.col("l_discount") / F.lit(1e12)).alias("tiny"), (F.col("l_tax") * F.lit(1e30)).alias("huge"),
        F.transform(F.array("l_extendedprice"), lambda v: v * 2).alias("nested"),
    )
    back = scalars.to_double(scalars.to_decimal(df), df.schema)
    return back.withColumn("twice", F.element_at("nested", 1)).drop("nested")


_K_TEXT = "CASE WHEN event_id % 5 = 0 THEN {k} || '.5' WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN ' 1e3 ' ELSE {k} END"


@query("coerce_features", f"""
WITH t AS (SELECT event_id, {_K_TEXT.format(k="json_extract_string(props, '$.k')")} AS k FROM events),
c AS (SELECT *, lower(trim(k)) <> '' AND (contains(k, '.') OR contains(lower(k), 'e') OR TRY_CAST(trim(k) AS DOUBLE) IS NULL) AS bad FROM t)
SELECT event_id, k, k AS free, CASE WHEN NOT bad THEN TRY_CAST(trim(k) AS DOUBLE) END AS k_number,
       CASE WHEN bad THEN 'Invalid integer value for feature "k": "' || k || '"' END AS k_error,
       TRY_CAST(trim(k) AS DOUBLE) AS free_number, NULL::VARCHAR AS free_error FROM c""")
def coerce_features(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", F.element_at(scalars.parse_request(F.col("props")), F.lit("k")).alias("raw"))
    text = F.expr(_K_TEXT.format(k="raw"))
    return scalars.coerce_features(df.select("event_id", text.alias("k"), text.alias("free")), ["k", "free"], ["k"])


@query("parse_request", """
SELECT event_id, len(json_keys(props))::INTEGER AS features, json_extract_string(props, '$.k') AS k,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AS numeric FROM events""")
def parse_request(spark, sf_dir):
    given = scalars.parse_request(F.col("props"))
    k = F.element_at(given, F.lit("k"))
    return load(spark, sf_dir, "events").select(
        "event_id", F.size(given).alias("features"), k.alias("k"), scalars.to_number(k).isNotNull().alias("numeric")
    )


_MIXED_PARTS = (
    "CASE event_id % 5 WHEN 0 THEN '1.5' WHEN 1 THEN '\"12\"' WHEN 2 THEN 'null' WHEN 3 THEN '{\"x\":1}' ELSE '-7' END",
    "CASE WHEN event_id % 11 = 0 THEN '[1' ELSE '' END",
)
_MIXED = (f"CONCAT('{{\"id\": ', CAST(event_id AS STRING), ', \"type\": \"', event_type, '\", \"mixed\": ', "
          f"{_MIXED_PARTS[0]}, {_MIXED_PARTS[1]}, '}}')")


@query("typed_request", f"""
WITH t AS (SELECT event_id, {_MIXED.replace('AS STRING', 'AS VARCHAR')} AS j FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM t),
k AS (SELECT event_id, j, json_type(j, '$.mixed') AS kind FROM v)
SELECT event_id, CASE WHEN j IS NOT NULL THEN 'int' END AS id_kind, (j->>'$.id')::DOUBLE AS id_number, j->>'$.type' AS type_text,
       CASE kind WHEN 'DOUBLE' THEN 'float' WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'string' END AS mixed_kind,
       CASE WHEN kind IN ('DOUBLE', 'BIGINT') THEN (j->>'$.mixed')::DOUBLE END AS mixed_number,
       CASE WHEN kind IN ('DOUBLE', 'BIGINT', 'VARCHAR') THEN j->>'$.mixed' END AS mixed_text,
       CASE WHEN j IS NULL THEN 'The request is no JSON object with distinct names'
            WHEN kind IN ('NULL', 'OBJECT') THEN 'Value of feature ''mixed'' is neither a number nor a text' ELSE '' END AS errors
FROM k""")
def typed_request(spark, sf_dir):
    """Requests made from every event whose values are numbers, texts, nulls, objects, or broken."""
    given = load(spark, sf_dir, "events").select("event_id", scalars.typed_request(F.expr(_MIXED)).alias("r"))
    at = lambda name, part: F.element_at("r.features", name)[part]
    return given.select(
        "event_id", at("id", "kind").alias("id_kind"), at("id", "number").alias("id_number"), at("type", "text").alias("type_text"),
        at("mixed", "kind").alias("mixed_kind"), at("mixed", "number").alias("mixed_number"), at("mixed", "text").alias("mixed_text"),
        F.array_join("r.errors", "; ").alias("errors"),
    )
