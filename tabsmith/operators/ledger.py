"""Run history as ordinary tables: status folding, listing, tagging, deploying, comparing.

A run is one row keyed by ``job_id``. Writes are appended events or update tables joined by key, so
every operator is a projection, a key join or a per-run fold with map-side combining.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.detect import BUDGET_MAX, BUDGET_MIN, preview_rule, time_budget

# Run states, record limits and the metrics compared.
STATUSES = ("pending", "running", "completed", "failed")
TERMINAL = ("completed", "failed")
MAX_TAGS, TAG_CHARS, NOTE_CHARS = 10, 50, 1000
PAGE_DEFAULT, PAGE_MAX = 20, 100
CLASSIFICATION_METRICS = ("accuracy", "f1_score", "precision", "recall")
REGRESSION_METRICS = ("r2_score", "rmse", "mae")
LOWER_IS_BETTER = ("rmse", "mae")
# The reasons that callers match on.
NO_DATASET, NO_TARGET = "Dataset not found", "Target column not found in dataset"
NO_RUN, NO_MODEL = "Job not found", "No portable model available for this job"
WRONG_STATUS = "Cannot deploy job with status '"
TOO_MANY_TAGS, BLANK_TAG = f"Maximum {MAX_TAGS} tags allowed per job", "Tags cannot be empty or whitespace"
LONG_TAG, LONG_NOTES = f"Each tag must be {TAG_CHARS} characters or less", f"Notes must be {NOTE_CHARS} characters or less"


# --- creating and following runs ----------------------------------------------------------------


def with_dataset(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    return runs.join(datasets, "dataset_id", "left")


def create_runs(requests: DataFrame, datasets: DataFrame, facts: DataFrame) -> DataFrame:
    """Pending runs with ids, times, previewed problem type and search budget; a bad request carries an error.

    ``requests(dataset_id, target_column[, budget])``, ``datasets(dataset_id, dataset_name)``,
    ``facts`` = column facts with ``dataset_id``.
    """
    about = facts.select(
        "dataset_id", F.col("column_name").alias("target_column"), "row_count",
        preview_rule("service").alias("problem_type"),
    )
    budget = F.col("budget") if "budget" in requests.columns else None
    joined = requests.join(datasets, "dataset_id", "left").join(
        about, ["dataset_id", "target_column"], "left"
    )
    error = F.when(F.col("dataset_name").isNull(), NO_DATASET).when(F.col("problem_type").isNull(), NO_TARGET)
    if budget is not None:
        outside = (budget < BUDGET_MIN) | (budget > BUDGET_MAX)
        error = F.coalesce(error, F.when(outside, F.lit(f"time budget must be within {BUDGET_MIN}-{BUDGET_MAX} seconds")))
        budget = F.when(~outside, budget)
    now = F.current_timestamp()
    return joined.select(
        F.uuid().alias("job_id"), now.alias("created_at"), now.alias("updated_at"), "dataset_id", "target_column", "dataset_name", F.lit("default").alias("user_id"),
        F.when(error.isNull(), "pending").alias("status"), "problem_type",
        F.when(error.isNull(), time_budget(F.coalesce("row_count", F.lit(1000)), budget)).alias("estimated_time"),
        error.alias("error"),
    )


def _newest(value: Column, when: Column | None = None) -> Column:
    order = F.struct("ts", "event_id")
    if when is None:
        return F.max_by(value, order)
    return F.max_by(value, F.when(when, order))


def latest_state(events: DataFrame) -> DataFrame:
    """Newest status per run; a message, once given, sticks until replaced.

    An event without a status is a sign of life: it only moves ``updated_at``.
    """
    return events.groupBy("job_id").agg(
        _newest(F.col("status"), F.col("status").isNotNull()).alias("status"),
        _newest(F.col("message"), F.col("message").isNotNull()).alias("error_message"),
        F.max("ts").alias("updated_at"),
    )


def apply_status(events: DataFrame) -> DataFrame:
    """Fold of status writes: running sets started_at, a terminal state sets completed_at."""
    status = F.col("status")
    return events.groupBy("job_id").agg(
        _newest(status, status.isNotNull()).alias("status"),
        F.max(F.when(status == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(status.isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        _newest(F.col("message"), F.col("message").isNotNull()).alias("error_message"),
        F.max("ts").alias("updated_at"),
    )


def followed(events: DataFrame) -> DataFrame:
    """What a follower sees last: the first terminal status of a run, else its newest status.

    Events without a status are not seen.
    """
    events = events.where(F.col("status").isNotNull())
    over = F.col("status").isin(*TERMINAL)
    order = F.struct("ts", "event_id")
    first_end = F.min_by(F.struct("status", "ts"), F.when(over, order))
    newest = F.max_by(F.struct("status", "ts"), order)
    return (
        events.groupBy("job_id").agg(first_end.alias("e"), newest.alias("n"))
        .select("job_id", F.coalesce("e.status", "n.status").alias("status"),
                F.coalesce("e.ts", "n.ts").alias("ts"), F.col("e").isNotNull().alias("finished"))
    )


# --- reading ------------------------------------------------------------------------------------


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "running", "failed")],
    )


def list_runs(
    runs: DataFrame,
    user: str | None = None,
    limit: int = PAGE_DEFAULT,
    after: tuple[object, str] | None = None,
) -> DataFrame:
    """One page, newest first; ``after`` is the (created_at, job_id) of the last row already seen.

    The order is global, and the page is a take-ordered over the rows below the token, so reading
    page n costs the same as page 1.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be within 1-{PAGE_MAX}")
    page = runs if user is None else runs.where(F.col("user_id") == user)
    if after is not None:
        created, job = after
        page = page.where(
            (F.col("created_at") < F.lit(created))
            | ((F.col("created_at") == F.lit(created)) & (F.col("job_id") < F.lit(job)))
        )
    return page.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def runs_for_user(runs: DataFrame, user: str = "default") -> DataFrame:
    return runs.where(F.col("user_id") == user).select(
        "job_id", "dataset_id", "status", "target_column", "problem_type", "dataset_name", "created_at"
    )


def filter_runs(runs: DataFrame, status: str = "all", tag: str = "") -> DataFrame:
    out = runs if status == "all" else runs.where(F.col("status") == status)
    return out.where(F.array_contains("tags", tag)) if tag else out


def all_tags(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def run_summary(runs: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Light listing. With ``zero_is_missing`` a metric of exactly 0 is shown as absent."""
    metric = F.when(F.col("problem_type") == "classification", F.col("accuracy")).when(
        F.col("problem_type") == "regression", F.col("r2_score")
    )
    took = F.col("training_time")
    if zero_is_missing:
        metric, took = F.nullif(metric, F.lit(0.0)), F.nullif(took, F.lit(0.0))
    return runs.select(
        "job_id", "dataset_id", "status", "problem_type",
        metric.alias("primary_metric"), took.alias("training_time"),
        F.when(F.col("best_estimator") != "", F.col("best_estimator")).alias("best_estimator"),
    )


def run_detail(runs: DataFrame, job_id: str | None = None) -> DataFrame:
    """Full record; locations only of completed runs."""
    done = F.col("status") == "completed"
    picked = runs if job_id is None else runs.where(F.col("job_id") == job_id)
    return picked.select(
        "job_id", "dataset_id", "status", "target_column", "problem_type",
        F.coalesce("deployed", F.lit(False)).alias("deployed"),
        F.when(done, F.col("model_path")).alias("model_location"),
        F.when(done, F.col("portable_path")).alias("portable_location"),
        F.when(done, F.coalesce("eda_report_path", "report_path")).alias("eda_report_location"),
        F.when(done, F.col("training_report_path")).alias("training_report_location"),
    )


def scorable(runs: DataFrame) -> DataFrame:
    """Whether a run can answer predictions, and if not, the first reason."""
    reason = (
        F.when(~F.coalesce("deployed", F.lit(False)), "not deployed")
        .when(F.col("portable_path").isNull(), "no portable model")
        .when(F.coalesce(F.size("feature_columns"), F.lit(0)) <= 0, "no feature columns")
    )
    return runs.select("job_id", reason.isNull().alias("scorable"), reason.alias("reason"))


# --- selecting, comparing, removing -------------------------------------------------------------


def select_runs(runs: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Completed runs among the ids."""
    done = runs.where(F.col("status") == "completed")
    if isinstance(ids, DataFrame):
        return done.join(ids.select("job_id"), "job_id", "left_semi")
    return done.where(F.col("job_id").isin(list(dict.fromkeys(ids))))


def compare_runs(runs: DataFrame, ids: Sequence[str], max_runs: int | None = None) -> DataFrame:
    """(metric, job_id, value, is_best) of all given runs; every tie is marked.

    The metric list is that of the first given run that is completed. More than ``max_runs`` different
    ids are an error.
    """
    wanted = list(dict.fromkeys(ids))
    if max_runs is not None and len(wanted) > max_runs:
        raise ValueError(f"at most {max_runs} runs can be compared, {len(wanted)} were given")
    picked = select_runs(runs, wanted)
    place = F.array_position(F.array(*[F.lit(i) for i in wanted]).cast("array<string>"), F.col("job_id"))
    first = picked.agg(F.min_by("problem_type", place)).first()[0]
    names = REGRESSION_METRICS if first == "regression" else CLASSIFICATION_METRICS
    long = picked.unpivot(["job_id"], list(names), "metric", "value")
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    best = long.groupBy("metric").agg(
        F.when(F.first(lower), F.min("value")).otherwise(F.max("value")).alias("best")
    )
    return long.join(best, "metric").select(
        "metric", "job_id", "value", F.coalesce(F.col("value") == F.col("best"), F.lit(False)).alias("is_best")
    )


def purge_runs(runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs kept, and a report of what goes with each removed run."""
    gone = ids.select("job_id")
    kept = runs.join(gone, "job_id", "left_anti")
    report = F.coalesce("eda_report_path", "report_path") if "report_path" in runs.columns else F.col("eda_report_path")
    paths = [F.col("model_path"), F.col("portable_path"), report, F.col("training_report_path")]
    removed = runs.join(gone, "job_id", "left_semi").select(
        "job_id", "dataset_id", sum((p.isNotNull().cast("int") for p in paths), F.lit(0)).alias("artifacts"),
    )
    return kept, removed


# --- updating -----------------------------------------------------------------------------------


def _meta_error() -> Column:
    tags, notes = F.col("new_tags"), F.col("new_notes")
    return (
        F.when(F.size(tags) > MAX_TAGS, TOO_MANY_TAGS)
        .when(F.exists(tags, lambda t: F.trim(t) == ""), BLANK_TAG)
        .when(F.exists(tags, lambda t: F.char_length(t) > TAG_CHARS), LONG_TAG)
        .when(F.char_length(notes) > NOTE_CHARS, LONG_NOTES)
    )


def _touched(runs: DataFrame, change: Column, at: Column) -> Column:
    old = F.col("updated_at") if "updated_at" in runs.columns else F.lit(None).cast("timestamp")
    return F.when(change, at).otherwise(old)


def update_meta(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Tags and notes after ``updates(job_id, new_tags, new_notes[, requested_at])``.

    A rejected update changes nothing. NULL leaves a field alone, blank notes remove the value. Several
    updates of one run are folded to one row, later ones winning field by field (in the order of
    ``requested_at``, without it in the order of their content); ``error`` is that of the last update.
    An update of an unknown run becomes a row with an error.
    """
    when = F.col("requested_at") if "requested_at" in updates.columns else F.current_timestamp()
    order = F.struct(when.alias("at"), F.col("new_tags"), F.col("new_notes"))
    fine = F.col("error").isNull()
    folded = updates.withColumn("error", _meta_error()).groupBy("job_id").agg(
        F.max_by("new_tags", F.when(fine & F.col("new_tags").isNotNull(), order)).alias("new_tags"),
        F.max_by("new_notes", F.when(fine & F.col("new_notes").isNotNull(), order)).alias("new_notes"),
        F.max(F.when(fine, when)).alias("changed_at"), F.max_by("error", order).alias("error"),
    )
    joined = runs.withColumn("known", F.lit(True)).join(folded, "job_id", "full_outer")
    return joined.withColumns({
        "tags": F.coalesce("new_tags", "tags"),
        "notes": F.when(F.trim("new_notes") == "", F.lit(None)).otherwise(F.coalesce("new_notes", "notes")),
        "updated_at": _touched(runs, F.col("changed_at").isNotNull(), F.col("changed_at")),
        "error": F.when(F.col("known").isNull(), F.lit(NO_RUN)).otherwise(F.col("error")),
    }).drop("new_tags", "new_notes", "changed_at", "known")


def set_deployed(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """State after ``requests(job_id, deploy, requested_at)``; rejected ones carry a reason.

    Several requests of one run are folded to one row: the latest accepted one decides, ``reason`` is
    that of the latest. A request for an unknown run becomes a row with a reason.
    """
    about = runs.select("job_id", "status", "portable_path", F.lit(True).alias("known"))
    reason = (
        F.when(F.col("known").isNull(), NO_RUN)
        .when(F.col("status") != "completed", F.concat(F.lit(WRONG_STATUS), F.col("status"), F.lit("'")))
        .when(F.col("deploy") & F.col("portable_path").isNull(), NO_MODEL)
    )
    order = F.struct("requested_at", "deploy")
    folded = requests.where(F.col("deploy").isNotNull()).join(about, "job_id", "left").withColumn("reason", reason)
    folded = folded.groupBy("job_id").agg(
        F.max_by(order, F.when(F.col("reason").isNull(), order)).alias("last"), F.max_by("reason", order).alias("reason")
    )
    change, at = F.col("last").isNotNull(), F.col("last.requested_at")
    joined = runs.join(folded, "job_id", "full_outer")
    return joined.withColumns({
        "deployed": F.when(change, F.col("last.deploy")).otherwise(F.coalesce("deployed", F.lit(False))),
        "deployed_at": F.when(change, F.when(F.col("last.deploy"), at)).otherwise(F.col("deployed_at")),
        "updated_at": _touched(runs, change, at),
    }).drop("last")


# --- ranked small results -----------------------------------------------------------------------


def top_importance(importance: DataFrame, k: int) -> DataFrame:
    """Top-k features with their share of the largest and a bar of at most 30 marks."""
    top = importance.orderBy(F.col("importance").desc(), "feature").limit(k)
    largest = top.agg(F.max("importance").alias("m")).scalar()
    share = F.when(largest > 0, F.col("importance") / largest).otherwise(F.lit(0.0))
    return top.select(
        "feature", "importance", (share * 100).alias("pct_of_max"),
        F.floor(share * 30).cast("int").alias("bar_length"),
    )


def rank_probabilities(predictions: DataFrame, key: str, probabilities: str, names: Column | None = None) -> DataFrame:
    """Classes of each prediction by falling probability, ranked inside the row without a shuffle."""
    entries = F.transform(
        F.col(probabilities),
        lambda p, i: F.struct((-p).alias("neg"), i.alias("code"), p.alias("probability")),
    )
    ranked = predictions.select(key, F.posexplode(F.array_sort(entries)).alias("at", "e"))
    label = F.concat(F.lit("class_"), F.col("e.code").cast("string")) if names is None else F.element_at(names, F.col("e.code") + 1)
    return ranked.select(
        key, (F.col("at") + 1).alias("rank"), label.alias("class"), F.col("e.probability").alias("probability")
    )
