import pytest
from pyspark.sql import functions as F

from tabsmith.functions import scalars
from tabsmith.operators import ledger


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (f"r{i}", "u" if i % 2 else "v", i, ["completed", "running", "failed", "completed"][i % 4], "regression",
         0.1 * i if i % 4 in (0, 3) else None, 5.0 - i if i % 4 in (0, 3) else None, ["t1"] if i % 2 else None)
        for i in range(10)
    ]
    return spark.createDataFrame(
        rows, "job_id string, user_id string, created_at int, status string, problem_type string, r2_score double, "
        "rmse double, tags array<string>"
    ).withColumns({c: F.lit(None).cast("double") for c in ("mae", "accuracy", "f1_score", "precision", "recall")})


def test_pages_cover_everything_once(runs):
    seen, after = [], None
    while True:
        page = ledger.list_runs(runs, limit=3, after=after).collect()
        if not page:
            break
        seen += [r["job_id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["job_id"])
    assert seen == [f"r{i}" for i in range(9, -1, -1)]
    with pytest.raises(ValueError):
        ledger.list_runs(runs, limit=101)


def test_compare_marks_every_tie(runs):
    picked = ledger.compare_runs(runs.withColumn("rmse", F.when(F.col("rmse").isNotNull(), 1.0)), ["r0", "r3", "r4", "r1", "r7"])
    rows = picked.collect()
    # one of the ids is not completed
    assert {r["job_id"] for r in rows} == {"r0", "r3", "r4", "r7"} and {r["metric"] for r in rows} == {"r2_score", "rmse", "mae"}
    assert {r["job_id"] for r in rows if r["metric"] == "rmse" and r["is_best"]} == {"r0", "r3", "r4", "r7"}
    assert [r["job_id"] for r in rows if r["metric"] == "r2_score" and r["is_best"]] == ["r7"]
    with pytest.raises(ValueError):
        ledger.compare_runs(runs, ["r0", "r3"], max_runs=1)
    assert not any(r["is_best"] for r in rows if r["metric"] == "mae")


def test_meta_rules(spark, runs):
    full = runs.withColumn("notes", F.lit("old"))
    updates = spark.createDataFrame(
        [("r0", ["a"], None), ("r1", None, "  "), ("r2", ["x"] * 11, "new"), ("r3", [" "], None),
         ("r4", ["y" * 51], None), ("r5", None, "n" * 1001), ("r6", None, "fresh")],
        "job_id string, new_tags array<string>, new_notes string",
    )
    got = {r["job_id"]: r for r in ledger.update_meta(full, updates).collect()}
    assert len(got) == 10
    assert got["r0"]["tags"] == ["a"] and got["r0"]["notes"] == "old"
    assert got["r1"]["notes"] is None and got["r6"]["notes"] == "fresh"
    for bad in ("r2", "r3", "r4", "r5"):
        assert got[bad]["error"] and got[bad]["notes"] == "old"


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        scalars.metric_band(F.lit(0.9)).alias("hi"), scalars.metric_band(F.lit(0.7)).alias("mid"),
        scalars.metric_band(F.lit(0.1)).alias("low"), scalars.metric_band(F.lit(None).cast("double")).alias("none"),
        scalars.r2_band(F.lit(0.4)).alias("r2"), scalars.placeholder(F.lit(1.0), F.lit(2.0)).alias("mid_point"),
        scalars.elapsed_s(scalars.parse_utc(F.lit("2024-01-01T00:00:00")), scalars.parse_utc(F.lit("2024-01-01T01:00:01+00:00"))).alias("s"),
        scalars.elapsed_s(scalars.parse_utc(F.lit("2024-01-01T02:00:00Z")), scalars.parse_utc(F.lit("2024-01-01T01:00:00Z"))).alias("back"),
        scalars.bar_width(F.lit(130.0)).alias("bar"),
    ).first()
    assert (row["hi"], row["mid"], row["low"], row["none"]) == ("high", "medium", "low", None)
    assert (row["r2"], row["mid_point"], row["s"], row["back"], row["bar"]) == (None, 2, 3601, None, 100.0)


def test_decimals_at_depth(spark):
    df = spark.sql("SELECT 1.5D AS a, array(2.5D) AS b, map('k', struct(3.5D AS v)) AS c, 'x' AS d")
    dec = scalars.to_decimal(df)
    assert dict(dec.dtypes) == {"a": "string", "b": "array<string>", "c": "map<string,struct<v:string>>", "d": "string"}
    assert scalars.to_double(dec, df.schema).collect() == df.collect()
    for x in (1.5e-12, 0.1234567890123, 1e30, -0.1 / 3):
        one = spark.createDataFrame([(x,)], "x double")
        assert scalars.to_double(scalars.to_decimal(one), one.schema).first()["x"] == x


def test_updates_are_folded(spark, runs):
    updates = spark.createDataFrame(
        [("r0", ["a"], None, 1), ("r0", ["b"], "n", 2), ("r0", [" "], None, 3), ("gone", ["a"], None, 1)],
        "job_id string, new_tags array<string>, new_notes string, at int",
    ).withColumn("requested_at", F.timestamp_seconds("at"))
    got = {r["job_id"]: r for r in ledger.update_meta(runs.withColumn("notes", F.lit("old")), updates).collect()}
    assert len(got) == 11 and got["r0"]["tags"] == ["b"] and got["r0"]["notes"] == "n"
    assert got["r0"]["error"] == ledger.BLANK_TAG and got["gone"]["error"] == ledger.NO_RUN
    assert got["r0"]["updated_at"].timestamp() == 2 and got["r1"]["updated_at"] is None
    full = runs.withColumns({"portable_path": F.lit("p"), "deployed": F.lit(None).cast("boolean"), "deployed_at": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame(
        [("r0", True, 1), ("r0", False, 2), ("r1", True, 1), ("r3", True, 5), ("gone", True, 1)], "job_id string, deploy boolean, at int"
    ).withColumn("requested_at", F.timestamp_seconds("at"))
    got = {r["job_id"]: r for r in ledger.set_deployed(full, asked).collect()}
    assert len(got) == 11 and got["r0"]["deployed"] is False and got["r3"]["deployed"] and got["r3"]["deployed_at"].timestamp() == 5
    assert got["r1"]["reason"].startswith(ledger.WRONG_STATUS) and got["gone"]["reason"] == ledger.NO_RUN


def test_signs_of_life(spark):
    rows = [("a", "running", 1, 1, None), ("a", None, 5, 2, None), ("b", None, 3, 3, None)]
    events = spark.createDataFrame(rows, "job_id string, status string, ts int, event_id int, message string")
    got = {r["job_id"]: (r["status"], r["updated_at"]) for r in ledger.apply_status(events).collect()}
    assert got == {"a": ("running", 5), "b": (None, 3)}
    assert [tuple(r) for r in ledger.followed(events).collect()] == [("a", "running", 1, False)]
