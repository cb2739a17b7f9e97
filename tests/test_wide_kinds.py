"""Wide tables group each kind of column by values of its own type."""

import datetime as dt

from pyspark.sql import functions as F

from tabsmith.operators import facts

SCHEMA = "l bigint, d double, t string, day date, at timestamp, local timestamp_ntz, b boolean"


def _rows():
    at = dt.datetime(2024, 1, 1, 5)
    zoned = at.replace(tzinfo=dt.timezone.utc)
    return [
        (2**63 - 1, -0.0, "a-1", dt.date(2024, 1, 1), zoned, at, True),
        (2**63 - 2, 0.0, "ä" * 31 + "a", dt.date(2024, 1, 1), zoned, at, None),
        (None, float("nan"), "a" * 64, None, None, None, False),
        (2**63 - 2, None, "a" * 63, dt.date(1, 1, 1), zoned + dt.timedelta(microseconds=1), at + dt.timedelta(microseconds=1), True),
        (-(2**63), 0.5, "a b" * 40, None, None, None, True),
        (0, 0.5, None, None, None, None, None),
        (0, 0.5, "", None, None, None, None),
    ]


def test_facts_of_every_kind_equal_the_branches(spark):
    df = spark.createDataFrame(_rows() * 2, SCHEMA)
    assert sorted(map(tuple, facts.melted_facts(df).collect())) == sorted(map(tuple, facts.column_facts(df).collect()))


def test_numbers_and_moments_are_no_texts_in_the_shuffle(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).select("l", "d", "day", "at", "local")
    plan = facts.melted_facts(df)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Aggregate [at" in line and "k#" in line]
    assert len(shuffled) == 5 and not any(f"cast(v#" in line and "as string" in line for line in plan.splitlines())


def test_texts_are_matched_once_a_group(spark):
    df = spark.range(20).select(F.when(F.col("id") % 2 == 0, "x-1").otherwise("x 2").alias("t"))
    row = facts.melted_facts(df).first()
    assert (row["code_rows"], row["max_bytes"], row["distinct_count"]) == (10, 3, 2)
    plan = facts.melted_facts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(code" in plan
