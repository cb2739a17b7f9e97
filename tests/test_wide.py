import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tabsmith.operators import detect, facts

SCHEMA = (
    "i int, l bigint, b boolean, f float, d double, t string, m decimal(20,2), day date, at timestamp, "
    "raw binary, many array<int>, nothing string"
)


def _rows():
    zone = dt.timezone.utc
    long = "x" * 5000
    return [
        (1, 2**62, True, 0.0, -0.0, "a", Decimal("1.50"), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, tzinfo=zone), b"a", [1], None),
        (1, -(2**62), True, -0.0, 0.0, "a b", Decimal("1.50"), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, tzinfo=zone), b"a", [1], None),
        (None, 2**62, None, float("nan"), float("nan"), long, None, None, None, None, None, None),
        (7, 3, False, 2.5, float("inf"), long + "y", Decimal("-3.00"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 1, tzinfo=zone), b"", [], None),
        (7, 3, False, 0.1, 0.1, "", Decimal("2.00"), dt.date(2024, 1, 2), None, b"b", [None], None),
    ]


def test_melted_facts_equal_the_branches(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    want = sorted(map(tuple, facts.column_facts(df).collect()))
    assert sorted(map(tuple, facts.melted_facts(df).collect())) == want
    assert facts.melted_facts(df).dtypes == facts.column_facts(df).dtypes
    some = ["t", "d"]
    assert {r["column_name"] for r in facts.melted_facts(df, some).collect()} == set(some)


def test_melted_facts_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sorted(map(tuple, facts.melted_facts(df).collect())) == sorted(map(tuple, facts.column_facts(df).collect()))


def test_times_are_told_apart_where_the_clock_goes_back(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.range(2).select(F.timestamp_seconds(F.lit(1729987200 + 1800) + F.col("id") * 3600).alias("at"))
        assert facts.melted_facts(df).first()["distinct_count"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_wide_tables_take_one_shuffle(spark):
    n = facts.BRANCH_COLUMNS + 60
    df = spark.range(50).select(*[
        (F.col("id") % (k + 1)).alias(f"c{k}") if k % 2 else F.concat(F.lit("v"), F.col("id") % (k + 1)).alias(f"c{k}")
        for k in range(n)
    ])
    plan = facts.column_facts(df)._jdf.queryExecution().toString()
    assert "posexplode" in plan
    got = detect.collect_rules(df)
    assert list(got) == df.columns
    assert all(got[f"c{k}"]["distinct_count"] == min(k + 1, 50) and got[f"c{k}"]["row_count"] == 50 for k in range(n))
    assert got["c0"]["is_constant"] and got["c0"]["code_rows"] == 50 and got["c1"]["integer_like"]
