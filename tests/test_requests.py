"""Feature requests whose values keep their kinds; targets checked against stored records."""

from pyspark.sql import functions as F

from tabsmith.functions.scalars import typed_request
from tabsmith.sources.records import check_targets, profile_record

BROKEN = ["The request is no JSON object with distinct names"]


def _parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    return [r["r"] for r in rows.select("i", typed_request(F.col("j")).alias("r")).orderBy("i").collect()]


def test_kinds_numbers_and_texts(spark):
    (r,) = _parsed(spark, '{"a": 1, "b": 1.0, "c": "1", "d": 1e3, "e": true, "f": false, "g": -0.25, "h": "", "i": 123456789012345678901}')
    got = {k: (v["kind"], v["number"]) for k, v in r["features"].items()}
    assert got == {
        "a": ("int", 1.0), "b": ("float", 1.0), "c": ("string", None), "d": ("float", 1000.0), "e": ("int", 1.0),
        "f": ("int", 0.0), "g": ("float", -0.25), "h": ("string", None), "i": ("int", 123456789012345678901.0),
    }
    assert r["features"]["c"]["text"] == "1" and r["features"]["h"]["text"] == "" and r["errors"] == []


def test_values_that_are_no_features(spark):
    (r,) = _parsed(spark, '{"z": [1], "n": null, "o": {"a": 1}, "k": 2}')
    assert list(r["features"]) == ["k"]
    assert r["errors"] == [f"Value of feature '{k}' is neither a number nor a text" for k in ("n", "o", "z")]


def test_broken_requests(spark):
    got = _parsed(spark, "[1]", "{", "", "3", '{"a": 1, "a": 2}', None, "{}", " {} ")
    assert [g and (g["features"], g["errors"]) for g in got] == [(None, BROKEN)] * 5 + [None, ({}, []), ({}, [])]


def test_targets_of_stored_records(spark):
    record = profile_record(spark.createDataFrame([(1, "x")], "a int, b string"), "d", "f")
    asked = spark.createDataFrame([("d", "a"), ("d", "A"), ("d", None), ("none", "a")], "dataset_id string, target string")
    got = {(r["dataset_id"], r["target"]): (r["accepted"], r["row_count"]) for r in check_targets(asked, record).collect()}
    assert got == {("d", "a"): (True, 1), ("d", "A"): (False, 1), ("d", None): (False, 1), ("none", "a"): (False, None)}
