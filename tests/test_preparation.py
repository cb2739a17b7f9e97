import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import lookup as L
from tabsmith.operators import prepare
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.ranking import rank_distinct
from tabsmith.operators.split import train_test_split


def values_of(df, c):
    return [r[c] for r in df.collect()]


def test_median_and_mode(frame):
    df = frame("age int, color string, empty string",
               [20, 30, None, 40, 50], ["red", "blue", "red", None, "red"], [None] * 5)
    filled = prepare.impute_mode(prepare.impute_median(df))
    assert sorted(values_of(filled, "age")) == [20, 30, 35, 40, 50]
    assert sorted(values_of(filled, "color")) == ["blue", "red", "red", "red", "red"]
    assert set(values_of(filled, "empty")) == {"Unknown"}


def test_mode_tie_takes_the_smallest(frame):
    assert prepare.modes(frame("c string", ["b", "a", "b", "a", "c"]), ["c"]) == {"c": "a"}


def test_all_missing_number_stays_missing(frame):
    assert values_of(prepare.impute_median(frame("c double", [None, None])), "c") == [None, None]


def test_unseen_value_is_minus_one(frame):
    codes = prepare.dictionary(frame("color string", ["red", "blue", "red"]), ["color"])
    got = prepare.encode(frame("color string", ["green", "blue", "red", None]), codes, ["color"])
    assert values_of(got, "color") == [-1, 0, 1, -1]


def test_target_round_trip(frame):
    df = frame("y string", ["b", None, "a", "b"])
    coded, mapping = prepare.encode_target(df, "y")
    back = prepare.decode_target(coded, mapping, "y", "label")
    assert sorted(values_of(back, "label")) == ["a", "b", "b", "nan"]
    assert {r["label"]: r["code"] for r in mapping.collect()} == {"a": 0, "b": 1, "nan": 2}
    odd = prepare.decode_target(frame("y int", [7]), mapping, "y", "label")
    assert values_of(odd, "label") == ["7"]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "constant", "far", "infinite"])
def test_quantiles_by_narrowing_bins(frame, kind):
    rng = np.random.default_rng(11)
    data = {
        "normal": rng.normal(size=3000),
        "heavy": np.exp(rng.normal(size=3000) * 8),
        "ties": np.where(rng.random(3000) < 0.4, 5.0, rng.random(3000) * 10),
        "constant": np.full(300, 4.5),
        "far": np.concatenate([rng.random(2999), [1e300]]),
        "infinite": np.concatenate([rng.random(2998), [np.inf, -np.inf]]),
    }[kind]
    df = frame("c double", [float(v) for v in data] + [None, float("nan")])
    qs = [0.0, 0.25, 0.5, 1.0]
    got = exact_quantiles(df, ["c"], qs, buffer_values=20, bins=256)["c"]
    if kind == "infinite":
        assert got[0] == -math.inf and got[-1] == math.inf
        got, qs = got[1:3], qs[1:3]
    assert got == pytest.approx([float(v) for v in np.quantile(data, qs)], rel=1e-9)


def test_quantiles_small_and_absent(frame):
    assert exact_quantiles(frame("c int", [1, 2, 3, 4]), ["c"], [0.5]) == {"c": [2.5]}
    assert exact_quantiles(frame("c int", [None]), ["c"], [0.5]) == {"c": [None]}


def test_rank_with_buckets_equals_rank_with_window(spark):
    words = [("a" if i % 3 else "b", f"{'same-start-' * (i % 2)}{(i * 7919) % 2000:05d}") for i in range(2000)]
    df = spark.createDataFrame(words, "g string, v string").distinct()
    plain = {(r["g"], r["v"]): r["code"] for r in rank_distinct(df, "g", "v", "code").collect()}
    cut = {(r["g"], r["v"]): r["code"] for r in rank_distinct(df, "g", "v", "code", window_rows=100).collect()}
    assert plain == cut and len(plain) == df.count()


def test_lookup_with_hot_keys_equals_broadcast(spark, monkeypatch):
    keys = [(i, "hot" if i % 3 else f"k{i % 50}" if i % 2 else None) for i in range(3000)]
    df = spark.createDataFrame(keys, "i int, k string").repartition(5)
    entries = spark.createDataFrame([("hot", 1)] + [(f"k{j}", j + 10) for j in range(40)], "key string, code int")
    small = {r["i"]: r["code"] for r in L.lookup(df, entries, F.col("k"), "key", "code").collect()}
    monkeypatch.setattr(L, "BROADCAST_ENTRIES", 0)
    spread = L.lookup(df, entries, F.col("k"), "key", "code", salts=8)
    rows = spread.collect()
    assert len(rows) == 3000 and {r["i"]: r["code"] for r in rows} == small
    assert "hot" in L.hot_keys(df, F.col("k"))


@pytest.mark.parametrize("n,share", [(100, 0.2), (101, 0.2), (997, 0.3)])
def test_random_split_is_exact_and_stable(spark, n, share):
    df = spark.range(n)
    got = train_test_split(df, ["id"], test_size=share)
    again = train_test_split(df.repartition(7), ["id"], test_size=share)
    parts = {r["id"]: r["_split"] for r in got.collect()}
    assert len(parts) == n and parts == {r["id"]: r["_split"] for r in again.collect()}
    assert sum(p == "test" for p in parts.values()) == math.ceil(share * n)


def test_stratified_split_keeps_shares(spark):
    df = spark.range(1003).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN 'b' ELSE 'c' END").alias("y"))
    got = train_test_split(df, ["id"], "y").groupBy("y", "_split").count().collect()
    counts = {(r["y"], r["_split"]): r["count"] for r in got}
    assert sum(v for (_, s), v in counts.items() if s == "test") == math.ceil(0.2 * 1003)
    for y in "abc":
        whole = counts[y, "test"] + counts[y, "train"]
        assert abs(counts[y, "test"] - 0.2 * whole) < 1


def test_lonely_class_is_an_error(frame):
    df = frame("id int, y string", list(range(5)), ["a", "a", "a", "a", "b"])
    with pytest.raises(ValueError, match="only 1 member"):
        train_test_split(df, ["id"], "y")


def test_split_with_long_prefixes(spark, monkeypatch):
    from tabsmith.operators import split

    df = spark.range(500)
    want = {r["id"]: r["_split"] for r in train_test_split(df, ["id"]).collect()}
    monkeypatch.setattr(split, "ROWS_PER_PREFIX", 1)
    assert {r["id"]: r["_split"] for r in train_test_split(df, ["id"]).collect()} == want


def test_scoring_imputation(frame):
    df = frame("a double, b string, c double", [1.0, None, 3.0], ["x", None, "y"], [None, None, None])
    batch = prepare.impute_for_scoring(df).collect()
    assert [r["a"] for r in batch] == [1.0, 2.0, 3.0] and {r["c"] for r in batch} == {0.0}
    assert [r["b"] for r in batch] == ["x", "Unknown", "y"]
    fitted = prepare.impute_for_scoring(df, "fitted", {"a": 9.0, "c": None}).collect()
    assert [r["a"] for r in fitted] == [1.0, 9.0, 3.0]


def test_preprocess_record(frame):
    n = 60
    df = frame(
        "row_id int, size double, color string, flag boolean, y string",
        list(range(n)), [None if i % 10 == 0 else float(i % 13) + 0.5 for i in range(n)],
        [None if i % 9 == 0 else ["red", "blue"][i % 2] for i in range(n)], [i % 3 == 0 for i in range(n)],
        [["no", "yes"][i % 2] for i in range(n)],
    )
    made = prepare.preprocess(df, "y", ["row_id"])
    assert made.problem_type == "classification" and made.feature_columns == ["size", "color", "flag"]
    rows = made.df.collect()
    assert len(rows) == n and sum(r["_split"] == "test" for r in rows) == 12
    assert {r["y"] for r in rows} == {0, 1} and {r["color"] for r in rows} == {0, 1}
    assert all(r["size"] is not None for r in rows)
    meta = {r["feature"]: r for r in prepare.feature_metadata(made).collect()}
    assert meta["color"]["categories"] == {"blue": 0, "red": 1} and meta["size"]["is_integer"] is False
    assert meta["flag"]["feature_type"] == "numeric"


def test_fit_on_train_ignores_test_rows(spark):
    df = spark.range(50).select(
        F.col("id").alias("row_id"), F.concat(F.lit("v"), (F.col("id") % 20).cast("string")).alias("c"),
        (F.col("id") / 3).alias("y"),
    )
    made = prepare.preprocess(df, "y", ["row_id"], fit_on="train")
    train = {r["c"] for r in made.train.select("c").distinct().collect()}
    assert min(train) == 0 and made.dictionary.count() == len(train)
    with pytest.raises(ValueError, match="fit_on"):
        prepare.preprocess(df, "y", ["row_id"], fit_on="test")
