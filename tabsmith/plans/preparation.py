"""Imputation, encoding, split and full-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.schema import missing_columns, project_features
from tabsmith.operators import prepare
from tabsmith.operators.split import train_test_split
from tabsmith.plans.catalog import load, query
from tabsmith.plans.profiling import (
    HOLED_LINEITEM_SQL, HOLED_ORDERS_SQL, holed_lineitem, holed_orders,
)

LINEITEM_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
_LINEITEM_KEY = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice))"


@query("project_features", "SELECT l_tax, l_quantity, l_linenumber FROM lineitem")
def project_features_query(spark, sf_dir):
    return project_features(load(spark, sf_dir, "lineitem"), ["l_tax", "l_quantity", "l_linenumber"])


@query("missing_columns", """
SELECT c AS column_name, (SELECT COUNT(*) FROM orders) AS row_count
FROM (SELECT UNNEST(['o_orderkey', 'o_comment', 'o_totalprice', 'o_clerk']) AS c)
WHERE c NOT IN ('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority')""")
def missing_columns_query(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    absent = missing_columns(["o_orderkey", "o_comment", "o_totalprice", "o_clerk"], df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.explode(F.array(*[F.lit(c) for c in absent])).alias("column_name"), "row_count"
    )


@query("impute_median", f"""
WITH t AS ({HOLED_LINEITEM_SQL})
SELECT l_orderkey, l_linenumber,
       COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity,
       COALESCE(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM t)) AS l_discount
FROM t""")
def impute_median(spark, sf_dir):
    df = holed_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return prepare.impute_median(df)


def _mode_sql(c: str, source: str) -> str:
    return (f"COALESCE((SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY COUNT(*) DESC, {c} LIMIT 1), 'Unknown')")


@query("impute_mode", f"""
WITH t AS (SELECT o_orderkey, o_orderpriority, CAST(NULL AS VARCHAR) AS empty_text FROM ({HOLED_ORDERS_SQL}))
SELECT o_orderkey, COALESCE(o_orderpriority, {_mode_sql('o_orderpriority', 't')}) AS o_orderpriority,
       COALESCE(empty_text, {_mode_sql('empty_text', 't')}) AS empty_text FROM t""")
def impute_mode(spark, sf_dir):
    df = holed_orders(spark, sf_dir).select(
        "o_orderkey", "o_orderpriority", F.lit(None).cast("string").alias("empty_text")
    )
    return prepare.impute_mode(df)


def _dict_sql(columns: list[str], source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {c} AS value, (ROW_NUMBER() OVER (ORDER BY {c}) - 1)::INTEGER AS code "
        f"FROM (SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL)" for c in columns
    )


@query("label_dictionary", _dict_sql(["p_name", "p_brand", "p_type"], "part"))
def label_dictionary(spark, sf_dir):
    return prepare.dictionary(load(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("label_encode_fit", f"""
WITH d AS ({_dict_sql(['p_name', 'p_brand', 'p_type'], 'part')})
SELECT p_partkey, (SELECT code FROM d WHERE column_name = 'p_name' AND value = p_name) AS p_name,
       (SELECT code FROM d WHERE column_name = 'p_brand' AND value = p_brand) AS p_brand,
       (SELECT code FROM d WHERE column_name = 'p_type' AND value = p_type) AS p_type
FROM part""")
def label_encode_fit(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    columns = ["p_name", "p_brand", "p_type"]
    return prepare.encode(df, prepare.dictionary(df, columns), columns)


# dictionary of the customers of early orders, applied to all orders: later customers are unseen
_EARLY = "o_orderdate < TIMESTAMP '1996-01-01'"


@query("encode_lookup_unseen", f"""
WITH d AS (SELECT v, (ROW_NUMBER() OVER (ORDER BY v) - 1)::INTEGER AS code
           FROM (SELECT DISTINCT CAST(o_orderdate AS VARCHAR) AS v FROM orders WHERE {_EARLY}))
SELECT o_orderkey, COALESCE(d.code, -1) AS day_code FROM orders LEFT JOIN d ON CAST(o_orderdate AS VARCHAR) = d.v""")
def encode_lookup_unseen(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    days = df.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day_code"), "o_orderdate")
    codes = prepare.dictionary(days.where("o_orderdate < TIMESTAMP_NTZ'1996-01-01'"), ["day_code"])
    return prepare.encode(days.select("o_orderkey", "day_code"), codes, ["day_code"])


@query("encode_target", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), s AS (SELECT *, COALESCE(l_returnflag, 'nan') AS y FROM t),
d AS (SELECT y, (ROW_NUMBER() OVER (ORDER BY y) - 1)::INTEGER AS code FROM (SELECT DISTINCT y FROM s))
SELECT l_orderkey, l_linenumber, d.code AS l_returnflag FROM s JOIN d USING (y)""")
def encode_target(spark, sf_dir):
    df = holed_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return prepare.encode_target(df, "l_returnflag")[0]


@query("decode_target", """
WITH d AS (SELECT o_orderpriority AS label, (ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT l_orderkey, l_linenumber, COALESCE(d.label, CAST(l_linenumber AS VARCHAR)) AS label
FROM lineitem LEFT JOIN d ON d.code = l_linenumber""")
def decode_target(spark, sf_dir):
    codes = prepare.dictionary(load(spark, sf_dir, "orders"), ["o_orderpriority"])
    mapping = codes.select("code", F.col("value").alias("label"))
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return prepare.decode_target(df, mapping, "l_linenumber", "label")


def split_sql(source: str, label: str, key: str) -> str:
    """CTEs: sizes per class, test rows by largest remainder, rank by hash."""
    return f"""h AS (SELECT *, {label} AS cls, {key} AS hash FROM {source}),
sz AS (SELECT cls, COUNT(*) AS n FROM h GROUP BY 1),
tot AS (SELECT SUM(n)::BIGINT AS rows, CEIL(0.2 * SUM(n)::DOUBLE)::BIGINT AS test FROM sz),
fl AS (SELECT cls, n, (n * test) // rows AS base, (n * test) % rows AS rest, test FROM sz, tot),
al AS (SELECT cls, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, md5(cls)) <= test - SUM(base) OVER () THEN 1 ELSE 0 END AS take FROM fl),
sp AS (SELECT h.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY h.cls ORDER BY hash) <= al.take THEN 'test' ELSE 'train' END AS _split
       FROM h JOIN al ON h.cls = al.cls)"""


@query("split_stratified", f"""
WITH {split_sql('orders', 'o_orderstatus', 'md5(CAST(o_orderkey AS VARCHAR))')}
SELECT o_orderkey, o_orderstatus, _split FROM sp""")
def split_stratified(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return train_test_split(df, ["o_orderkey"], "o_orderstatus")


@query("split_random", f"""
WITH {split_sql('lineitem', "'all'", _LINEITEM_KEY)}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, _split FROM sp""")
def split_random(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return train_test_split(df, LINEITEM_KEYS).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "_split"
    )


@query("preprocess_orders", f"""
WITH t AS ({HOLED_ORDERS_SQL}),
f AS (SELECT o_orderkey, o_custkey, o_orderstatus,
             COALESCE(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)) AS o_totalprice, o_orderdate,
             COALESCE(o_orderpriority, {_mode_sql('o_orderpriority', 't')}) AS o_orderpriority FROM t),
dp AS ({_dict_sql(['o_orderpriority'], 'f')}), ds AS ({_dict_sql(['o_orderstatus'], 'f')}),
{split_sql('f', 'o_orderstatus', 'md5(CAST(o_orderkey AS VARCHAR))')}
SELECT o_custkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, dp.code AS o_orderpriority,
       ds.code AS o_orderstatus, _split
FROM sp JOIN dp ON dp.value = o_orderpriority JOIN ds ON ds.value = o_orderstatus""")
def preprocess_orders(spark, sf_dir):
    made = prepare.preprocess(holed_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"])
    return made.df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_L_TEXT = ["l_returnflag", "l_linestatus"]


@query("preprocess_lineitem", f"""
WITH t AS ({HOLED_LINEITEM_SQL}),
f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
             COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity, l_extendedprice,
             COALESCE(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM t)) AS l_discount, l_tax,
             COALESCE(l_returnflag, {_mode_sql('l_returnflag', 't')}) AS l_returnflag, l_linestatus, l_shipdate FROM t),
d AS ({_dict_sql(_L_TEXT, 'f')}),
{split_sql('f', "'all'", _LINEITEM_KEY)}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
       (SELECT code FROM d WHERE column_name = 'l_returnflag' AND value = l_returnflag) AS l_returnflag,
       (SELECT code FROM d WHERE column_name = 'l_linestatus' AND value = l_linestatus) AS l_linestatus,
       CAST(l_shipdate AS VARCHAR) AS l_shipdate, l_extendedprice, _split
FROM sp""")
def preprocess_lineitem(spark, sf_dir):
    made = prepare.preprocess(holed_lineitem(spark, sf_dir), "l_extendedprice", LINEITEM_KEYS)
    return made.df.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))




def metadata_rows(made):
    """Metadata with the category map as text ``value=code;...`` so that it compares as a plain column."""
    pairs = F.sort_array(F.map_entries("categories"))
    text = F.array_join(
        F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"].cast("string"))), ";"
    )
    return prepare.feature_metadata(made).withColumn("categories", text)


@query("feature_metadata", f"""
WITH t AS ({HOLED_ORDERS_SQL}),
f AS (SELECT COALESCE(o_orderpriority, {_mode_sql('o_orderpriority', 't')}) AS o_orderpriority FROM t),
dp AS ({_dict_sql(['o_orderpriority'], 'f')})
SELECT 0 AS position, 'o_custkey' AS feature, 'numeric' AS feature_type, MIN(o_custkey)::DOUBLE AS min_value,
       MAX(o_custkey)::DOUBLE AS max_value, BOOL_AND(o_custkey = FLOOR(o_custkey)) AS is_integer, NULL::VARCHAR AS categories FROM t
UNION ALL SELECT 1, 'o_totalprice', 'numeric', MIN(o_totalprice), MAX(o_totalprice), BOOL_AND(o_totalprice = FLOOR(o_totalprice)), NULL FROM t
UNION ALL SELECT 2, 'o_orderdate', 'numeric', NULL, NULL, NULL, NULL
UNION ALL SELECT 3, 'o_orderpriority', 'categorical', NULL, NULL, NULL, string_agg(value || '=' || code, ';' ORDER BY value) FROM dp""")
def feature_metadata(spark, sf_dir):
    return metadata_rows(prepare.preprocess(holed_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"]))


@query("impute_scoring_batch", f"""
WITH t AS (SELECT l_orderkey, l_quantity, l_discount, l_returnflag, CAST(NULL AS DOUBLE) AS no_value FROM ({HOLED_LINEITEM_SQL}))
SELECT l_orderkey, COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity,
       COALESCE(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM t)) AS l_discount,
       COALESCE(l_returnflag, 'Unknown') AS l_returnflag, COALESCE(no_value, 0.0) AS no_value FROM t""")
def impute_scoring_batch(spark, sf_dir):
    df = holed_lineitem(spark, sf_dir).select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", F.lit(None).cast("double").alias("no_value")
    )
    return prepare.impute_for_scoring(df, "batch")


