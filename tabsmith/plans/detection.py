"""Problem-type and column-quality detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.schema import ID_NAME_PATTERNS, id_name_match, schema_table
from tabsmith.operators import detect
from tabsmith.operators.facts import column_facts, union_all
from tabsmith.plans.catalog import TABLES, facts_sql, load, query
from tabsmith.plans.profiling import HOLED_LINEITEM_SQL, holed_lineitem

ALL = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "documents", "labels")


def facts_of(spark, sf_dir, tables):
    return union_all([
        column_facts(load(spark, sf_dir, t)).withColumn("table_name", F.lit(t)) for t in tables
    ])


def facts_of_sql(tables) -> str:
    return "\nUNION ALL\n".join(facts_sql(t, TABLES[t], t) for t in tables)


_D1 = """CASE WHEN row_count = 0 OR column_type <> 'numeric' THEN 'classification'
     WHEN integer_like AND distinct_count <= 10 THEN 'classification'
     WHEN distinct_count < 20 AND distinct_count::DOUBLE / row_count < 0.05 THEN 'classification'
     ELSE 'regression' END"""
_ID_NAME = "regexp_matches(lower(trim(column_name)), '" + "|".join(f"({p})" for p in ID_NAME_PATTERNS) + "')"
_SEQ = "(distinct_count = row_count AND COALESCE(max_value - min_value = distinct_count - 1, row_count = 0))"
_ID = f"""({_ID_NAME} OR (sql_type IN ('INTEGER', 'BIGINT') AND {_SEQ})
     OR (sql_type = 'VARCHAR' AND distinct_count::DOUBLE / row_count > 0.95 AND code_share > 0.9))"""
_HIGH = "(sql_type = 'VARCHAR' AND distinct_count::DOUBLE / row_count > 0.5)"


@query("problem_type_all_columns",
       f"WITH facts AS ({facts_of_sql(ALL)}) SELECT table_name, column_name, distinct_count, {_D1} AS problem_type FROM facts")
def problem_type_all_columns(spark, sf_dir):
    return facts_of(spark, sf_dir, ALL).select(
        "table_name", "column_name", "distinct_count", detect.problem_type_rule().alias("problem_type")
    )


_FEW = "(distinct_count < 20 OR distinct_count::DOUBLE / row_count < 0.05)"


@query("problem_type_preview", f"""
WITH facts AS ({facts_of_sql(('lineitem', 'orders'))})
SELECT table_name, column_name,
       CASE WHEN column_type = 'numeric' THEN CASE WHEN distinct_count > 0 AND {_FEW} THEN 'classification' ELSE 'regression' END
            ELSE 'classification' END AS service_type,
       CASE WHEN column_type = 'numeric' THEN CASE WHEN {_FEW} THEN 'classification' ELSE 'regression' END
            WHEN column_type = 'categorical' THEN 'classification' ELSE 'regression' END AS screen_type
FROM facts""")
def problem_type_preview(spark, sf_dir):
    return facts_of(spark, sf_dir, ("lineitem", "orders")).select(
        "table_name", "column_name",
        detect.preview_rule("service").alias("service_type"),
        detect.preview_rule("screen").alias("screen_type"),
    )


@query("integer_like", f"""
WITH facts AS ({facts_of_sql(('lineitem', 'part'))})
SELECT table_name, column_name, integer_like FROM facts WHERE column_type = 'numeric'""")
def integer_like(spark, sf_dir):
    return facts_of(spark, sf_dir, ("lineitem", "part")).where("column_type = 'numeric'").select(
        "table_name", "column_name", "integer_like"
    )


_ID_TABLES = ("orders", "customer", "part", "supplier", "nation", "region", "events", "pages")


@query("id_columns",
       f"WITH facts AS ({facts_of_sql(_ID_TABLES)}) SELECT table_name, column_name, {_ID} AS is_id FROM facts")
def id_columns(spark, sf_dir):
    return facts_of(spark, sf_dir, _ID_TABLES).select(
        "table_name", "column_name", detect.id_rule().alias("is_id")
    )


@query("sequential_columns", f"""
WITH facts AS ({facts_of_sql(('orders', 'customer', 'events'))})
SELECT table_name, column_name, {_SEQ} AS is_sequential FROM facts WHERE sql_type IN ('INTEGER', 'BIGINT')""")
def sequential_columns(spark, sf_dir):
    return facts_of(spark, sf_dir, ("orders", "customer", "events")).where(
        "data_type IN ('int', 'bigint')"
    ).select("table_name", "column_name", detect.sequential_rule().alias("is_sequential"))


@query("id_name_match", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    f"regexp_matches(lower(trim('{c}')), '{'|'.join(f'({p})' for p in ID_NAME_PATTERNS)}') AS id_name, "
    f"COUNT(*) AS row_count FROM {t}" for t in ("orders", "events", "documents", "labels") for c in TABLES[t]))
def id_name_query(spark, sf_dir):
    parts = []
    for t in ("orders", "events", "documents", "labels"):
        df = load(spark, sf_dir, t)
        rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(schema_table(spark, df).select(
            F.lit(t).alias("table_name"), "column_name",
            id_name_match(F.col("column_name")).alias("id_name"), rows.alias("row_count")))
    return union_all(parts)


# Constant, nearly constant and copied columns derived from orders.
ODD_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       'fixed' AS one_value, CAST(NULL AS DOUBLE) AS no_value,
       CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS rare_flag,
       CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS some_flag,
       o_custkey AS custkey_copy, o_totalprice AS price_copy, o_orderpriority AS priority_copy,
       CASE WHEN o_orderkey = 17 THEN 'changed' ELSE o_orderpriority END AS priority_nearly
FROM orders"""
_ODD = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE",
    "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR", "one_value": "VARCHAR", "no_value": "DOUBLE",
    "rare_flag": "INTEGER", "some_flag": "INTEGER", "custkey_copy": "BIGINT", "price_copy": "DOUBLE",
    "priority_copy": "VARCHAR", "priority_nearly": "VARCHAR",
}


def odd_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr(
        "*", "'fixed' AS one_value", "CAST(NULL AS DOUBLE) AS no_value",
        "CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS rare_flag",
        "CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS some_flag",
        "o_custkey AS custkey_copy", "o_totalprice AS price_copy", "o_orderpriority AS priority_copy",
        "CASE WHEN o_orderkey = 17 THEN 'changed' ELSE o_orderpriority END AS priority_nearly",
    )


@query("constant_columns", f"""
WITH t AS ({ODD_ORDERS_SQL}), facts AS ({facts_sql('t', _ODD)})
SELECT column_name, distinct_count, distinct_count <= 1 AS is_constant FROM facts""")
def constant_columns(spark, sf_dir):
    return column_facts(odd_orders(spark, sf_dir)).select(
        "column_name", "distinct_count", detect.constant_rule().alias("is_constant")
    )


_TOP_N = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COALESCE((SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})), 0) AS top_n"
    for c in _ODD
)


@query("quasi_constant_columns", f"""
WITH t AS ({ODD_ORDERS_SQL}), top AS ({_TOP_N})
SELECT column_name, top_n, top_n::DOUBLE / (SELECT COUNT(*) FROM t) >= 0.98 AS is_quasi_constant FROM top""")
def quasi_constant_columns(spark, sf_dir):
    return column_facts(odd_orders(spark, sf_dir)).select(
        "column_name", "top_n", detect.quasi_constant_rule().alias("is_quasi_constant")
    )


def _duplicates_sql(columns: dict[str, str], source: str) -> str:
    names = list(columns)
    parts = [
        f"SELECT '{b}' AS column_name, '{a}' AS duplicate_of, {i} AS rank_no FROM {source} HAVING BOOL_AND({a} IS NOT DISTINCT FROM {b})"
        for i, a in enumerate(names) for b in names[i + 1:] if columns[a] == columns[b]
    ]
    if not parts:
        return "SELECT NULL::VARCHAR AS column_name, NULL::VARCHAR AS duplicate_of WHERE FALSE"
    return ("SELECT column_name, arg_min(duplicate_of, rank_no) AS duplicate_of FROM ("
            + "\nUNION ALL\n".join(parts) + ") GROUP BY column_name")


@query("duplicate_columns", f"WITH t AS ({ODD_ORDERS_SQL}) " + _duplicates_sql(_ODD, "t"))
def duplicate_columns(spark, sf_dir):
    found = detect.duplicate_columns(odd_orders(spark, sf_dir))
    return spark.createDataFrame(list(found.items()), "column_name string, duplicate_of string")


_CARD_TABLES = ("customer", "part", "supplier", "documents", "region")


@query("high_cardinality_columns", f"""
WITH facts AS ({facts_of_sql(_CARD_TABLES)})
SELECT table_name, column_name, distinct_count, {_HIGH} AS is_high_cardinality FROM facts""")
def high_cardinality_columns(spark, sf_dir):
    return facts_of(spark, sf_dir, _CARD_TABLES).select(
        "table_name", "column_name", "distinct_count",
        detect.high_cardinality_rule().alias("is_high_cardinality"),
    )


def _useless_sql(source_sql: str, columns: dict[str, str], target: str) -> str:
    features = {c: t for c, t in columns.items() if c != target}
    top = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, COALESCE((SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})), 0) AS top_n"
        for c in features
    )
    return f"""WITH t AS ({source_sql}), facts AS ({facts_sql('t', features)}), top AS ({top}),
dup AS ({_duplicates_sql(features, 't')}),
r AS (SELECT column_name,
  CASE WHEN top_n::DOUBLE / row_count >= 0.98 THEN 'constant or quasi-constant (>98% same value)'
       WHEN column_name IN (SELECT column_name FROM dup) THEN 'duplicate of another column'
       WHEN {_ID} THEN 'identifier/ID column'
       WHEN {_HIGH} THEN 'high cardinality categorical (' || distinct_count || ' unique values)' END AS reason
  FROM facts JOIN top USING (column_name))
SELECT column_name, reason FROM r WHERE reason IS NOT NULL"""


def _useless(df, target):
    return detect.reasons_table(df, detect.useless_columns(df, target))


@query("useless_columns_customer", _useless_sql("SELECT * FROM customer", TABLES["customer"], "c_mktsegment"))
def useless_columns_customer(spark, sf_dir):
    return _useless(load(spark, sf_dir, "customer"), "c_mktsegment")


@query("useless_columns_part", _useless_sql("SELECT * FROM part", TABLES["part"], "p_retailprice"))
def useless_columns_part(spark, sf_dir):
    return _useless(load(spark, sf_dir, "part"), "p_retailprice")


@query("useless_columns_orders", _useless_sql(ODD_ORDERS_SQL, _ODD, "o_orderstatus"))
def useless_columns_orders(spark, sf_dir):
    return _useless(odd_orders(spark, sf_dir), "o_orderstatus")


@query("eda_exclusions", f"""
WITH t AS ({ODD_ORDERS_SQL}), facts AS ({facts_sql('t', _ODD)}),
r AS (SELECT column_name, CASE WHEN {_ID} THEN 'ID/Identifier column'
        WHEN distinct_count <= 1 THEN 'Constant value (no variance)'
        WHEN {_HIGH} THEN 'High cardinality (' || distinct_count || ' unique values)' END AS reason
      FROM facts WHERE column_name <> 'o_orderstatus')
SELECT column_name, reason FROM r WHERE reason IS NOT NULL""")
def eda_exclusions(spark, sf_dir):
    return detect.eda_exclusions(column_facts(odd_orders(spark, sf_dir)), "o_orderstatus")


_METRIC_TARGETS = ("l_returnflag", "l_linestatus", "l_extendedprice", "l_linenumber")


@query("selection_metric", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), facts AS ({facts_sql('t', {c: TABLES['lineitem'][c] for c in _METRIC_TARGETS})}),
p AS (SELECT column_name, distinct_count, {_D1} AS problem_type FROM facts)
SELECT column_name, problem_type, distinct_count AS class_count,
       problem_type = 'classification' AND distinct_count > 2 AS is_multiclass,
       CASE WHEN problem_type = 'regression' THEN 'r2' WHEN distinct_count > 2 THEN 'accuracy' ELSE 'f1' END AS metric
FROM p""")
def selection_metric(spark, sf_dir):
    kind = detect.problem_type_rule()
    return column_facts(holed_lineitem(spark, sf_dir), _METRIC_TARGETS).select(
        "column_name", kind.alias("problem_type"), F.col("distinct_count").alias("class_count"),
        ((kind == "classification") & (F.col("distinct_count") > 2)).alias("is_multiclass"),
        detect.selection_metric_rule(kind, F.col("distinct_count")).alias("metric"),
    )


@query("time_budget", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, (CASE WHEN COUNT(*) < 1000 THEN 120 WHEN COUNT(*) < 10000 THEN 300 "
    f"WHEN COUNT(*) < 50000 THEN 600 ELSE 1200 END)::INTEGER AS budget_s FROM {t}" for t in ALL))
def time_budget(spark, sf_dir):
    return union_all([
        load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count", detect.time_budget(F.col("row_count")).alias("budget_s"))
        for t in ALL
    ])


def _wide_orders() -> tuple[dict[str, str], list[str]]:
    """Columns of a widened orders table: every column twelve times, each with gaps of its own."""
    columns, selects = {}, []
    for k in range(12):
        for c, kind in TABLES["orders"].items():
            value = f"concat({c}, '{k}')" if kind == "VARCHAR" else f"{c} + INTERVAL {k} DAY" if kind == "TIMESTAMP" else f"{c} + {k}"
            columns[f"{c}_{k}"] = kind
            selects.append(f"CASE WHEN o_orderkey % {k + 2} > 0 THEN {value} END AS {c}_{k}")
    return columns, selects


_WIDE, _WIDE_SELECTS = _wide_orders()


@query("facts_wide_orders", f"""
WITH t AS (SELECT {", ".join(_WIDE_SELECTS)} FROM orders), facts AS ({facts_sql('t', _WIDE)})
SELECT column_name, column_type, row_count, non_null, distinct_count, ROUND(min_value, 4) AS min_value, ROUND(max_value, 4) AS max_value,
       integer_like, ROUND(code_share, 6) AS code_share FROM facts""")
def facts_wide_orders(spark, sf_dir):
    facts = column_facts(load(spark, sf_dir, "orders").selectExpr(*_WIDE_SELECTS))
    share = F.coalesce(F.try_divide("code_rows", "non_null"), F.lit(0.0))
    return facts.select(
        "column_name", "column_type", "row_count", "non_null", "distinct_count", F.round("min_value", 4).alias("min_value"),
        F.round("max_value", 4).alias("max_value"), "integer_like", F.round(share, 6).alias("code_share"),
    )
