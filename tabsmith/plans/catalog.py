"""Registry of queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Columns of the given tables (name -> DuckDB type), used to write per-column SQL.
TABLES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "INTEGER", "r_name": "VARCHAR"},
    "nation": {"n_nationkey": "INTEGER", "n_name": "VARCHAR", "n_regionkey": "INTEGER"},
    "customer": {
        "c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INTEGER",
        "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR",
    },
    "supplier": {
        "s_suppkey": "BIGINT", "s_name": "VARCHAR", "s_nationkey": "INTEGER", "s_acctbal": "DOUBLE",
    },
    "part": {
        "p_partkey": "BIGINT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR",
        "p_size": "INTEGER", "p_retailprice": "DOUBLE",
    },
    "orders": {
        "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR",
        "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR",
    },
    "lineitem": {
        "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT",
        "l_linenumber": "INTEGER", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE",
        "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_returnflag": "VARCHAR",
        "l_linestatus": "VARCHAR", "l_shipdate": "TIMESTAMP",
    },
    "events": {
        "event_id": "BIGINT", "ts": "TIMESTAMP", "user_id": "BIGINT", "event_type": "VARCHAR",
        "value": "DOUBLE", "props": "VARCHAR",
    },
    "documents": {
        "doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR",
        "n_chars": "BIGINT",
    },
    "labels": {"doc_id": "BIGINT", "quality": "INTEGER", "toxic": "INTEGER"},
    "pages": {"page_id": "BIGINT", "url": "VARCHAR", "html": "VARCHAR"},
    "benchmark": {"item_id": "BIGINT", "text": "VARCHAR"},
    "conversations": {
        "conv_id": "BIGINT", "turn": "BIGINT", "role": "VARCHAR", "text": "VARCHAR",
    },
}

_NUMBER = {"INTEGER", "BIGINT", "DOUBLE"}


def coarse(sql_type: str) -> str:
    if sql_type in _NUMBER:
        return "numeric"
    return "datetime" if sql_type == "TIMESTAMP" else "categorical"


def numeric_of(table: str) -> list[str]:
    return [c for c, t in TABLES[table].items() if t in _NUMBER]


def text_of(table: str) -> list[str]:
    return [c for c, t in TABLES[table].items() if t == "VARCHAR"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL statement where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def facts_sql(source: str, columns: dict[str, str], table_label: str | None = None) -> str:
    """Per-column facts of ``source`` as UNION ALL, one SELECT per column."""
    parts = []
    for i, (c, t) in enumerate(columns.items()):
        number = t in _NUMBER
        label = f"'{table_label}' AS table_name, " if table_label else ""
        parts.append(
            f"SELECT {label}'{c}' AS column_name, {i} AS position, '{coarse(t)}' AS column_type, "
            f"'{t}' AS sql_type, COUNT(*) AS row_count, COUNT({c}) AS non_null, "
            f"COUNT(DISTINCT {c}) AS distinct_count, "
            + (f"MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, "
               f"COALESCE(BOOL_AND({c} = FLOOR({c})), TRUE) AS integer_like, 0.0::DOUBLE AS code_share "
               if number else
               "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, FALSE AS integer_like, "
               + (f"COALESCE(AVG(CASE WHEN regexp_matches({c}, '^[A-Za-z0-9\\-_]+$') THEN 1.0 ELSE 0.0 END)"
                  f" FILTER (WHERE {c} IS NOT NULL), 0.0)::DOUBLE AS code_share "
                  if t == "VARCHAR" else "0.0::DOUBLE AS code_share "))
            + f"FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)
