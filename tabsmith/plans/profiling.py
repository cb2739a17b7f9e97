"""Profile and exploratory-analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.schema import numeric_columns, schema_table
from tabsmith.operators import gram, increments, profile, report
from tabsmith.operators.detect import eda_exclusions, problem_type
from tabsmith.operators.facts import column_facts
from tabsmith.plans.catalog import TABLES, facts_sql, load, numeric_of, query, text_of
from tabsmith.session import scratch_path

# The given tables hold no missing values; this rule blanks some, in the query and in the SQL.
HOLED_LINEITEM_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
       l_tax,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate
FROM lineitem"""

HOLED_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


def blank(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Blank a column where its SQL condition holds."""
    return df.withColumns({c: F.when(~F.expr(cond), F.col(c)) for c, cond in rules.items()})


def holed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank(
        load(spark, sf_dir, "lineitem"),
        {"l_quantity": "l_orderkey % 7 = 0", "l_discount": "l_partkey % 5 = 0",
         "l_returnflag": "l_orderkey % 11 = 0"},
    )


def holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank(
        load(spark, sf_dir, "orders"),
        {"o_totalprice": "o_orderkey % 7 = 0", "o_orderpriority": "o_orderkey % 5 = 0"},
    )


STATS_SQL = """SELECT column_name, column_type, distinct_count AS unique_count,
       row_count - non_null AS missing,
       CASE WHEN row_count > 0 THEN ROUND((row_count - non_null)::DOUBLE / row_count * 100, 2) ELSE 0.0 END AS missing_pct,
       row_count
FROM facts"""


def _stats(df: DataFrame) -> DataFrame:
    return profile.column_stats(df).drop("position")


@query("column_stats_lineitem",
       f"WITH t AS ({HOLED_LINEITEM_SQL}), facts AS ({facts_sql('t', TABLES['lineitem'])}) {STATS_SQL}")
def column_stats_lineitem(spark, sf_dir):
    return _stats(holed_lineitem(spark, sf_dir))


@query("column_stats_orders",
       f"WITH t AS ({HOLED_ORDERS_SQL}), facts AS ({facts_sql('t', TABLES['orders'])}) {STATS_SQL}")
def column_stats_orders(spark, sf_dir):
    return _stats(holed_orders(spark, sf_dir))


@query("column_stats_events", f"WITH facts AS ({facts_sql('events', TABLES['events'])}) {STATS_SQL}")
def column_stats_events(spark, sf_dir):
    return _stats(load(spark, sf_dir, "events"))


@query("column_stats_documents", f"WITH facts AS ({facts_sql('documents', TABLES['documents'])}) {STATS_SQL}")
def column_stats_documents(spark, sf_dir):
    return _stats(load(spark, sf_dir, "documents"))


def _bytes_sql(table: str) -> str:
    width = {"INTEGER": "4", "BIGINT": "8", "DOUBLE": "8", "TIMESTAMP": "8"}
    terms = [
        f"COALESCE(strlen({c}), 0)" if t == "VARCHAR" else width[t] for c, t in TABLES[table].items()
    ]
    return f"SUM({' + '.join(terms)})"


@query("dataset_overview", f"""
SELECT COUNT(*) AS row_count, {len(TABLES['lineitem'])} AS column_count,
       {len(numeric_of('lineitem'))} AS numeric_count, {len(text_of('lineitem'))} AS categorical_count,
       'l_returnflag' AS target_column, 'classification' AS problem_type,
       ROUND({_bytes_sql('lineitem')}::DOUBLE / 1048576.0, 4) AS memory_mb
FROM lineitem""")
def dataset_overview(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return profile.dataset_overview(df, "l_returnflag", problem_type(df, "l_returnflag"))


def _badges(table: str) -> str:
    names = ", ".join(f"'{c}'" for c in numeric_of(table))
    return f"CASE WHEN column_name IN ({names}) THEN 'numeric' ELSE 'categorical' END"


_SAMPLES_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, string_agg(v, ', ' ORDER BY k, v) AS samples FROM
    (SELECT o_orderkey AS k, substring(CAST({c} AS VARCHAR), 1, 20) AS v FROM t WHERE {c} IS NOT NULL ORDER BY k, v LIMIT 3)"""
    for c in TABLES["orders"]
)


@query("eda_column_info", f"""
WITH t AS ({HOLED_ORDERS_SQL}), facts AS ({facts_sql('t', TABLES['orders'])}), samples AS ({_SAMPLES_SQL})
SELECT column_name, {_badges('orders')} AS badge,
       ROUND((row_count - non_null)::DOUBLE / row_count * 100, 4) AS missing_pct,
       (row_count - non_null)::DOUBLE / row_count * 100 > 5 AS missing_flag,
       distinct_count AS unique_count, samples,
       column_name = 'o_orderkey' AS excluded
FROM facts JOIN samples USING (column_name)""")
def eda_column_info(spark, sf_dir):
    df = holed_orders(spark, sf_dir)
    facts = column_facts(df)
    excluded = [r["column_name"] for r in eda_exclusions(facts, "o_orderstatus").collect()]
    return profile.eda_column_info(df, ["o_orderkey"], excluded, facts)


@query("type_distribution", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), facts AS ({facts_sql('t', TABLES['lineitem'])})
SELECT column_type, COUNT(*) AS column_count,
       ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM facts), 2) AS share_pct,
       COUNT(*) FILTER (WHERE non_null < row_count) AS with_missing
FROM facts GROUP BY column_type""")
def type_distribution(spark, sf_dir):
    return profile.type_distribution(profile.column_stats(holed_lineitem(spark, sf_dir)))


@query("missing_list", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), facts AS ({facts_sql('t', TABLES['lineitem'])}),
holed AS (SELECT * FROM facts WHERE non_null < row_count)
SELECT column_name, ROUND((row_count - non_null)::DOUBLE / row_count * 100, 2) AS missing_pct,
       (SELECT GREATEST(COUNT(*) - 5, 0) FROM holed) AS more_columns
FROM holed ORDER BY position LIMIT 5""")
def missing_list(spark, sf_dir):
    return profile.missing_list(profile.column_stats(holed_lineitem(spark, sf_dir)))


@query("cardinality_hint", f"""
WITH facts AS ({facts_sql('part', TABLES['part'])})
SELECT column_name, distinct_count AS unique_count,
       ROUND(distinct_count::DOUBLE / row_count * 100, 2) AS unique_pct,
       CASE WHEN distinct_count <= 10 THEN 'low'
            WHEN distinct_count::DOUBLE / row_count < 0.05 THEN 'moderate' ELSE 'high' END AS hint
FROM facts""")
def cardinality_hint(spark, sf_dir):
    return profile.cardinality_hint(profile.column_stats(load(spark, sf_dir, "part")))


def _summary_sql(source: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, "
        f"ROUND(MIN({c})::DOUBLE, 4) AS min, ROUND(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, "
        f"ROUND(MAX({c})::DOUBLE, 4) AS max FROM {source}"
        for c in columns
    )


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name
        for f in df.schema.fields
    ])


@query("numeric_summary",
       f"WITH t AS ({HOLED_LINEITEM_SQL}) "
       + _summary_sql("t", [c for c in numeric_of("lineitem") if c != "l_extendedprice"]))
def numeric_summary(spark, sf_dir):
    return _rounded(profile.numeric_summary(holed_lineitem(spark, sf_dir), target="l_extendedprice"))


DESCRIBE_SQL = """SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean,
       ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c})::DOUBLE, 4) AS min,
       ROUND(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, ROUND(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
       ROUND(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, ROUND(MAX({c})::DOUBLE, 4) AS max FROM {t}"""


@query("describe_target", DESCRIBE_SQL.format(c="l_extendedprice", t="lineitem"))
def describe_target(spark, sf_dir):
    return _rounded(profile.describe(load(spark, sf_dir, "lineitem"), ["l_extendedprice"]))


@query("skewness_flag", """
SELECT 'value' AS column_name, ROUND(skewness(value), 4) AS skew, ABS(skewness(value)) > 1 AS highly_skewed
FROM events""")
def skewness_flag(spark, sf_dir):
    return _rounded(profile.skewness_flag(load(spark, sf_dir, "events"), "value"))


def _histogram_sql(source: str, columns: list[str], bins: int) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT * FROM (
WITH e AS (SELECT CASE WHEN MIN({c}) = MAX({c}) THEN MIN({c})::DOUBLE - 0.5 ELSE MIN({c})::DOUBLE END AS lo,
                  CASE WHEN MIN({c}) = MAX({c}) THEN MAX({c})::DOUBLE + 0.5 ELSE MAX({c})::DOUBLE END AS hi FROM {source}),
r AS (SELECT {c}::DOUBLE AS v, lo, hi, (hi - lo) / {bins} AS step,
             LEAST(FLOOR(({c}::DOUBLE - lo) * ({bins} / (hi - lo))), {bins - 1}) AS i FROM {source}, e WHERE {c} IS NOT NULL),
b AS (SELECT (i - (CASE WHEN v < lo + i * step THEN 1 ELSE 0 END)
              + (CASE WHEN v >= lo + (i + 1) * step AND i <> {bins - 1} THEN 1 ELSE 0 END) + 1)::INTEGER AS bin,
             COUNT(*) AS n FROM r GROUP BY 1),
g AS (SELECT UNNEST(range(1, {bins + 1}))::INTEGER AS bin)
SELECT '{c}' AS column_name, g.bin AS bin, ROUND(lo + (g.bin - 1) * ((hi - lo) / {bins}), 4) AS lower_edge,
       ROUND(CASE WHEN g.bin = {bins} THEN hi ELSE lo + g.bin * ((hi - lo) / {bins}) END, 4) AS upper_edge,
       COALESCE(b.n, 0)::BIGINT AS n,
       GREATEST(FLOOR(COALESCE(b.n, 0)::DOUBLE / (SELECT MAX(n) FROM b) * 40), 2)::INTEGER AS bar_height
FROM g CROSS JOIN e LEFT JOIN b ON g.bin = b.bin)""")
    return "\nUNION ALL\n".join(parts)


@query("histogram_target", _histogram_sql("lineitem", ["l_extendedprice"], 20))
def histogram_target(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return _rounded(profile.histogram(df, ["l_extendedprice"], profile.TARGET_BINS))


@query("histogram_features",
       f"WITH t AS ({HOLED_LINEITEM_SQL}) " + _histogram_sql("t", numeric_of("lineitem"), 15))
def histogram_features(spark, sf_dir):
    df = holed_lineitem(spark, sf_dir)
    return _rounded(profile.histogram(df, numeric_columns(df), profile.FEATURE_BINS))


CLASS_SQL = """SELECT CAST({c} AS VARCHAR) AS class, COUNT(*) AS n,
       ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM {t}) * 100, 4) AS pct
FROM {t} WHERE {c} IS NOT NULL GROUP BY 1"""


@query("class_distribution", f"WITH t AS ({HOLED_LINEITEM_SQL}) " + CLASS_SQL.format(c="l_returnflag", t="t"))
def class_distribution(spark, sf_dir):
    return profile.class_distribution(holed_lineitem(spark, sf_dir), "l_returnflag")


@query("class_imbalance", """
WITH s AS (SELECT l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT COUNT(*) AS class_count, MAX(n) AS largest, MIN(n) AS smallest,
       ROUND(MAX(n)::DOUBLE / MIN(n), 4) AS imbalance_ratio,
       CASE WHEN MAX(n)::DOUBLE / MIN(n) > 3 THEN 'imbalanced'
            WHEN MAX(n)::DOUBLE / MIN(n) > 1.5 THEN 'slight' ELSE 'balanced' END AS severity
FROM s""")
def class_imbalance(spark, sf_dir):
    return profile.class_imbalance(load(spark, sf_dir, "lineitem"), "l_linenumber")


def _top_sql(source: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT * FROM (WITH g AS (SELECT {c} AS value, COUNT(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) "
        f"SELECT '{c}' AS column_name, substring(value, 1, 30) AS value, n, "
        f"ROUND(n::DOUBLE / (SELECT COUNT(*) FROM {source}) * 100, 4) AS pct, "
        f"(SELECT COUNT(*) FROM g) AS unique_count, GREATEST((SELECT COUNT(*) FROM g) - 5, 0) AS more_values "
        f"FROM g ORDER BY n DESC, g.value LIMIT 5)"
        for c in columns
    )


@query("categorical_summary", _top_sql("part", text_of("part")))
def categorical_summary(spark, sf_dir):
    return profile.categorical_summary(load(spark, sf_dir, "part"))


@query("categorical_summary_documents", _top_sql("documents", text_of("documents")))
def categorical_summary_documents(spark, sf_dir):
    return profile.categorical_summary(load(spark, sf_dir, "documents"))


# corr over the blanked columns is pairwise complete in both engines
def _corr_sql(source: str, a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"(SELECT CASE WHEN MIN({a}) < MAX({a}) AND MIN({b}) < MAX({b}) THEN corr({a}, {b}) END "
            f"FROM {source} WHERE {both})")


_STRENGTH = """CASE WHEN correlation > 0.5 THEN 'Strong Positive' WHEN correlation > 0.3 THEN 'Moderate Positive'
     WHEN correlation < -0.5 THEN 'Strong Negative' WHEN correlation < -0.3 THEN 'Moderate Negative' ELSE 'Weak' END"""


@query("target_correlation", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), c AS ("""
       + "\nUNION ALL\n".join(
           f"SELECT '{c}' AS feature, {_corr_sql('t', c, 'l_extendedprice')} AS correlation"
           for c in numeric_of("lineitem") if c != "l_extendedprice")
       + f""") SELECT feature, ROUND(correlation, 6) AS correlation, {_STRENGTH} AS strength
FROM c ORDER BY ABS(c.correlation) DESC NULLS LAST, feature LIMIT 10""")
def target_correlation(spark, sf_dir):
    return _rounded(profile.target_correlation(holed_lineitem(spark, sf_dir), "l_extendedprice"), 6)


@query("correlation_matrix", f"WITH t AS ({HOLED_LINEITEM_SQL}) "
       + "\nUNION ALL\n".join(
           f"SELECT '{a}' AS left_column, '{b}' AS right_column, ROUND({_corr_sql('t', a, b)}, 6) AS correlation"
           for a in numeric_of("lineitem") for b in numeric_of("lineitem")))
def correlation_matrix(spark, sf_dir):
    return _rounded(profile.correlation_matrix(holed_lineitem(spark, sf_dir)), 6)


_WIDE_TWINS = {f"{c}_twin": f"{c} * {c} - l_tax" for c in ("l_quantity", "l_discount", "l_extendedprice", "l_linenumber")}
_WIDE_SQL = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in _WIDE_TWINS.items())} FROM ({HOLED_LINEITEM_SQL})"
_WIDE = [*numeric_of("lineitem"), *_WIDE_TWINS]


@query("correlation_blocks", f"WITH t AS ({_WIDE_SQL}) "
       + "\nUNION ALL\n".join(
           f"SELECT '{a}' AS left_column, '{b}' AS right_column, ROUND({_corr_sql('t', a, b)}, 6) AS correlation"
           for a in _WIDE for b in _WIDE))
def correlation_blocks(spark, sf_dir):
    """The matrix from products of column blocks, here five columns wide so that blocks meet each other."""
    df = holed_lineitem(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _WIDE_TWINS.items()})
    return _rounded(gram.correlation_matrix(df, _WIDE, block=5), 6)


@query("eda_warnings", f"""
WITH t AS ({HOLED_LINEITEM_SQL}), facts AS ({facts_sql('t', TABLES['lineitem'])})
SELECT COUNT(*) FILTER (WHERE non_null < row_count) AS columns_with_missing FROM facts""")
def eda_warnings(spark, sf_dir):
    return profile.missing_warning(column_facts(holed_lineitem(spark, sf_dir)))


@query("numeric_stats", f"WITH t AS ({HOLED_LINEITEM_SQL}) "
       + "\nUNION ALL\n".join(
           f"SELECT '{c}' AS column_name, MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, "
           f"BOOL_AND({c} = FLOOR({c})) AS is_integer FROM t" for c in numeric_of("lineitem")))
def numeric_stats(spark, sf_dir):
    df = holed_lineitem(spark, sf_dir)
    return profile.numeric_stats(df, numeric_columns(df))


@query("column_types", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {i} AS position, "
    f"'{'numeric' if t in ('INTEGER', 'BIGINT', 'DOUBLE') else 'datetime' if t == 'TIMESTAMP' else 'categorical'}' AS column_type, "
    f"'{'numeric' if t in ('INTEGER', 'BIGINT', 'DOUBLE') else 'categorical'}' AS badge, COUNT(*) AS row_count FROM orders"
    for i, (c, t) in enumerate(TABLES["orders"].items())))
def column_types(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return schema_table(spark, df).withColumn("row_count", profile.row_total(df))


_MINI_SQL = f"""
SELECT 'shape' AS section, 'dataset' AS item, 'rows' AS metric, COUNT(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM t
UNION ALL SELECT 'shape', 'dataset', 'columns', {len(TABLES['orders'])}::DOUBLE, NULL
UNION ALL SELECT 'columns', column_name, 'dtype', NULL, column_type FROM facts
UNION ALL SELECT 'columns', column_name, 'missing_pct', ROUND((row_count - non_null)::DOUBLE / row_count * 100, 4), NULL FROM facts
UNION ALL SELECT 'columns', column_name, 'unique', distinct_count::DOUBLE, NULL FROM facts
UNION ALL SELECT 'describe', column_name, m, ROUND(v, 4), NULL FROM (
  UNPIVOT (SELECT column_name, count::DOUBLE AS count, mean, std, min, p25, p50, p75, max FROM d)
  ON count, mean, std, min, p25, p50, p75, max INTO NAME m VALUE v)"""


@query("eda_minimal", f"""
WITH t AS ({HOLED_ORDERS_SQL}), facts AS ({facts_sql('t', TABLES['orders'])}),
d AS ({" UNION ALL ".join(DESCRIBE_SQL.format(c=c, t='t') for c in numeric_of('orders'))})
{_MINI_SQL}""")
def eda_minimal(spark, sf_dir):
    return report.eda_minimal(holed_orders(spark, sf_dir))


_REPORT_NUMERIC = [c for c in numeric_of("orders")]
_EDA_REPORT_SQL = f"""
WITH t AS ({HOLED_ORDERS_SQL}), facts AS ({facts_sql('t', TABLES['orders'])}),
cls AS ({CLASS_SQL.format(c='o_orderstatus', t='t')}),
imb AS (SELECT ROUND(MAX(n)::DOUBLE / MIN(n), 4) AS r FROM cls),
num AS ({_summary_sql('t', _REPORT_NUMERIC)}),
cat AS ({_top_sql('t', ['o_orderstatus', 'o_orderpriority'])})
SELECT 'overview' AS section, 'dataset' AS item, 'rows' AS metric, COUNT(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM t
UNION ALL SELECT 'overview', 'dataset', 'columns', 6.0, NULL
UNION ALL SELECT 'overview', 'dataset', 'numeric', 3.0, NULL
UNION ALL SELECT 'overview', 'dataset', 'categorical', 2.0, NULL
UNION ALL SELECT 'overview', 'dataset', 'target', NULL, 'o_orderstatus'
UNION ALL SELECT 'overview', 'dataset', 'problem_type', NULL, 'classification'
UNION ALL SELECT 'overview', 'dataset', 'memory_mb', ROUND({_bytes_sql('orders')}::DOUBLE / 1048576.0, 4), NULL FROM t
UNION ALL SELECT 'target', class, 'count', n::DOUBLE, NULL FROM cls
UNION ALL SELECT 'target', class, 'pct', pct, NULL FROM cls
UNION ALL SELECT 'target', 'o_orderstatus', 'imbalance_ratio', r, CASE WHEN r > 3 THEN 'imbalanced' WHEN r > 1.5 THEN 'slight' ELSE 'balanced' END FROM imb
UNION ALL SELECT 'notes', 'o_orderkey', 'excluded', NULL, 'ID/Identifier column'
UNION ALL SELECT 'notes', 'dataset', 'columns_with_missing', COUNT(*)::DOUBLE, NULL FROM facts WHERE non_null < row_count
UNION ALL SELECT 'columns', column_name, 'unique', distinct_count::DOUBLE, {_badges('orders')} FROM facts
UNION ALL SELECT 'columns', column_name, 'missing_pct', ROUND((row_count - non_null)::DOUBLE / row_count * 100, 4), NULL FROM facts
UNION ALL SELECT 'categorical', column_name, 'count', n::DOUBLE, value FROM cat
UNION ALL SELECT 'numeric', column_name, m, v, NULL FROM (
  UNPIVOT (SELECT column_name, mean, std, min, median, max FROM num) ON mean, std, min, median, max INTO NAME m VALUE v)"""


@query("eda_report", _EDA_REPORT_SQL)
def eda_report(spark, sf_dir):
    return report.eda_report(holed_orders(spark, sf_dir), "o_orderstatus")


_INCREMENT_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("incremental_profile", f"""
WITH t AS ({HOLED_ORDERS_SQL}), facts AS ({facts_sql('t', TABLES['orders'])}),
numbers AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM t"
    for c in _INCREMENT_NUMBERS)})
SELECT f.column_name, f.column_type, f.row_count, f.row_count - f.non_null AS missing,
       ROUND((f.row_count - f.non_null)::DOUBLE / f.row_count * 100, 2) AS missing_pct,
       ROUND(n.mean, 3) AS mean, ROUND(n.std, 3) AS std, n.lo AS min_value, n.hi AS max_value,
       TRUE AS distinct_within_error,
       CASE WHEN f.column_type = 'numeric' THEN TRUE END AS quartiles_within_error,
       TRUE AS only_new_files_read
FROM facts f LEFT JOIN numbers n USING (column_name)""")
def incremental_profile(spark, sf_dir):
    """Orders arriving as three loads, each sketched when it comes; the merged profile against the exact one."""
    data, store = scratch_path(spark, "orders-loads"), scratch_path(spark, "orders-profile")
    orders = holed_orders(spark, sf_dir)
    seen, fresh = set(), True
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.parquet(f"{data}/load={part}")
        taken = increments.update_profile(spark, store, data)
        fresh = fresh and bool(taken) and not seen & set(taken)
        seen |= set(taken)
    fresh = fresh and increments.update_profile(spark, store, data) == []
    merged = increments.current_profile(spark, store).cache()
    described = increments.approximate_describe(merged)
    close = []
    for row in described.collect():
        bounds = increments.rank_bounds(orders, row["column_name"], [row["p25"], row["p50"], row["p75"]])
        slack = increments.RANK_ERROR
        ok = all(lo - slack <= q <= hi + slack for q, (lo, hi) in zip(increments.QUARTILES, bounds))
        close.append((row["column_name"], row["mean"], row["std"], row["min"], row["max"], ok))
    numbers = spark.createDataFrame(
        close, "column_name string, mean double, std double, min_value double, max_value double, quartiles_within_error boolean")
    exact = column_facts(orders).select("column_name", "distinct_count")
    apart = F.abs(F.col("unique_count") - F.col("distinct_count"))
    return (
        increments.approximate_stats(merged).join(exact, "column_name").join(numbers, "column_name", "left")
        .select(
            "column_name", "column_type", "row_count", "missing", "missing_pct", F.round("mean", 3).alias("mean"),
            F.round("std", 3).alias("std"), "min_value", "max_value",
            (apart <= F.greatest(F.lit(1.0), F.col("distinct_count") * increments.DISTINCT_ERROR)).alias("distinct_within_error"),
            "quartiles_within_error", F.lit(fresh).alias("only_new_files_read"),
        )
    )
