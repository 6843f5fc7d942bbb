"""Column kinds and selection (C)."""

from pyspark.sql import functions as F

from queries.common import QUESTION_SQL, questions, query, rounded, sql_any, table, union_sql
from tabulens.functions import rules
from tabulens.operators.profile import profile_dataset
from tabulens.operators.schema import column_kinds, dtype_counts, match_columns, mixed_samples, numeric_ratio, time_columns
from tabulens.operators.stats import compare_groups

_ORDERS_KINDS = [
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "temporal"),
    ("o_orderpriority", "string", "categorical"),
]


def _kinds_sql(rows, source):
    return union_sql(
        [
            f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, '{k}' AS kind,
            {str(any(h in c for h in rules.KEY_INDICATOR_HINTS)).lower()} AS key_indicator, count({c}) AS non_null FROM {source}"""
            for i, (c, t, k) in enumerate(rows)
        ]
    )


@query("c01_column_kinds", _kinds_sql(_ORDERS_KINDS, "orders"))
def c01(spark, sf):
    return column_kinds(table(spark, sf, "orders"))


@query(
    "c02_dtype_counts",
    """
    SELECT 'bigint' AS dtype, CAST(3 AS BIGINT) AS n_columns, CAST(3 * count(*) AS BIGINT) AS non_null FROM lineitem
    UNION ALL SELECT 'int', 1, count(*) FROM lineitem
    UNION ALL SELECT 'double', 4, 4 * count(*) FROM lineitem
    UNION ALL SELECT 'string', 2, 2 * count(*) FROM lineitem
    UNION ALL SELECT 'timestamp_ntz', 1, count(*) FROM lineitem
    """,
)
def c02(spark, sf):
    return dtype_counts(table(spark, sf, "lineitem"))


_AS_TEXT = (
    "CASE WHEN o_orderkey % 3 = 0 THEN concat('n/a ', o_orderstatus) ELSE CAST(o_custkey AS STRING) END AS mixed",
    "CAST(o_custkey AS STRING) AS customer",
    "o_orderpriority AS priority",
)
_AS_TEXT_SQL = "SELECT " + ", ".join(_AS_TEXT).replace("STRING", "VARCHAR") + " FROM orders"
_RATIO = "avg(CAST(TRY_CAST({c} AS DOUBLE) IS NOT NULL AS INT))"


@query(
    "c03_numeric_ratio",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", round({_RATIO.format(c=c)}, 6) AS ratio,
            CASE WHEN {_RATIO.format(c=c)} > 0.8 THEN 'numeric' WHEN {_RATIO.format(c=c)} > 0.3 THEN 'mixed' ELSE 'categorical' END AS kind
            FROM ({_AS_TEXT_SQL})"""
            for c in ("mixed", "customer", "priority")
        ]
    ),
)
def c03(spark, sf):
    return rounded(numeric_ratio(table(spark, sf, "orders").selectExpr(*_AS_TEXT)), 6)


@query(
    "c03_mixed_samples",
    f"""
    SELECT 'mixed' AS "column", kind AS sample_kind, value FROM (
      SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS rank FROM (
        SELECT DISTINCT mixed AS value, CASE WHEN TRY_CAST(mixed AS DOUBLE) IS NULL THEN 'text' ELSE 'number' END AS kind
        FROM ({_AS_TEXT_SQL}))) WHERE rank <= 2
    """,
)
def c03_samples(spark, sf):
    return mixed_samples(table(spark, sf, "orders").selectExpr(*_AS_TEXT), ["mixed"]).select("column", "sample_kind", "value")


@query(
    "c04_time_columns",
    """
    SELECT 'o_orderdate' AS "column", true AS by_name, false AS by_value
    UNION ALL
    SELECT 'placed', false, min(year(o_orderdate)) >= 1900 AND max(year(o_orderdate)) <= 2030 FROM orders
    """,
)
def c04(spark, sf):
    orders = table(spark, sf, "orders")
    return time_columns(orders.withColumn("placed", F.year("o_orderdate")))


_NUMERIC = ("c_custkey", "c_nationkey", "c_acctbal")
_CATEGORICAL = ("c_name", "c_mktsegment")
_EVERY = (*_NUMERIC, *_CATEGORICAL)


def _match_sql():
    q = "lower(question)"
    words = f"[w FOR w IN regexp_split_to_array({q}, '\\s+') IF w <> '']"
    every = "[" + ", ".join(f"'{c}'" for c in _EVERY) + "]"
    named = f"[c FOR c IN {every} IF contains({q}, c) OR list_bool_or([contains(c, w) FOR w IN {words}])]"
    by_rule = {
        "compare": "'c_name,c_custkey'", "correlation": "'c_custkey,c_nationkey,c_acctbal'",
        "distribution": "'c_custkey,c_nationkey'", "aggregate": "'c_custkey,c_nationkey'",
    }
    arms = " ".join(f"WHEN {sql_any(q, words)} THEN {by_rule[k]}" for k, words in rules.QUESTION_COLUMN_RULES)
    return f"""
    SELECT conv_id, turn, question,
      CASE WHEN len({named}) > 0 THEN array_to_string(list_slice({named}, 1, 4), ',')
           ELSE CASE {arms} ELSE 'c_name,c_custkey,c_nationkey' END END AS columns
    FROM ({QUESTION_SQL})"""


@query("c05_match_columns", _match_sql())
def c05(spark, sf):
    out = match_columns(questions(spark, sf), "question", _NUMERIC, _CATEGORICAL, limit=4)
    return out.select("conv_id", "turn", "question", F.array_join("columns", ",").alias("columns"))


@query("c06_drop_column", "SELECT doc_id, lang, source, n_chars FROM documents")
def c06(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").drop("text")


@query(
    "c07_filtered_groups",
    """
    SELECT l_linestatus AS category, round(avg(l_quantity), 4) AS mean, count(l_quantity) AS count,
           round(stddev_samp(l_quantity), 4) AS std
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
    """,
)
def c07(spark, sf):
    return rounded(compare_groups(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity", "l_returnflag = 'R'"))


@query("c08_key_indicators", "SELECT 'p_retailprice' AS \"column\", count(p_retailprice) AS non_null FROM part")
def c08(spark, sf):
    return column_kinds(table(spark, sf, "part")).where("key_indicator").select("column", "non_null")


@query(
    "c09_possible_analyses",
    "SELECT n AS n_rows, unnest(["
    + ", ".join(f"'{a}'" for a in rules.TIME_ANALYSES + rules.NUMERIC_ANALYSES + rules.CATEGORICAL_ANALYSES)
    + "]) AS analysis FROM (SELECT count(*) AS n FROM orders)",
)
def c09(spark, sf):
    return profile_dataset(table(spark, sf, "orders")).select("n_rows", F.explode("analyses").alias("analysis"))
