"""Registration and the inputs both sides share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet", spread=name in _TEXT_TABLES)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded: sums depend on their order in the last bits."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


def sql_score(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {sql_text(w)}) AS INT)" for w in words) + ")"


def sql_first(text: str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> str:
    arms = " ".join(f"WHEN {sql_any(text, words)} THEN {sql_text(label)}" for label, words in rules)
    return f"CASE {arms} ELSE {sql_text(default)} END"


# Questions spread over the conversation table: the invented words of its own text match no rule.
QUESTIONS = (
    "Compute the total freight of late shipments per nation",
    "Rank suppliers by returned parts, worst first",
    "Which brands do urgent orders hold",
    "Why does the rebate influence returns so strongly",
    "Is the spread of order prices seasonal in any region",
    "Forecast demand for steel fittings next year",
    "Discover hidden clusters among clerks",
    "Has the share of air freight moved over time",
    "Ship it",
)
_CASE = "CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUESTIONS)) + " END"
QUESTION_SQL = f"SELECT conv_id, turn, role, {_CASE} AS question, text FROM conversations"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", f"{_CASE} AS question", "text"
    )


# The same expression on both sides: no column of the tables is ever NULL.
GAPPY_LINEITEM = (
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "l_discount",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
)
GAPPY_LINEITEM_SQL = "SELECT " + ", ".join(GAPPY_LINEITEM) + " FROM lineitem"
GAPPY_PART = (
    "p_partkey",
    "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand",
    "p_size",
)
GAPPY_PART_SQL = "SELECT " + ", ".join(GAPPY_PART) + " FROM part"
GAPPY_ORDERS = (
    "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate",
)
GAPPY_ORDERS_SQL = "SELECT " + ", ".join(GAPPY_ORDERS) + " FROM orders"


def gappy_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*GAPPY_LINEITEM)


def gappy_part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*GAPPY_PART)


def gappy_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*GAPPY_ORDERS)
