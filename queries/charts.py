"""Chart-ready frames (V)."""

from pyspark.sql import functions as F

from queries.common import QUESTION_SQL, questions, query, rounded, sql_any, sql_score, table, union_sql
from tabulens.functions import rules
from tabulens.operators import charts as ch

_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "v01_bar_mean",
    "SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) DESC LIMIT 10",
)
def v01(spark, sf):
    return rounded(ch.bar_mean(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 10))


@query("v02_bar_count", "SELECT p_name AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def v02(spark, sf):
    return ch.bar_count(table(spark, sf, "part"), "p_name")


def _histogram_sql(c, t, bins=30):
    return f"""
    WITH m AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
    b AS (SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / {bins})) AS INT) + 1, {bins}) AS bin FROM {t}, m),
    n AS (SELECT bin, count(*) AS count FROM b GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, round(lo + (i - 1) * ((hi - lo) / {bins}), 4) AS low, round(lo + i * ((hi - lo) / {bins}), 4) AS high,
      coalesce(count, 0) AS count FROM (SELECT unnest(range(1, {bins + 1})) AS i), m LEFT JOIN n ON n.bin = i"""


@query("v03_histogram", _histogram_sql("value", "events"))
def v03(spark, sf):
    return rounded(ch.histogram(table(spark, sf, "events"), "value"))


@query("v04_scatter", "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def v04(spark, sf):
    return ch.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "v05_pie",
    """SELECT category, count, round(count / (sum(count) OVER ()), 6) AS share
    FROM (SELECT p_brand AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
)
def v05(spark, sf):
    return rounded(ch.pie(table(spark, sf, "part"), "p_brand"), 6)


@query(
    "v06_box",
    """SELECT l_returnflag AS category, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
    round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max
    FROM lineitem GROUP BY 1""",
)
def v06(spark, sf):
    return rounded(ch.box(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(
    "v07_heatmap",
    union_sql(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, round({f'corr({a}, {b})' if a != b else '1.0'}, 6) + CAST(0 AS DOUBLE) AS r {'FROM lineitem' if a != b else ''}"
            for a in _CORR
            for b in _CORR
        ]
    ),
)
def v07(spark, sf):
    return rounded(ch.heatmap(table(spark, sf, "lineitem"), _CORR), 6)


@query(
    "v08_dashboard",
    f"""
    SELECT 'distribution' AS chart, CAST(bin AS VARCHAR) AS label, CAST(count AS DOUBLE) AS value FROM ({_histogram_sql('o_totalprice', 'orders')})
    UNION ALL SELECT 'comparison', o_orderpriority, round(avg(o_totalprice), 4) FROM orders GROUP BY 2
    UNION ALL SELECT 'relationship', CAST(round(o_totalprice, 4) AS VARCHAR), CAST(o_custkey AS DOUBLE) FROM orders
    UNION ALL SELECT 'summary', 'mean', round(avg(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'summary', 'median', round(median(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'summary', 'std', round(stddev_samp(o_totalprice), 4) FROM orders
    """,
)
def v08(spark, sf):
    parts = ch.dashboard(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", "o_custkey", categories=8)

    def rows(chart, df, label, value):
        return df.select(F.lit(chart).alias("chart"), label.cast("string").alias("label"), value.cast("double").alias("value"))

    out = rows("distribution", parts["distribution"], F.col("bin"), F.col("count"))
    out = out.unionByName(rows("comparison", parts["comparison"], F.col("category"), F.col("mean")))
    points = parts["relationship"]
    out = out.unionByName(rows("relationship", points, F.round("x", 4), F.col("y")))
    summary = parts["summary"].select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in ("mean", "median", "std")])).alias("s")
    )
    return rounded(out.unionByName(rows("summary", summary, F.col("s.m"), F.col("s.v"))))


@query(
    "v09_time_line",
    "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, round(avg(o_totalprice), 4) AS value, count(o_totalprice) AS points FROM orders GROUP BY 1",
)
def v09(spark, sf):
    return rounded(ch.time_line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@query("v09_row_line", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def v09_rows(spark, sf):
    return ch.row_line(table(spark, sf, "orders"), ["o_orderkey"], "o_totalprice")


def _chart_sql():
    s = {name: sql_score("q", words) for name, words in rules.INTENTS_SCORED}
    need = f"""CASE WHEN {sql_any('q', rules.NO_CHART_WORDS)} THEN false
      WHEN st >= an AND st >= de THEN true WHEN an >= de THEN {sql_any('q', rules.PATTERN_WORDS)}
      ELSE {sql_any('q', ('distribution', 'spread'))} END"""
    return f"""
    SELECT conv_id, turn, question, CASE WHEN NOT {need} THEN 'none' WHEN {sql_any('q', rules.LINE_WORDS)} THEN 'line_chart'
      WHEN contains(q, 'distribution') THEN 'bar_chart' WHEN {sql_any('q', rules.RANKING_WORDS)} THEN 'bar_chart'
      WHEN {sql_any('q', rules.RELATION_WORDS)} THEN 'scatter_plot' ELSE 'bar_chart' END AS chart
    FROM (SELECT *, {s['statistical']} AS st, {s['analytical']} AS an, {s['descriptive']} AS de
      FROM (SELECT conv_id, turn, question, lower(question) AS q FROM ({QUESTION_SQL})))"""


@query("v10_suggest_chart", _chart_sql())
def v10(spark, sf):
    rows = questions(spark, sf).select("conv_id", "turn", "question")
    return ch.suggest_chart(rows, "question", n_numeric=3, n_categorical=2)
