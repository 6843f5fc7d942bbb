"""Statistics (A), forecasts (F), vectors (X) and report tables (R)."""

from itertools import combinations

from pyspark.sql import functions as F

from queries.common import GAPPY_ORDERS_SQL, gappy_orders, query, rounded, table, union_sql
from queries.profiling import _METRICS, DESCRIBE, _distinct_sql, _stats_sql, _top_sql
from tabulens.operators import report
from tabulens.operators import stats as st
from tabulens.operators.forecast import FEATURES_SQL, PLACES, SEGMENT_SQL, daily_series, forecast, forecast_breaks, forecast_end, normal_sums
from tabulens.operators.vectors import top_k

_L_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_O_NUM = ("o_orderkey", "o_custkey", "o_totalprice")
# A column that depends on others, so that some pairs are strongly correlated.
_PRICED = ("l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * (1 - l_discount) AS net", "-l_quantity + l_tax AS owed")
_PRICED_COLS = ("l_quantity", "l_extendedprice", "l_discount", "net", "owed")
_PRICED_SQL = "SELECT " + ", ".join(_PRICED) + " FROM lineitem"


def _priced(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_PRICED)


def _pairs_sql(cols, source):
    pairs = list(combinations(range(len(cols)), 2))
    return union_sql([f"SELECT '{cols[i]}' AS a, '{cols[j]}' AS b, {i} AS i, {j} AS j, corr({cols[i]}, {cols[j]}) AS r FROM ({source})" for i, j in pairs])


_GROWTH = """round((arg_max({c}, row(o_orderdate, o_orderkey)) - arg_min({c}, row(o_orderdate, o_orderkey))) / arg_min({c}, row(o_orderdate, o_orderkey)) * 100, 4) AS growth_percent,
  arg_min({c}, row(o_orderdate, o_orderkey)) AS start_value, arg_max({c}, row(o_orderdate, o_orderkey)) AS end_value,
  round(arg_max({c}, row(o_orderdate, o_orderkey)) - arg_min({c}, row(o_orderdate, o_orderkey)), 4) AS absolute_change"""


@query(
    "a01_growth",
    f"""SELECT o_orderpriority, 'o_totalprice' AS "column", {_GROWTH.format(c='o_totalprice')} FROM orders GROUP BY 1""",
)
def a01(spark, sf):
    return rounded(st.growth(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderdate", "o_orderkey"], ["o_orderpriority"]))


@query("a02_correlation", f"SELECT a, b, i, j, round(r, 6) AS r FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)})")
def a02(spark, sf):
    return rounded(st.correlation(_priced(spark, sf), _PRICED_COLS), 6)


@query(
    "a03_strongest_pairs",
    f"""SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
    FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)}) ORDER BY abs(r) DESC LIMIT 5""",
)
def a03(spark, sf):
    return rounded(st.strongest_pairs(_priced(spark, sf), _PRICED_COLS), 6)


@query(
    "a04_notable_pairs",
    f"""SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
    CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)}) WHERE abs(r) > 0.5 ORDER BY i, j LIMIT 3""",
)
def a04(spark, sf):
    return rounded(st.notable_pairs(_priced(spark, sf), _PRICED_COLS), 6)


@query(
    "a05_related_columns",
    f"""SELECT a, b, round(r, 6) AS r FROM ({_pairs_sql(('l_extendedprice', 'net', 'owed'), _PRICED_SQL)})
    WHERE abs(r) > 0.3 ORDER BY abs(r) DESC LIMIT 3""",
)
def a05(spark, sf):
    rows = _priced(spark, sf).selectExpr("l_extendedprice", "CAST(net AS STRING) AS net", "concat('x', l_discount) AS note", "owed")
    return rounded(st.related_columns(rows, first=4), 6)


@query("a06_most_correlated", f"SELECT a, b, round(r, 6) AS r FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)}) ORDER BY abs(r) DESC LIMIT 1")
def a06(spark, sf):
    return rounded(st.most_correlated(_priced(spark, sf)), 6)


_SUMMARY = """round(avg({c}), {d}) AS mean, round(median({c}), {d}) AS median, round(stddev_samp({c}), {d}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count({c}) AS count, round(CAST(max({c}) - min({c}) AS DOUBLE), {d}) AS range"""


@query("a07_summary_stats", _stats_sql(("o_totalprice", "o_custkey"), "SELECT * FROM orders", _SUMMARY))
def a07(spark, sf):
    return rounded(st.summary_stats(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


@query(
    "a08_backup_analysis",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS average, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
            round(stddev_samp({c}), 4) AS std, count({c}) AS points,
            round((arg_max({c}, row(o_orderdate, k)) - arg_min({c}, row(o_orderdate, k))) * 100.0 / arg_min({c}, row(o_orderdate, k)), 4) AS overall_change
            FROM (SELECT *, o_orderkey + 1 AS k FROM orders)"""
            for c in ("k", "o_custkey", "o_totalprice")
        ]
    ),
)
def a08(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey + 1 AS k", "CAST(o_custkey AS STRING) AS o_custkey", "o_orderstatus", "CAST(o_totalprice AS STRING) AS o_totalprice", "o_orderdate"
    )
    return rounded(st.backup_analysis(rows, ["o_orderdate", "k"], key_first=6, first=4))


_COMPARE = "SELECT {cat} AS category, avg({num}) AS mean, count({num}) AS count, stddev_samp({num}) AS std FROM {t} WHERE {cat} IS NOT NULL GROUP BY 1"


@query(
    "a09_compare_groups",
    f"SELECT category, round(mean, 4) AS mean, count, round(std, 4) AS std FROM ({_COMPARE.format(cat='l_returnflag', num='l_extendedprice', t='lineitem')})",
)
def a09(spark, sf):
    return rounded(st.compare_groups(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@query(
    "a10_group_extremes",
    f"""SELECT arg_max(category, mean) AS highest, round(max(mean), 4) AS highest_mean, arg_min(category, mean) AS lowest,
    round(min(mean), 4) AS lowest_mean, stddev_samp(mean) > 0.1 * avg(mean) AS significant_variation
    FROM ({_COMPARE.format(cat='o_orderpriority', num='o_totalprice', t='orders')})""",
)
def a10(spark, sf):
    return rounded(st.group_extremes(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "a11_distribution",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    s AS (SELECT avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, skewness(value) AS k,
      count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS num_outliers, count(*) AS n FROM events, q)
    SELECT 'value' AS "column", round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(k, 4) AS skewness,
      CASE WHEN abs(k) > 1 THEN 'high' WHEN abs(k) > 0.5 THEN 'moderate' ELSE 'normal' END AS shape,
      CASE WHEN abs(k) > 0.5 THEN CASE WHEN k > 0 THEN 'right' ELSE 'left' END ELSE 'none' END AS direction,
      num_outliers, round(num_outliers * 100.0 / n, 4) AS outlier_percent FROM s
    """,
)
def a11(spark, sf):
    return rounded(st.distribution(table(spark, sf, "events"), "value"))


@query(
    "a12_value_shares",
    f"""SELECT "column", value, count, rank, round(count * 100.0 / (SELECT count(*) FROM orders), 4) AS percent
    FROM ({_top_sql(('o_orderstatus', 'o_orderpriority'), 'SELECT * FROM orders', 5)})""",
)
def a12(spark, sf):
    return rounded(st.value_shares(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("a13_top_records", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def a13(spark, sf):
    return st.top_records(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], ["o_orderkey"])


@query(
    "a13_value_extremes",
    union_sql([f"""SELECT '{c}' AS "column", CAST(max({c}) AS DOUBLE) AS highest, CAST(min({c}) AS DOUBLE) AS lowest, round(avg({c}), 4) AS average FROM orders""" for c in ("o_totalprice", "o_custkey")]),
)
def a13_extremes(spark, sf):
    return rounded(st.value_extremes(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


@query(
    "a14_rank_categories",
    """
    WITH c AS (SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1)
    SELECT * FROM (SELECT 'most' AS side, value, count FROM c ORDER BY count DESC, value LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'least', value, count FROM c ORDER BY count, value DESC LIMIT 2)
    """,
)
def a14(spark, sf):
    return st.rank_categories(table(spark, sf, "part"), "p_name")


@query(
    "a15_trend_endpoints",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
            CAST(arg_min({c}, row(o_orderdate, o_orderkey)) AS DOUBLE) AS start_value, CAST(arg_max({c}, row(o_orderdate, o_orderkey)) AS DOUBLE) AS end_value FROM orders"""
            for c in ("o_totalprice", "o_custkey")
        ]
    ),
)
def a15(spark, sf):
    return st.trend_endpoints(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], ["o_orderkey"])


@query(
    "a16_samples_per_group",
    """
    WITH top AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5)
    SELECT source AS category, CAST(rank AS INT) AS rank, doc_id, text AS sample FROM (
      SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IN (SELECT source FROM top))
    WHERE rank <= 2
    """,
)
def a16(spark, sf):
    return st.samples_per_group(table(spark, sf, "documents"), "source", "text", ["doc_id"])


@query("a17_crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS count FROM lineitem GROUP BY 1, 2")
def a17(spark, sf):
    return st.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "a17_crosstab_wide",
    """SELECT o_orderpriority AS a, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
    count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def a17_wide(spark, sf):
    return st.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


_ANY = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "q25": "quantile_cont({c}, 0.25)", "q50": "median({c})", "q75": "quantile_cont({c}, 0.75)"}


@query(
    "a18_describe_any",
    union_sql(
        [
            f"""SELECT 'o_totalprice' AS "column", '{m}' AS metric, '' AS label, round({e.format(c='o_totalprice')}, 4) AS value FROM orders"""
            for m, e in _ANY.items()
        ]
        + ["SELECT 'o_orderpriority', 'unique', '', CAST(count(DISTINCT o_orderpriority) AS DOUBLE) FROM orders"]
        + [f"SELECT \"column\", 'top', value, CAST(count AS DOUBLE) FROM ({_top_sql(('o_orderpriority',), 'SELECT * FROM orders', 3)})"]
    ),
)
def a18(spark, sf):
    return rounded(st.describe_any(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority"], ["o_totalprice"]))


@query("a19_eda_describe", _stats_sql(_PRICED_COLS, _PRICED_SQL, DESCRIBE))
def a19(spark, sf):
    return rounded(st.eda(_priced(spark, sf))["describe"])


@query(
    "a19_eda",
    union_sql(
        [f"""SELECT 'shape' AS part, '{k}' AS item, '' AS metric, CAST({v} AS DOUBLE) AS value FROM lineitem""" for k, v in (("n_rows", "count(*)"), ("n_cols", f"max({len(_PRICED_COLS)})"))]
        + [f"SELECT 'missing', '{c}', 'num_missing', CAST(count(*) - count({c}) AS DOUBLE) FROM ({_PRICED_SQL})" for c in _PRICED_COLS]
        + [f"SELECT 'describe', '{c}', '{m}', CAST(round(CAST({e.format(c=c)} AS DOUBLE), 4) AS DOUBLE) FROM ({_PRICED_SQL})" for c in _PRICED_COLS for m, e in _METRICS.items()]
        + [f"SELECT * FROM (SELECT 'correlations', a || ' ~ ' || b, 'r', round(r, 4) FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)}) ORDER BY abs(r) DESC LIMIT 5)"]
    ),
)
def a19_all(spark, sf):
    """All four parts as one long table."""
    parts = st.eda(_priced(spark, sf))

    def long(part, df, item, metrics):
        entries = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(m).cast("double").alias("value")) for m, label in metrics.items()])
        return df.select(F.lit(part).alias("part"), item.alias("item"), F.explode(entries).alias("m")).select("part", "item", "m.*")

    shape = [long("shape", parts["shape"], F.lit(k), {k: ""}) for k in ("n_rows", "n_cols")]
    out = shape[0].unionByName(shape[1])
    out = out.unionByName(long("missing", parts["missing"], F.col("column"), {"num_missing": "num_missing"}))
    out = out.unionByName(long("describe", parts["describe"], F.col("column"), {m: m for m in _METRICS}))
    return rounded(out.unionByName(long("correlations", parts["correlations"], F.concat_ws(" ~ ", "a", "b"), {"r": "r"})))


@query(
    "a20_chart_picks",
    f"""
    SELECT 'distribution' AS pick, unnest(['l_quantity', 'l_extendedprice']) AS "column", CAST(NULL AS VARCHAR) AS other
    UNION ALL SELECT 'counts', 'l_returnflag', NULL FROM lineitem HAVING count(DISTINCT l_returnflag) < 20
    UNION ALL SELECT * FROM (SELECT 'relationship', a, b FROM ({_pairs_sql(_PRICED_COLS, _PRICED_SQL)}) ORDER BY abs(r) DESC LIMIT 1)
    """,
)
def a20(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*_PRICED, "l_returnflag", "CAST(l_shipdate AS STRING) AS shipped")
    return st.chart_picks(rows, _PRICED_COLS, ["l_returnflag", "shipped"], first=2)


@query(
    "a21_column_analysis",
    """
    SELECT 'o_totalprice' AS "column", 'numeric' AS kind, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean,
      count(o_totalprice) AS count, CAST(NULL AS BIGINT) AS num_unique, CAST(NULL AS VARCHAR) AS top_value FROM orders
    UNION ALL
    SELECT 'o_orderpriority', 'categorical', NULL, NULL, NULL, count(*), count(DISTINCT o_orderpriority),
      (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM orders
    """,
)
def a21(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("CAST(o_totalprice AS STRING) AS o_totalprice", "o_orderpriority")
    return rounded(st.column_analysis(rows, ["o_totalprice", "o_orderpriority"]))


_MONTHLY = "SELECT o_orderstatus, date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2"


def _monthly(spark, sf):
    return st.period_totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", ["o_orderstatus"])


_CHANGE = "(value - lag(value) OVER w) / lag(value) OVER w * 100"


@query(
    "a22_pct_change",
    f"SELECT o_orderstatus, CAST(period AS TIMESTAMP) AS period, round(value, 2) AS value, round({_CHANGE}, 4) AS pct_change FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)",
)
def a22(spark, sf):
    changed = st.pct_change(_monthly(spark, sf), "value", ["period"], ["o_orderstatus"])
    return changed.select("o_orderstatus", "period", F.round("value", 2).alias("value"), F.round("pct_change", 4).alias("pct_change"))


@query(
    "a23_cagr",
    """
    WITH y AS (SELECT o_orderstatus, date_trunc('year', o_orderdate) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
    e AS (SELECT o_orderstatus, arg_min(value, period) AS a, arg_max(value, period) AS b, date_diff('day', CAST(min(period) AS DATE), CAST(max(period) AS DATE)) / CAST(365.25 AS DOUBLE) AS years FROM y GROUP BY 1)
    SELECT o_orderstatus, round(a, 2) AS start_value, round(b, 2) AS end_value, round(years, 4) AS years, round(pow(b / a, 1 / years) - 1, 6) AS cagr FROM e
    """,
)
def a23(spark, sf):
    yearly = st.period_totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "year", ["o_orderstatus"])
    return st.cagr(yearly, "value", "period", ["o_orderstatus"]).select(
        "o_orderstatus", F.round("start_value", 2).alias("start_value"), F.round("end_value", 2).alias("end_value"),
        F.round("years", 4).alias("years"), F.round("cagr", 6).alias("cagr"),
    )


@query(
    "a24_volatility",
    f"""SELECT o_orderstatus, round(var_samp(value) / 1e9, 2) AS variance_billions, round(stddev_samp(c), 4) AS volatility
    FROM (SELECT o_orderstatus, value, {_CHANGE} AS c FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)) GROUP BY 1""",
)
def a24(spark, sf):
    return st.volatility(_monthly(spark, sf), "value", ["period"], ["o_orderstatus"]).select(
        "o_orderstatus", F.round(F.col("variance") / 1e9, 2).alias("variance_billions"), F.round("volatility", 4).alias("volatility")
    )


_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"


@query(
    "a25_trend",
    f"""SELECT o_orderstatus, round(regr_slope(o_totalprice, {_DAY}), 6) AS slope_per_day, round(regr_r2(o_totalprice, {_DAY}), 6) AS r2,
    count(o_totalprice) AS points FROM orders GROUP BY 1""",
)
def a25(spark, sf):
    return rounded(st.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"]), 6)


@query(
    "a26_totals_and_shares",
    """SELECT l_returnflag AS category, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS average,
    round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1""",
)
def a26(spark, sf):
    return st.totals_by(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice").select(
        "category", F.round("total", 2).alias("total"), F.round("average", 4).alias("average"), F.round("share", 6).alias("share")
    )


@query(
    "a27_top_entities",
    "SELECT o_custkey AS entity, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10",
)
def a27(spark, sf):
    return rounded(st.top_entities(table(spark, sf, "orders"), "o_custkey", "o_totalprice"), 2)


# ---- forecast ------------------------------------------------------------------------------------

_FORECAST = """
WITH s AS (SELECT {by} CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x FROM orders GROUP BY ALL),
f AS (SELECT {by} regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(ds) AS last FROM s {group}),
r AS (SELECT s.*, a, b, last, y - a - b * x AS res FROM s {join}),
o AS (SELECT {by} dayofweek(ds) AS dow, avg(res) AS off FROM r GROUP BY ALL),
z AS (SELECT {by} sqrt(sum((res - off) * (res - off)) / (count(*) - 1)) AS sd FROM r JOIN o ON o.dow = dayofweek(r.ds) {same_o} {group}),
d AS (SELECT {by} ds, a, b, false AS is_future FROM r
  UNION ALL SELECT {by} CAST(unnest(range(last + 1, last + 31, INTERVAL 1 DAY)) AS DATE) AS ds, a, b, true FROM f),
p AS (SELECT d.*, a + b * date_diff('day', DATE '1970-01-01', ds) + coalesce(off, 0) AS yhat FROM d LEFT JOIN o ON o.dow = dayofweek(ds) {same_d})
SELECT {pby} ds, round(yhat, 2) AS yhat, round(yhat - CAST(1.2816 AS DOUBLE) * sd, 2) AS yhat_lower, round(yhat + CAST(1.2816 AS DOUBLE) * sd, 2) AS yhat_upper, is_future
FROM p {join_z}"""
_FORECAST_ALL = _FORECAST.format(by="", group="", join=", f", same_o="", same_d="", pby="", join_z=", z")
_FORECAST_BY = _FORECAST.format(
    by="o_orderstatus,", group="GROUP BY 1", join="JOIN f USING (o_orderstatus)", same_o="AND o.o_orderstatus = r.o_orderstatus",
    same_d="AND o.o_orderstatus = d.o_orderstatus", pby="o_orderstatus,", join_z="JOIN z USING (o_orderstatus)",
).replace("SELECT o_orderstatus, sqrt", "SELECT r.o_orderstatus, sqrt")


@query("f01_forecast", _FORECAST_ALL)
def f01(spark, sf):
    return rounded(forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 30), 2)


@query("f01_forecast_by_group", _FORECAST_BY)
def f01_by(spark, sf):
    return rounded(forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 30, ["o_orderstatus"]), 2)


_SUMS_SQL = f"""
WITH days AS (SELECT o_orderdate::DATE - DATE '1970-01-01' AS d, dayofweek(o_orderdate) + 1 AS dow, sum(o_totalprice / 1e6) AS y FROM orders GROUP BY 1, 2),
ends AS (SELECT d::DOUBLE AS d, dow, y, min(d) OVER ()::DOUBLE AS lo, max(d) OVER ()::DOUBLE AS hi FROM days),
f AS (SELECT {SEGMENT_SQL} AS segment, [{', '.join(FEATURES_SQL)}, y] AS f FROM ends)
SELECT segment, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(f[i + 1] * f[j + 1]) / count(*), 6) AS mean_product
FROM f, range({len(FEATURES_SQL) + 1}) AS a(i), range({len(FEATURES_SQL) + 1}) AS b(j) WHERE i <= j GROUP BY 1, 2, 3"""


@query("f01_trend_sums", _SUMS_SQL)
def f01_sums(spark, sf):
    """What the trend with breaks is solved from: mean products of features by segment."""
    rows = table(spark, sf, "orders").withColumn("y", F.col("o_totalprice") / 1e6)
    sums = normal_sums(daily_series(rows, "o_orderdate", "y")).select("segment", "n", F.posexplode("sums").alias("at", "s"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in PLACES])
    return rounded(sums.select("segment", F.get(places, F.col("at")).alias("x"), (F.col("s") / F.col("n")).alias("mean_product")).select("segment", "x.i", "x.j", "mean_product"), 6)


@query("f01_forecast_breaks")
def f01_breaks(spark, sf):
    """Trend with breaks, week and year by group; tests hold it against least squares over the days."""
    return rounded(forecast_breaks(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 90, ["o_orderstatus"]), 2)


@query("f02_forecast_end", f"SELECT max(ds) AS ends, arg_max(yhat, ds) AS final_value FROM ({_FORECAST_ALL})")
def f02(spark, sf):
    return rounded(forecast_end(forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 30)), 2)


# ---- vectors -------------------------------------------------------------------------------------

_CENTRES = """
WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, vec_id FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (
  SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(c.label AS BIGINT) AS label, CAST(rank AS INT) AS rank, vec_id, round(distance, 5) AS distance FROM (
  SELECT c.label, e.vec_id, {d} AS distance, row_number() OVER (PARTITION BY c.label ORDER BY {d}, e.vec_id) AS rank FROM c, e) AS c WHERE rank <= 5"""


def _centres(spark, sf):
    """The mean vector of every label."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s["m"]).alias("centre"))


@query("x01_nearest_l2", _CENTRES.format(d="list_distance(c.centre, e.v)"))
def x01(spark, sf):
    found = top_k(table(spark, sf, "embeddings"), _centres(spark, sf), "vec_id", "embedding", "label", "centre")
    return rounded(found, 5)


@query("x01_nearest_text_ids", "SELECT 'c' || label AS label, rank, lpad(vec_id::VARCHAR, 6, '0') AS vec_id, distance FROM (" + _CENTRES.format(d="list_distance(c.centre, e.v)") + ")")
def x01_text(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("vec_id"), "embedding")
    centres = _centres(spark, sf).select(F.concat(F.lit("c"), "label").alias("label"), "centre")
    return rounded(top_k(rows, centres, "vec_id", "embedding", "label", "centre"), 5)


@query("x01_nearest_cosine", _CENTRES.format(d="(1 - list_cosine_similarity(c.centre, e.v))"))
def x01_cosine(spark, sf):
    found = top_k(table(spark, sf, "embeddings"), _centres(spark, sf), "vec_id", "embedding", "label", "centre", metric="cosine")
    return rounded(found, 5)


# ---- report --------------------------------------------------------------------------------------


@query(
    "r01_report_overview",
    f"""SELECT count(*) AS total_records, 4 AS total_features, 2 AS numeric_features, 1 AS categorical_features,
    CAST(3 * count(*) - count(o_totalprice) - count(o_orderstatus) - count(o_orderdate) AS BIGINT) AS missing_values,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({GAPPY_ORDERS_SQL}))) AS duplicate_records FROM ({GAPPY_ORDERS_SQL})""",
)
def r01(spark, sf):
    return report.report_overview(gappy_orders(spark, sf))


_FEATURES = {"o_orderkey": ("bigint", True), "o_totalprice": ("double", True), "o_orderstatus": ("string", False), "o_orderdate": ("timestamp_ntz", False)}


@query(
    "r02_report_features",
    union_sql(
        [
            f"""SELECT '{c}' AS name, '{t}' AS dtype, count(*) - count({c}) AS num_missing, count(DISTINCT {c}) AS num_unique,
            {f'round(avg({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS mean, {f'round(stddev_samp({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS std FROM ({GAPPY_ORDERS_SQL})"""
            for c, (t, n) in _FEATURES.items()
        ]
    ),
)
def r02(spark, sf):
    return rounded(report.report_features(gappy_orders(spark, sf), first=10))


@query(
    "r03_report_numeric",
    union_sql(
        [
            f"SELECT '{c}' AS feature, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM lineitem"
            for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        ]
    ),
)
def r03(spark, sf):
    return report.report_numeric(table(spark, sf, "lineitem"), first=5)
