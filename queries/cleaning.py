"""Cleaning (K)."""

from pyspark.sql import functions as F

from queries.common import (
    GAPPY_LINEITEM_SQL,
    GAPPY_PART_SQL,
    gappy_lineitem,
    gappy_part,
    query,
    rounded,
    sql_text,
    table,
    union_sql,
)
from queries.profiling import BASIC_CLEAN_SQL
from tabulens.functions import rules
from tabulens.functions import text as tx
from tabulens.operators import clean
from tabulens.plans.cleaning import CleaningPlan, apply_plan

_EN = rules.STOPWORDS["en"]
_IN_EN = "[" + ", ".join(sql_text(w) for w in _EN) + "]"


_JUNK_PLAN = {
    "remove_duplicates": 0,
    "missing_values": {"strategy": "guess", "constant_values": [1]},
    "outliers": {"strategy": "explode", "method": "magic", "zscore_threshold": "high"},
    "convert_types": {"date_columns": ["no_such_column"], "manual": {"p_size": "complex", "nowhere": "int"}},
    "text_cleaning": {"columns": ["missing"], "steps": ["shout"]},
}


@query("k01_plan_validation", GAPPY_PART_SQL)
def k01(spark, sf):
    df = gappy_part(spark, sf)
    return apply_plan(df, CleaningPlan.from_dict(_JUNK_PLAN, df.columns))[0]


@query("k02_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def k02(spark, sf):
    return clean.dedupe(table(spark, sf, "events").select("user_id", "event_type"))


def _filled_sql(fn):
    return f"""
    SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT {fn}(l_quantity) FROM g)), 4) AS l_quantity,
      round(coalesce(l_extendedprice, (SELECT {fn}(l_extendedprice) FROM g)), 4) AS l_extendedprice FROM g"""


_WITH_L = f"WITH g AS ({GAPPY_LINEITEM_SQL}) "
_FILL = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("k03_fill_median", _WITH_L + _filled_sql("median"))
def k03(spark, sf):
    return rounded(clean.impute(gappy_lineitem(spark, sf).select(*_FILL), _FILL[2:], "median"))


@query("k04_fill_mean", _WITH_L + _filled_sql("avg"))
def k04(spark, sf):
    return rounded(clean.impute(gappy_lineitem(spark, sf).select(*_FILL), _FILL[2:], "mean"))


_WITH_P = f"WITH g AS ({GAPPY_PART_SQL}) "


def _mode_sql(c):
    return f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "k05_fill_mode",
    _WITH_P + f"SELECT p_partkey, coalesce(p_type, {_mode_sql('p_type')}) AS p_type, coalesce(p_brand, {_mode_sql('p_brand')}) AS p_brand, p_size FROM g",
)
def k05(spark, sf):
    return clean.impute(gappy_part(spark, sf), ["p_type", "p_brand"], "mode")


@query(
    "k06_fill_constant",
    _WITH_P + "SELECT p_partkey, coalesce(p_type, 'OTHER') AS p_type, coalesce(p_brand, 'Unknown') AS p_brand, p_size FROM g",
)
def k06(spark, sf):
    return clean.impute(gappy_part(spark, sf), ["p_type", "p_brand"], "constant", {"p_type": "OTHER"})


@query(
    "k07_fill_unknown",
    _WITH_P + "SELECT p_partkey, coalesce(p_type, 'Unknown') AS p_type, coalesce(p_brand, 'Unknown') AS p_brand, p_size FROM g",
)
def k07(spark, sf):
    return clean.impute(gappy_part(spark, sf), ["p_type", "p_brand"], "unknown")


_GAPPY_TS = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS ts"


@query(
    "k08_forward_fill",
    f"""
    SELECT user_id, event_id, last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts
    FROM (SELECT user_id, event_id, {_GAPPY_TS} FROM events)
    """,
)
def k08(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_id", _GAPPY_TS)
    return clean.forward_fill(rows, "ts", ["event_id"], ["user_id"])


@query(
    "k08_forward_fill_text_key",
    f"""
    SELECT event_id, last_value(ts IGNORE NULLS) OVER (ORDER BY event_type, lpad(event_id::VARCHAR, 9, '0')
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts
    FROM (SELECT event_type, event_id, {_GAPPY_TS} FROM events)
    """,
)
def k08_text(spark, sf):
    """One group, in the order of text keys."""
    rows = table(spark, sf, "events").selectExpr("event_type", "event_id", "lpad(event_id, 9, '0') AS k", _GAPPY_TS)
    return clean.forward_fill(rows, "ts", ["event_type", "k"]).select("event_id", "ts")


def _iqr(c, source):
    return f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {source})"


_GAPPY_VALUE = "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value"
_WITH_E = f"WITH g AS (SELECT event_id, {_GAPPY_VALUE} FROM events) "


@query(
    "k09_iqr_clip",
    _WITH_E + f"SELECT event_id, CASE WHEN value IS NOT NULL THEN round(greatest(least(value, hi), lo), 4) END AS value FROM g, {_iqr('value', 'g')}",
)
def k09(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", _GAPPY_VALUE)
    return rounded(clean.outliers(rows, ["value"], "iqr", "clip"))


_SQUARED = "value * value / 100 + user_id AS spend"
_TWO = f"WITH g AS (SELECT event_id, {_GAPPY_VALUE}, {_SQUARED} FROM events) "


@query(
    "k10_iqr_drop",
    _TWO
    + f"""
    , a AS (SELECT event_id, value, spend FROM g, {_iqr('value', 'g')} WHERE value IS NULL OR value BETWEEN lo AND hi)
    SELECT event_id, value, round(spend, 6) AS spend FROM a, {_iqr('spend', 'a')} WHERE spend BETWEEN lo AND hi""",
)
def k10(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", _GAPPY_VALUE, _SQUARED)
    return rounded(clean.outliers(rows, ["value", "spend"], "iqr", "drop"), 6)


@query(
    "k10_iqr_drop_one_pass",
    _TWO
    + f"""
    SELECT event_id, value, round(spend, 6) AS spend FROM g, {_iqr('value', 'g')} a, {_iqr('spend', 'g')} b
    WHERE (value IS NULL OR value BETWEEN a.lo AND a.hi) AND spend BETWEEN b.lo AND b.hi""",
)
def k10_one(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", _GAPPY_VALUE, _SQUARED)
    return rounded(clean.outliers(rows, ["value", "spend"], "iqr", "drop", sequential=False), 6)


_Z = "(SELECT avg(o_totalprice) - 1.5 * stddev_samp(o_totalprice) AS lo, avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) AS hi FROM orders)"


@query("k11_zscore_clip", f"SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 4) AS o_totalprice FROM orders, {_Z}")
def k11(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(clean.outliers(rows, ["o_totalprice"], "zscore", "clip", 1.5))


@query("k12_zscore_drop", f"SELECT o_orderkey, o_totalprice FROM orders, {_Z} WHERE o_totalprice BETWEEN lo AND hi")
def k12(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return clean.outliers(rows, ["o_totalprice"], "zscore", "drop", 1.5)


@query(
    "k13_outlier_counts",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper,
            count(*) FILTER ({c} < lo OR {c} > hi) AS num_outliers FROM events, {_iqr(c, 'events')}"""
            for c in ("value", "user_id")
        ]
    ),
)
def k13(spark, sf):
    return rounded(clean.outlier_counts(table(spark, sf, "events"), ["value", "user_id"]))


_STEPS_SQL = r"regexp_replace(regexp_replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\d+', '', 'g')"


@query("k14_clean_text", f"SELECT doc_id, {_STEPS_SQL} AS text FROM documents")
def k14(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return clean.clean_text(docs, ["text"], ["remove_numbers", "remove_punct", "lowercase", "strip"])


_GAPPY_DOC = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source"


@query("k15_missing_text_named", f"SELECT doc_id, coalesce(source, 'none') AS source FROM (SELECT doc_id, {_GAPPY_DOC} FROM documents)")
def k15(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", _GAPPY_DOC)
    return clean.clean_text(docs, ["source"], ["lowercase"], null_as="None")


def _stop_sql(text, min_len):
    words = rf"regexp_split_to_array({text}, '[^\p{{L}}\p{{M}}\p{{N}}_]+')"
    return f"array_to_string([w FOR w IN {words} IF length(w) >= {min_len} AND NOT list_contains({_IN_EN}, w)], ' ')"


@query("k16_remove_stopwords", f"SELECT doc_id, {_stop_sql('text', 2)} AS text FROM documents")
def k16(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return clean.clean_text(docs, ["text"], ["remove_stopwords"])


@query("k17_basic_clean", f"SELECT doc_id, {BASIC_CLEAN_SQL.format(t='text')} AS text FROM documents")
def k17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.basic_clean(F.col("text")).alias("text"))


_DEEP = r"regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\d+', '', 'g'), '[!-/:-@\[-`{-~]', '', 'g')"


@query("k18_normalize_document", f"SELECT doc_id, {_stop_sql(_DEEP, 3)} AS text FROM documents")
def k18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_document(F.col("text"), _EN).alias("text"))


@query(
    "k19_to_datetime",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS placed FROM orders",
)
def k19(spark, sf):
    text = F.when(F.col("o_orderkey") % 6 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return clean.convert(table(spark, sf, "orders").select("o_orderkey", text.alias("placed")), {"placed": "datetime"})


_SIZE_TEXT = "CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'd') WHEN 1 THEN concat(p_size, '.5') ELSE concat(' ', p_size, ' ') END AS size"


@query("k20_to_int", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def k20(spark, sf):
    return clean.convert(table(spark, sf, "part").selectExpr("p_partkey", _SIZE_TEXT), {"size": "int"})


@query("k20_exact_integers", "SELECT l_linenumber, l_orderkey + 9007199254740992 AS as_text, l_orderkey + 9007199254740992 AS as_long FROM lineitem")
def k20_exact(spark, sf):
    """Keys that a double cannot hold."""
    key = F.col("l_orderkey") + F.lit(9007199254740992)
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber"), key.cast("string").alias("as_text"), key.alias("as_long"))
    return clean.convert(rows, {"as_text": "int", "as_long": "int"})


@query(
    "k21_to_float",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size + CAST(0.5 AS DOUBLE) ELSE p_size END AS size FROM part",
)
def k21(spark, sf):
    return clean.convert(table(spark, sf, "part").selectExpr("p_partkey", _SIZE_TEXT), {"size": "float"})


@query(
    "k22_category_codes",
    _WITH_P
    + """
    , codes AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM g WHERE p_type IS NOT NULL))
    SELECT p_partkey, p_type, CAST(coalesce(code, -1) AS BIGINT) AS p_type_code FROM g LEFT JOIN codes USING (p_type)""",
)
def k22(spark, sf):
    return clean.category_codes(gappy_part(spark, sf).select("p_partkey", "p_type"), "p_type")


@query("k23_to_string", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def k23(spark, sf):
    return clean.convert(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": "string", "o_custkey": "string"})


@query(
    "k24_parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate END AS placed FROM orders",
)
def k24(spark, sf):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd.MM.yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("n/a")
    )
    return clean.parse_dates(table(spark, sf, "orders").select("o_orderkey", text.alias("placed")), "placed")


@query("k24_month_first", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS placed FROM orders")
def k24_month(spark, sf):
    """Ambiguous days are read as the other days of the column demand."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("placed"))
    return clean.parse_dates(rows, "placed")


@query(
    "k24_parse_dates_one_format",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS placed FROM orders",
)
def k24_first(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return clean.parse_dates(table(spark, sf, "orders").select("o_orderkey", text.alias("placed")), "placed", detect="first")


@query("k25_long_digits", "SELECT o_orderkey, CAST('9999999999999' || lpad(o_orderkey::VARCHAR, 9, '0') AS DECIMAL(38,0)) AS code FROM orders")
def k25_long(spark, sf):
    """Numbers of 22 digits."""
    code = F.concat(F.lit("9999999999999"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return clean.numeric_text_to_number(table(spark, sf, "orders").select("o_orderkey", code.alias("code")))


@query("k25_digits_to_number", "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS size FROM part")
def k25(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("size"))
    return clean.numeric_text_to_number(rows)


@query(
    "k26_standardize_strings",
    """
    SELECT c_custkey, regexp_replace(c_name, '[^a-zA-Z0-9\\s]', '', 'g') AS c_name,
      regexp_replace(upper(concat('ab-', c_mktsegment)), '[^a-zA-Z0-9\\s]', '', 'g') AS seg_code,
      regexp_replace(concat(c_mktsegment, '/x'), '[^a-zA-Z0-9\\s]', '', 'g') AS segment FROM customer
    """,
)
def k26(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat(' ', upper(c_name), '! ') AS c_name", "concat('ab-', c_mktsegment, ' ') AS seg_code",
        "concat(c_mktsegment, '/x') AS segment",
    )
    return clean.standardize_strings(rows)


@query(
    "k27_title_case",
    "SELECT p_partkey, array_to_string([concat(upper(w[1]), lower(w[2:])) FOR w IN string_split(p_name, ' ')], ' ') AS p_name FROM part",
)
def k27(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "concat(upper(p_name), ' ') AS p_name")
    return clean.title_case_columns(rows, ["p_name"])


@query("k28_clip_ranges", "SELECT p_partkey, greatest(least(p_size, 40), 5) AS p_size FROM part")
def k28(spark, sf):
    return clean.clip_ranges(table(spark, sf, "part").select("p_partkey", "p_size"), {"p_size": (5, 40)})


@query("k28_range_violations", "SELECT 'p_size' AS \"column\", count(*) FILTER (p_size < 5 OR p_size > 40) AS num_clipped FROM part")
def k28_count(spark, sf):
    return clean.range_violations(table(spark, sf, "part"), {"p_size": (5, 40), "age": (0, 120)})


@query("k29_date_parts", "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INT) AS o_orderdate_year FROM orders")
def k29(spark, sf):
    return clean.add_date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


@query("k30_parse_number", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def k30(spark, sf):
    text = F.concat(F.format_number("o_totalprice", 2), F.lit(" USD"))
    return clean.parse_number(table(spark, sf, "orders").select("o_orderkey", text.alias("price")), "price")


PLAN = {
    "remove_duplicates": True,
    "missing_values": {"strategy": "median", "categorical_strategy": "mode"},
    "outliers": {"strategy": "clip", "method": "iqr"},
    "text_cleaning": {"columns": ["l_linestatus"], "steps": ["lowercase"]},
    "convert_types": {"manual": {"l_orderkey": "string"}},
}
_PLANNED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")


def _planned(spark, sf):
    return gappy_lineitem(spark, sf).select(*_PLANNED)


def _plan_sql():
    clipped = []
    for c in ("l_quantity", "l_extendedprice"):
        clipped.append(f"round(greatest(least({c}, (SELECT hi FROM b_{c})), (SELECT lo FROM b_{c})), 4) AS {c}")
    return f"""
    WITH g AS ({GAPPY_LINEITEM_SQL}), d AS (SELECT DISTINCT {', '.join(_PLANNED)} FROM g),
    f AS (SELECT l_orderkey, coalesce(l_quantity, (SELECT median(l_quantity) FROM d)) AS l_quantity,
      coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM d)) AS l_extendedprice,
      coalesce(l_returnflag, (SELECT l_returnflag FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag,
      l_linestatus FROM d),
    b_l_quantity AS {_iqr('l_quantity', 'f')}, b_l_extendedprice AS {_iqr('l_extendedprice', 'f')}
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, {', '.join(clipped)}, l_returnflag, lower(l_linestatus) AS l_linestatus FROM f"""


@query("k31_apply_plan", _plan_sql())
def k31(spark, sf):
    df = _planned(spark, sf)
    return rounded(apply_plan(df, CleaningPlan.from_dict(PLAN, df.columns))[0])


def _plan_report_sql():
    head = _plan_sql().rsplit("SELECT CAST(l_orderkey", 1)[0].rstrip()
    outside = [
        f"""SELECT 'outliers', '{c}', 'clipped', n FROM (SELECT count(*) FILTER ({c} < (SELECT lo FROM b_{c}) OR {c} > (SELECT hi FROM b_{c})) AS n FROM f) WHERE n > 0"""
        for c in ("l_orderkey", "l_quantity", "l_extendedprice")
    ]
    return f"""{head}, b_l_orderkey AS {_iqr('l_orderkey', 'f')}
    SELECT 'duplicates' AS step, CAST(NULL AS VARCHAR) AS "column", CASE WHEN n > 0 THEN 'removed' ELSE 'none_found' END AS action, n AS affected
      FROM (SELECT (SELECT count(*) FROM g) - (SELECT count(*) FROM d) AS n)
    UNION ALL SELECT 'missing', 'l_quantity', 'filled_median', count(*) - count(l_quantity) FROM d
    UNION ALL SELECT 'missing', 'l_extendedprice', 'filled_median', count(*) - count(l_extendedprice) FROM d
    UNION ALL SELECT 'missing', 'l_returnflag', 'filled_mode', count(*) - count(l_returnflag) FROM d
    UNION ALL {' UNION ALL '.join(outside)}
    UNION ALL SELECT 'text', 'l_linestatus', 'cleaned', NULL UNION ALL SELECT 'types', 'l_orderkey', 'converted', NULL"""


@query("k31_plan_report", _plan_report_sql())
def k31_report(spark, sf):
    df = _planned(spark, sf)
    return apply_plan(df, CleaningPlan.from_dict(PLAN, df.columns))[1].drop("detail")


COMPAT_PLAN = {"missing_values": {"strategy": "mean"}, "outliers": {"strategy": "drop", "method": "zscore", "zscore_threshold": 1.5}}


@query(
    "k31_apply_plan_compat",
    _WITH_L
    + """
    , f AS (SELECT coalesce(l_quantity, (SELECT median(l_quantity) FROM g)) AS q, coalesce(l_returnflag, 'Unknown') AS l_returnflag, l_linestatus FROM g)
    SELECT q AS l_quantity, l_returnflag, l_linestatus
    FROM f WHERE abs((q - (SELECT avg(q) FROM f)) / (SELECT stddev_samp(q) FROM f)) <= 1.5""",
)
def k31_compat(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_quantity", "l_returnflag", "l_linestatus")
    return apply_plan(df, CleaningPlan.from_dict(COMPAT_PLAN, df.columns, compat=True))[0]


@query(
    "k32_cleaning_summary",
    f"""
    WITH g AS (SELECT l_quantity, l_returnflag, l_linestatus FROM ({GAPPY_LINEITEM_SQL})), d AS (SELECT DISTINCT * FROM g)
    SELECT (SELECT count(*) FROM g) - (SELECT count(*) FROM d) AS rows_removed, 3 AS columns_remaining,
      CAST((SELECT 2 * count(*) - count(l_quantity) - count(l_returnflag) FROM g) AS BIGINT) AS missing_values_removed,
      round(((1 - 0) * 0.7 + (SELECT count(*) FROM (SELECT DISTINCT coalesce(l_quantity, (SELECT median(l_quantity) FROM d)), coalesce(l_returnflag, 'Unknown'), l_linestatus FROM d))
        / (SELECT count(*) FROM d) * 0.3) * 100, 2) AS quality_score
    """,
)
def k32(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_quantity", "l_returnflag", "l_linestatus")
    plan = CleaningPlan.from_dict({"remove_duplicates": True, "missing_values": {"strategy": "median"}}, df.columns)
    return clean.cleaning_summary(df, apply_plan(df, plan)[0])
