"""Profiles (P)."""

from pyspark.sql import functions as F

from queries.common import (
    GAPPY_ORDERS_SQL,
    gappy_orders,
    query,
    rounded,
    sql_first,
    sql_score,
    sql_text,
    table,
    union_sql,
)
from tabulens.functions import rules
from tabulens.operators import language
from tabulens.operators import profile as pr
from tabulens.operators import schema as sc
from tabulens.operators import textstats as ts

_L_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_GAPPY_COLS = ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")


@query(
    "p01_profile_dataset",
    """
    SELECT 'table' AS data_type, count(*) AS n_rows, 6 AS n_cols,
      'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
      3 AS n_numeric, 2 AS n_categorical, 1 AS n_temporal FROM orders
    """,
)
def p01(spark, sf):
    return pr.profile_dataset(table(spark, sf, "orders")).withColumn("columns", F.array_join("columns", ",")).drop("analyses")


def _missing_sql(cols, source):
    return union_sql(
        [
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS num_missing,
            round((count(*) - count({c})) / count(*), 6) AS pct_missing FROM ({source})"""
            for c in cols
        ]
    )


@query("p02_missing_counts", _missing_sql(_GAPPY_COLS, GAPPY_ORDERS_SQL))
def p02(spark, sf):
    return rounded(pr.missing_counts(gappy_orders(spark, sf)), 6)


@query(
    "p03_duplicate_count",
    """
    SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS num_duplicates
    FROM events
    """,
)
def p03(spark, sf):
    return pr.duplicate_count(table(spark, sf, "events").select("user_id", "event_type"))


def _distinct_sql(cols, source):
    return union_sql([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS num_unique FROM ({source})""" for c in cols])


@query("p04_distinct_counts", _distinct_sql(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "SELECT * FROM part"))
def p04(spark, sf):
    return pr.distinct_counts(table(spark, sf, "part"))


def _stats_sql(cols, source, select, digits=4):
    return union_sql([f"""SELECT '{c}' AS "column", {select.format(c=c, d=digits)} FROM ({source})""" for c in cols])


_SPREAD = "round(min({c}), {d}) AS min, round(max({c}), {d}) AS max, round(avg({c}), {d}) AS mean"


@query(
    "p05_numeric_profile",
    _stats_sql(_L_NUM, "SELECT * FROM lineitem", _SPREAD + ", round(median({c}), {d}) AS median, round(stddev_samp({c}), {d}) AS std"),
)
def p05(spark, sf):
    return rounded(pr.numeric_profile(table(spark, sf, "lineitem"), _L_NUM))


def _zscore_sql(cols, source, threshold=3):
    return union_sql(
        [
            f"""SELECT '{c}' AS "column", count(*) FILTER (abs(({c} - m) / s) > {threshold}) AS num_outliers
            FROM ({source}), (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ({source}))"""
            for c in cols
        ]
    )


@query("p06_zscore_outliers", _zscore_sql(("value", "user_id"), "SELECT * FROM events"))
def p06(spark, sf):
    return pr.zscore_outliers(table(spark, sf, "events"), ["value", "user_id"])


def _top_sql(cols, source, k):
    return union_sql(
        [
            f"""SELECT "column", value, count, rank FROM (
              SELECT '{c}' AS "column", value, count, CAST(row_number() OVER (ORDER BY count DESC, value) AS INT) AS rank
              FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count FROM ({source}) WHERE {c} IS NOT NULL GROUP BY 1))
            WHERE rank <= {k}"""
            for c in cols
        ]
    )


@query("p07_top_values", _top_sql(("p_name", "p_brand", "p_type"), "SELECT * FROM part", 5))
def p07(spark, sf):
    return pr.top_values(table(spark, sf, "part"))


@query("p08_date_ranges", "SELECT 'o_orderdate' AS \"column\", min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders")
def p08(spark, sf):
    return pr.date_ranges(table(spark, sf, "orders"))




@query(
    "p09_basic_stats",
    _stats_sql(
        _L_NUM, "SELECT * FROM lineitem",
        _SPREAD + ", count({c}) AS count, round(stddev_samp({c}), {d}) AS std, round(quantile_cont({c}, 0.25), {d}) AS q1, "
        "round(quantile_cont({c}, 0.5), {d}) AS median, round(quantile_cont({c}, 0.75), {d}) AS q3",
    ),
)
def p09(spark, sf):
    return rounded(pr.basic_stats(table(spark, sf, "lineitem"), _L_NUM))


DESCRIBE = (
    _SPREAD + ", count({c}) AS count, round(stddev_samp({c}), {d}) AS std, round(quantile_cont({c}, 0.25), {d}) AS q25, "
    "round(quantile_cont({c}, 0.5), {d}) AS q50, round(quantile_cont({c}, 0.75), {d}) AS q75"
)


@query("p10_describe_numeric", _stats_sql(_L_NUM, "SELECT * FROM lineitem", DESCRIBE))
def p10(spark, sf):
    return rounded(pr.describe_numeric(table(spark, sf, "lineitem"), _L_NUM))


def _score_sql(cols, source):
    gaps = " + ".join(f"(count(*) - count({c}))" for c in cols)
    names = ", ".join(cols)
    return f"""
    SELECT n_rows, CAST(missing AS BIGINT) AS missing, n_rows - n_distinct AS duplicates,
      round(((1 - missing / (n_rows * {len(cols)})) * 0.7 + (n_distinct / n_rows) * 0.3) * 100, 2) AS quality_score
    FROM (SELECT count(*) AS n_rows, {gaps} AS missing, (SELECT count(*) FROM (SELECT DISTINCT {names} FROM ({source}))) AS n_distinct FROM ({source}))"""


_SCORED = "SELECT o_totalprice, o_orderstatus, o_orderpriority FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)"


@query("p11_quality_score", _score_sql(("o_totalprice", "o_orderstatus", "o_orderpriority"), _SCORED))
def p11(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "o_orderpriority",
    )
    return pr.quality_score(rows)


_METRICS = {
    "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
    "q25": "quantile_cont({c}, 0.25)", "q50": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})",
}
_P12 = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "p12_comprehensive_profile",
    union_sql(
        [
            f"""SELECT 'describe' AS part, '{c}' AS "column", '{m}' AS metric, round(CAST({e.format(c=c)} AS DOUBLE), 4) AS value FROM lineitem"""
            for c in _P12
            for m, e in _METRICS.items()
        ]
        + [
            f"SELECT 'correlation', '{a} ~ {b}', 'r', round(corr({a}, {b}), 4) FROM lineitem"
            for a, b in ((_P12[0], _P12[1]), (_P12[0], _P12[2]), (_P12[1], _P12[2]))
        ]
        + [f"SELECT 'unique', '{c}', 'num_unique', count(DISTINCT {c}) FROM lineitem" for c in (*_P12, "l_returnflag")]
        + [f"SELECT 'missing', '{c}', 'num_missing', count(*) - count({c}) FROM lineitem" for c in (*_P12, "l_returnflag")]
    ),
)
def p12(spark, sf):
    return rounded(pr.comprehensive_profile(table(spark, sf, "lineitem").select(*_P12, "l_returnflag")))


@query(
    "p13_cleaning_profile",
    union_sql(
        [f"SELECT 'missing' AS section, '{c}' AS item, CAST(count(*) - count({c}) AS VARCHAR) AS value FROM ({GAPPY_ORDERS_SQL})" for c in _GAPPY_COLS]
        + [
            "SELECT 'dataset', 'n_rows', CAST(count(*) AS VARCHAR) FROM orders",
            f"SELECT 'duplicates', 'num_duplicates', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({GAPPY_ORDERS_SQL}))) AS VARCHAR) FROM orders",
        ]
        + [
            f"""SELECT 'samples', '{c}', value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM ({GAPPY_ORDERS_SQL}) WHERE {c} IS NOT NULL
            ORDER BY value LIMIT 3)"""
            for c in _GAPPY_COLS
        ]
    ),
)
def p13(spark, sf):
    parts = pr.cleaning_profile(gappy_orders(spark, sf))
    rows = parts["missing"].select(F.lit("missing").alias("section"), F.col("column").alias("item"), F.col("num_missing").cast("string").alias("value"))
    rows = rows.unionByName(parts["dataset"].select(F.lit("dataset").alias("section"), F.lit("n_rows").alias("item"), F.col("n_rows").cast("string").alias("value")))
    rows = rows.unionByName(parts["duplicates"].select(F.lit("duplicates").alias("section"), F.lit("num_duplicates").alias("item"), F.col("num_duplicates").cast("string").alias("value")))
    return rows.unionByName(parts["samples"].select(F.lit("samples").alias("section"), F.col("column").alias("item"), "value"))


_WORDS = r"len([w FOR w IN regexp_split_to_array({t}, '\s+') IF w <> ''])"


@query(
    "p14_profile_text",
    f"""
    SELECT count(*) FILTER (text <> '') AS document_count, round(avg(length(text)) FILTER (text <> ''), 4) AS avg_text_length,
      CAST(min(length(text)) FILTER (text <> '') AS BIGINT) AS min_text_length, CAST(max(length(text)) AS BIGINT) AS max_text_length,
      round(avg({_WORDS.format(t="text")}) FILTER (text <> ''), 4) AS avg_token_count FROM documents
    """,
)
def p14(spark, sf):
    return rounded(ts.profile_text(table(spark, sf, "documents"), "text"))


BASIC_CLEAN_SQL = r"regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}_\s.,!?-]', '', 'g')"
_CLEANED = _WORDS.format(t=BASIC_CLEAN_SQL.format(t="text"))


@query(
    "p15_corpus_stats",
    f"""
    SELECT count(*) AS document_count, round(avg(n), 4) AS avg_doc_length, CAST(min(n) AS BIGINT) AS min_doc_length,
      CAST(max(n) AS BIGINT) AS max_doc_length, CAST(sum(n) AS BIGINT) AS total_words,
      CASE WHEN avg(n) > 50 THEN 'high' ELSE 'medium' END AS content_quality
    FROM (SELECT {_CLEANED} AS n FROM documents)
    """,
)
def p15(spark, sf):
    return rounded(ts.corpus_stats(table(spark, sf, "documents"), "text"))


def _language_sql():
    tokens = r"regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+')"
    votes = {
        code: f"len([w FOR w IN words IF list_contains([{', '.join(sql_text(w) for w in words)}], w)])"
        for code, words in sorted(rules.STOPWORDS.items())
    }
    best = "greatest(" + ", ".join(f"v_{c}" for c in votes) + ")"
    arms = " ".join(f"WHEN v_{c} = {best} THEN '{c}'" for c in votes)
    named = ", ".join(f"{v} AS v_{c}" for c, v in votes.items())
    return f"""SELECT lang, CASE WHEN {best} = 0 THEN 'unknown' {arms} END AS language
      FROM (SELECT lang, {named} FROM (SELECT lang, {tokens} AS words FROM documents WHERE trim(text) <> ''))"""


@query("p16_language_tally", f"SELECT language, count(*) AS count FROM ({_language_sql()}) GROUP BY 1")
def p16(spark, sf):
    return ts.language_tally(table(spark, sf, "documents"), "text")


@query("p16_language_vs_label", f"SELECT lang, language, count(*) AS count FROM ({_language_sql()}) GROUP BY 1, 2")
def p16_label(spark, sf):
    docs = table(spark, sf, "documents").withColumn("language", ts.language_of(F.col("text")))
    return docs.groupBy("lang", "language").agg(F.count("*").alias("count"))


@query(
    "p16_language_model",
    rf"""
    WITH words AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{language.WORD}')) AS w FROM documents WHERE lang IS NOT NULL),
    counted AS (SELECT lang, w, count(*) AS n FROM words WHERE length(w) <= {language.LONGEST} GROUP BY 1, 2),
    grams AS (SELECT lang, n, unnest([substr(' ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 1)]) AS gram FROM counted)
    SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM grams GROUP BY 1, 2""",
)
def p16_model(spark, sf):
    return language.gram_counts(table(spark, sf, "documents"), "text", "lang")


@query("p16_language_trigrams")
def p16_trigrams(spark, sf):
    """Documents by their own and the detected language; tests ask for held-out accuracy."""
    docs = table(spark, sf, "documents")
    model = language.fit_languages(docs, "text", "lang")
    return language.detect_language(docs, "text", model).groupBy("lang", "language").agg(F.count("*").alias("documents"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NUMBERS = "'TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE'"


@query(
    "p17_domain_from_columns",
    f"""
    WITH names AS (
      SELECT table_name, count(*) AS n_cols, lower(string_agg(column_name, ' ' ORDER BY ordinal_position)) AS low,
        avg((data_type IN ({_NUMBERS}) OR starts_with(data_type, 'DECIMAL'))::INT) AS share
      FROM information_schema.columns WHERE table_name IN ({', '.join(sql_text(t) for t in _TABLES)}) GROUP BY table_name
    ), sizes AS ({union_sql([f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES])}),
    named AS (SELECT *, {sql_first('low', rules.TABLE_TYPES, '')} AS kind FROM names)
    SELECT table_name, n_rows, CAST(n_cols AS INT) AS n_cols, {sql_first('low', rules.TABLE_DOMAINS_SHORT, 'General')} AS domain,
      {sql_first('low', rules.TABLE_DOMAINS_LONG, 'Mixed/General')} AS detailed_domain,
      CASE WHEN kind <> '' THEN kind WHEN share > 0.6 THEN 'Quantitative/Numeric dataset' ELSE 'Mixed structured data' END AS dataset_type
    FROM named JOIN sizes USING (table_name)""",
)
def p17(spark, sf):
    return sc.domain_from_columns(sc.catalog({name: spark.read.parquet(f"{sf}/{name}.parquet") for name in _TABLES}))


@query("p18_text_domain_first", f"SELECT doc_id, {sql_first('lower(text)', rules.TEXT_DOMAINS_FIRST, 'General')} AS domain FROM documents")
def p18(spark, sf):
    return ts.tag_domain(table(spark, sf, "documents"), "text", "first").select("doc_id", "domain")


def _scored_sql():
    scores = [sql_score("lower(text)", words) for _, words in rules.TEXT_DOMAINS_SCORED]
    named = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(scores))) + ")"
    arms = " ".join(f"WHEN s{i} = {best} THEN {sql_text(name)}" for i, (name, _) in enumerate(rules.TEXT_DOMAINS_SCORED))
    return f"SELECT page_id, CASE WHEN {best} < 2 THEN 'General' {arms} END AS domain FROM (SELECT page_id, {named} FROM (SELECT page_id, html AS text FROM pages))"


@query("p19_text_domain_score", _scored_sql())
def p19(spark, sf):
    return ts.tag_domain(table(spark, sf, "pages"), "html", "score").select("page_id", "domain")


_STATED = "concat('Notes. Domain: ', role, ' talk ', CAST(turn AS {s}), ', ', text)"


@query(
    "p20_stated_domain",
    f"SELECT conv_id, turn, trim(regexp_extract({_STATED.format(s='VARCHAR')}, '(?i)Domain[:\\s]*([^\\n,]+)', 1)) AS domain FROM conversations",
)
def p20(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("said", F.expr(_STATED.format(s="STRING")))
    return rows.select("conv_id", "turn", ts.stated_domain(F.col("said")).alias("domain"))


@query(
    "p21_temporal_density",
    """
    SELECT 'o_orderdate' AS "column", count(DISTINCT o_orderdate) AS time_points, count(*) AS n_rows,
      count(DISTINCT o_orderdate) >= 10 AND count(DISTINCT o_orderdate) <= 0.8 * count(*) AS is_series FROM orders
    """,
)
def p21(spark, sf):
    return pr.temporal_density(table(spark, sf, "orders"), "o_orderdate")


@query(
    "p22_image_profile",
    """
    SELECT count(*) AS num_images, round(avg(p_size * 40), 4) AS avg_width, round(avg(p_size * 30), 4) AS avg_height,
      round(avg(p_retailprice / 10), 4) AS avg_file_size_kb FROM part
    """,
)
def p22(spark, sf):
    images = table(spark, sf, "part").selectExpr("p_size * 40 AS width", "p_size * 30 AS height", "p_retailprice / 10 AS size_kb")
    return rounded(pr.image_profile(images))


def _profile_columns_sql():
    number = "round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, count(*) FILTER (abs(({c} - (SELECT avg({c}) FROM g)) / (SELECT stddev_samp({c}) FROM g)) > 3) AS num_outliers, CAST(NULL AS TIMESTAMP) AS min_date, CAST(NULL AS TIMESTAMP) AS max_date"
    none = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS BIGINT) AS num_outliers, {lo} AS min_date, {hi} AS max_date"
    kinds = {
        "o_orderkey": ("bigint", number.format(c="o_orderkey")),
        "o_totalprice": ("double", number.format(c="o_totalprice")),
        "o_orderstatus": ("string", none.format(lo="CAST(NULL AS TIMESTAMP)", hi="CAST(NULL AS TIMESTAMP)")),
        "o_orderdate": ("timestamp_ntz", none.format(lo="min(o_orderdate)", hi="max(o_orderdate)")),
    }
    parts = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS num_missing,
        round((count(*) - count({c})) / count(*), 4) AS pct_missing, count(DISTINCT {c}) AS num_unique, {rest} FROM g"""
        for c, (t, rest) in kinds.items()
    ]
    return f"WITH g AS ({GAPPY_ORDERS_SQL}) " + union_sql(parts)


@query("p23_profile_columns", _profile_columns_sql())
def p23(spark, sf):
    return rounded(pr.profile_columns(gappy_orders(spark, sf)))
