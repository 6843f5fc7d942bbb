"""Text analytics and tagging (T)."""

from pyspark.sql import functions as F

from queries.common import QUESTION_SQL, questions, query, rounded, sql_any, sql_first, sql_score, sql_text, table
from tabulens.functions import rules
from tabulens.operators import charts as ch
from tabulens.operators import textstats as ts

_TOKENS = r"regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{M}}\p{{N}}_]+')"
_FREQ = f"SELECT word, count(*) AS count FROM (SELECT unnest({_TOKENS.format(t='text')}) AS word FROM documents) WHERE word <> '' GROUP BY 1"


@query("t01_word_freq", _FREQ)
def t01(spark, sf):
    return ts.word_freq(table(spark, sf, "documents"), "text")


@query(
    "t02_word_cloud",
    f"""WITH w AS (SELECT * FROM ({_FREQ}) ORDER BY count DESC, word LIMIT 100)
    SELECT word, count, round(count / (SELECT max(count) FROM w), 6) AS weight FROM w""",
)
def t02(spark, sf):
    return rounded(ts.word_cloud(table(spark, sf, "documents"), "text"), 6)


def _hits(side):
    words = ", ".join(sql_text(w) for w in rules.SENTIMENT_LEXICON[side])
    return f"len([w FOR w IN {_TOKENS.format(t='text')} IF list_contains([{words}], w)])"


@query(
    "t03_sentiment",
    f"""SELECT CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS count
    FROM (SELECT {_hits('positive')} - {_hits('negative')} AS s FROM documents) GROUP BY 1""",
)
def t03(spark, sf):
    return ts.sentiment(table(spark, sf, "documents"), "text")


@query("t03_sentiment_learnt")
def t03_learnt(spark, sf):
    """Documents by label and sign of the score learnt from the labels; tests ask for held-out accuracy."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", (1 - F.col("toxic")).alias("kind"))
    rows = docs.join(labels, "doc_id", "left")
    scored = ts.learnt_sentiment(rows, "text", ts.fit_sentiment(rows, "text", "kind"))
    return scored.groupBy("kind", (F.col("sentiment_score") > 0).alias("positive")).agg(F.count("*").alias("documents"))


@query(
    "t04_labelled_sentiment",
    """SELECT category, count, round(count / sum(count) OVER (), 6) AS share
    FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS category, count(*) AS count FROM labels GROUP BY 1)""",
)
def t04(spark, sf):
    label = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END")
    return rounded(ch.pie(table(spark, sf, "labels").withColumn("sentiment", label), "sentiment"), 6)


def _asked(select):
    return f"SELECT conv_id, turn, question, {select} FROM (SELECT *, lower(question) AS q FROM ({QUESTION_SQL}))"


_ROUTE = "CASE {i} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.INTENT_ROUTES.items()) + " END"
_ORDERED = sql_first("q", rules.INTENTS_ORDERED, "descriptive")


@query(
    "t05_intent_ordered",
    _asked(f"{_ORDERED} AS intent, CAST(0.6 AS DOUBLE) AS confidence, {_ROUTE.format(i='(' + _ORDERED + ')')} AS route"),
)
def t05(spark, sf):
    return ts.classify_intent(questions(spark, sf).select("conv_id", "turn", "question"), "question")


def _scored():
    st, an, de = (sql_score("q", words) for _, words in rules.INTENTS_SCORED)
    return f"""
    SELECT conv_id, turn, question,
      CASE WHEN st >= an AND st >= de THEN 'statistical' WHEN an >= de THEN 'analytical' ELSE 'descriptive' END AS intent,
      CASE WHEN st + an + de > 0 THEN round(greatest(st, an, de) / (st + an + de), 6) ELSE 0.5 END AS confidence
    FROM ({_asked(f"{st} AS st, {an} AS an, {de} AS de")})"""


@query("t06_intent_scored", _scored())
def t06(spark, sf):
    return rounded(ts.classify_intent(questions(spark, sf).select("conv_id", "turn", "question"), "question", "scored"), 6)


@query("t07_question_bucket", _asked(sql_first("q", rules.QUESTION_BUCKETS, "analytical") + " AS bucket"))
def t07(spark, sf):
    return ts.question_bucket(questions(spark, sf).select("conv_id", "turn", "question"), "question")


@query(
    "t08_needs_calculation",
    f"SELECT conv_id, turn, {sql_any('lower(text)', rules.CALCULATION_WORDS)} AS calculation FROM conversations",
)
def t08(spark, sf):
    return ts.needs_calculation(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "calculation")


@query("t09_context_kind", _asked(sql_first("q", rules.CONTEXT_KINDS, "general") + " AS context"))
def t09(spark, sf):
    return ts.context_kind(questions(spark, sf).select("conv_id", "turn", "question"), "question")


_VARIED = "concat(question, CASE WHEN turn % 2 = 0 THEN ' ' ELSE ' for segment ' END, CASE WHEN turn % 2 = 0 THEN '' ELSE CAST(turn AS {s}) END)"
_TURNS = "list_position([" + ", ".join(f"'{b}'" for b in rules.BUCKET_TURNS) + "], bucket)"


@query(
    "t10_diversify",
    f"""
    WITH v AS (SELECT conv_id, turn, trim({_VARIED.format(s='VARCHAR')}) AS question FROM ({QUESTION_SQL})),
    u AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(question), '\\s+', ' ', 'g') ORDER BY conv_id, turn) AS copy FROM v),
    b AS (SELECT conv_id, turn, question, {sql_first('lower(question)', rules.QUESTION_BUCKETS, 'analytical')} AS bucket FROM u WHERE copy = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY conv_id, turn) AS n FROM b)
    SELECT conv_id, turn, question, bucket, CAST(n AS INT) AS turn_in_bucket FROM r ORDER BY n, {_TURNS} LIMIT 12
    """,
)
def t10(spark, sf):
    rows = questions(spark, sf).selectExpr("conv_id", "turn", f"{_VARIED.format(s='STRING')} AS question")
    return ts.diversify(rows, "question", ["conv_id", "turn"], 12)


_FREE = "concat('Notes\n1. ', question, '?\n - ', role, ' asks: how much did it change?\n', text)"


def _extract_sql():
    lists = ", ".join(f"regexp_extract_all(said, {sql_text(p)}, 1)" for p in ts.QUESTION_PATTERNS)
    clean = rf"[regexp_replace(trim(m, ' ' || chr(9) || chr(10) || chr(13)), '^\d+\.\s*|^[-•*]\s*', '') FOR m IN flatten([{lists}])]"
    return f"""
    WITH s AS (SELECT conv_id, turn, {_FREE.replace(chr(10), "' || chr(10) || '")} AS said FROM ({QUESTION_SQL})),
    f AS (SELECT conv_id, turn, [m FOR m IN {clean} IF length(m) > 10] AS found FROM s),
    e AS (SELECT conv_id, turn, unnest(found) AS question, generate_subscripts(found, 1) AS i FROM f),
    d AS (SELECT conv_id, turn, question, min(i) AS i FROM e GROUP BY ALL)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INT) AS position, question FROM d"""


@query("t11_extract_questions", _extract_sql())
def t11(spark, sf):
    rows = questions(spark, sf).selectExpr("conv_id", "turn", f"{_FREE.replace(chr(10), chr(92) + 'n')} AS said")
    return ts.extract_questions(rows, "said", ["conv_id", "turn"])


_ASKED = "concat('1. What patterns explain ', role, ' sales and the trend of turn ', turn, '?\n2. Tell me about the impact on sales in detail?\n3. ', question)"


@query("t11_extract_strict")
def t11_strict(spark, sf):
    """The patterns look ahead, which DuckDB's cannot."""
    rows = questions(spark, sf).selectExpr("conv_id", "turn", f"{_ASKED.replace(chr(10), chr(92) + 'n')} AS said")
    return ts.extract_questions(rows, "said", ["conv_id", "turn"], strict=True)


@query(
    "t11_numbered_lines",
    rf"""WITH s AS (SELECT conv_id, turn, {_ASKED.replace(chr(10), "' || chr(10) || '")} AS said FROM ({QUESTION_SQL})),
    f AS (SELECT conv_id, turn, regexp_extract_all(said, '\d+\.\s*(.+)', 1) AS l FROM s)
    SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INT) AS position, unnest(l) AS line FROM f""",
)
def t11_numbered(spark, sf):
    said = F.expr(_ASKED.replace(chr(10), chr(92) + "n"))
    return questions(spark, sf).select("conv_id", "turn", F.posexplode(ts.numbered_lines(said)).alias("position", "line"))


_ANSWER = """concat(CASE (conv_id + turn) % 5 WHEN 0 THEN 'The analysis shows that the average total is highest here. '
  WHEN 1 THEN 'Based on the data the trend and the correlation are significant, growth follows. '
  WHEN 2 THEN 'Unfortunately there is insufficient data, I would need more. ' WHEN 3 THEN 'Yes ' ELSE '' END, text)"""


@query(
    "t12_answer_flags",
    f"""
    SELECT conv_id, turn,
      length(trim(a, ' ' || chr(9) || chr(10) || chr(13))) >= 100 AND {sql_score('lower(a)', rules.ANALYSIS_INDICATORS)} >= 2 AS substantial,
      {sql_any('lower(a)', rules.DATA_INDICATORS)} AND NOT {sql_any('lower(a)', rules.GENERIC_PHRASES)} AS data_driven,
      length(trim(a, ' ' || chr(9) || chr(10) || chr(13))) >= 50 AND {sql_score('lower(a)', rules.INSIGHT_INDICATORS)} >= 3
        AND NOT {sql_any('lower(a)', rules.EVASIVE_PHRASES)} AS insightful
    FROM (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations)
    """,
)
def t12(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER} AS answer")
    return ts.answer_flags(rows, "answer").drop("answer")
