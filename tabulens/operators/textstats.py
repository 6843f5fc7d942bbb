"""Corpus statistics and rule-based tagging of text columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions import rules
from tabulens.functions import text as tx
from tabulens.functions.nulls import quoted
from tabulens.operators.profile import smallest_per_group

#: Words that a learnt sentiment keeps at most.
SENTIMENT_WORDS = 500

# ---- corpus --------------------------------------------------------------------------------------


def profile_text(df: DataFrame, col: str) -> DataFrame:
    """Length and token statistics over the texts that are not empty."""
    t = quoted(col)
    return df.agg(
        F.count_if(t != "").alias("document_count"),
        F.coalesce(F.avg(F.when(t != "", F.length(t))), F.lit(0.0)).alias("avg_text_length"),
        F.coalesce(F.min(F.when(t != "", F.length(t))), F.lit(0)).cast("bigint").alias("min_text_length"),
        F.coalesce(F.max(F.length(t)), F.lit(0)).cast("bigint").alias("max_text_length"),
        F.coalesce(F.avg(F.when(t != "", tx.word_count(t))), F.lit(0.0)).alias("avg_token_count"),
    )


def corpus_stats(df: DataFrame, col: str) -> DataFrame:
    """Words per document after basic cleaning; quality is high above 50 words on average."""
    n = tx.word_count(tx.basic_clean(quoted(col)))
    return df.agg(
        F.count("*").alias("document_count"),
        F.avg(n).alias("avg_doc_length"),
        F.min(n).cast("bigint").alias("min_doc_length"),
        F.max(n).cast("bigint").alias("max_doc_length"),
        F.sum(n).cast("bigint").alias("total_words"),
        F.when(F.avg(n) > 50, "high").otherwise("medium").alias("content_quality"),
    )


def language_of(text: Column, stopwords: Mapping[str, Sequence[str]] = rules.STOPWORDS) -> Column:
    """The language with most function words in the text; the alphabetically first on ties, ``unknown`` without any."""
    every = sorted({w for words in stopwords.values() for w in words})
    # Most words are in no list: one pass leaves the few the counts below go over.
    common = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w.isin(every))

    def winner(words: Column) -> Column:
        def count_of(stop: Sequence[str]) -> Column:
            return F.size(F.filter(words, lambda w: w.isin(list(stop))))

        votes = [
            F.struct(count_of(stop).alias("votes"), F.lit(-i).alias("rank"), F.lit(code).alias("code"))
            for i, (code, stop) in enumerate(sorted(stopwords.items()))
        ]
        # Wins over languages without a vote, loses to any with one.
        nobody = F.struct(F.lit(0).alias("votes"), F.lit(1).alias("rank"), F.lit("unknown").alias("code"))
        return F.array_max(F.array(nobody, *votes))["code"]

    return tx.let(common, winner)


def language_tally(
    df: DataFrame, col: str, stopwords: Mapping[str, Sequence[str]] = rules.STOPWORDS
) -> DataFrame:
    """Number of non-blank texts per language."""
    rows = df.where(tx.strip(quoted(col)) != "")
    return rows.groupBy(language_of(quoted(col), stopwords).alias("language")).agg(F.count("*").alias("count"))


def tag_domain(df: DataFrame, col: str, how: str = "first") -> DataFrame:
    """Adds ``domain``. ``first``: the first domain with any keyword. ``score``: most keywords, two at least, else General."""
    if how == "first":
        return tag_first(df, col, "domain", rules.TEXT_DOMAINS_FIRST, "General")
    found = tx.with_scores(df.withColumn("_low", F.lower(quoted(col))), "_low", rules.TEXT_DOMAINS_SCORED)
    enough = F.col("_best") >= rules.TEXT_DOMAIN_MIN_SCORE
    domain = F.when(enough, tx.best_label(rules.TEXT_DOMAINS_SCORED)).otherwise("General")
    return found.withColumn("domain", domain).drop("_low", "_scores", "_best")


def tag_first(
    df: DataFrame, col: str, out: str, rule_set: Sequence[tuple[str, Sequence[str]]], default: str
) -> DataFrame:
    """Adds the label of the first rule with any word in the text, case aside."""
    low = df.withColumn("_low", F.lower(quoted(col)))
    return low.withColumn(out, F.expr(tx.first_of("_low", rule_set, default))).drop("_low")


def stated_domain(text: Column) -> Column:
    """What follows ``Domain:`` in a text; NULL where nothing does."""
    found = F.trim(F.regexp_extract(text, r"(?i)Domain[:\s]*([^\n,]+)", 1))
    return F.when(found != "", found)


# ---- words ---------------------------------------------------------------------------------------


def word_freq(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Occurrences per lower-case word; partial counts keep frequent words from piling up in one task."""
    words = df.select(F.explode(F.split(F.lower(quoted(col)), r"(?U)\W+")).alias("word"))
    counts = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))
    return counts if k is None else counts.orderBy(F.desc("count"), "word").limit(k)


def word_cloud(df: DataFrame, col: str, k: int = 100) -> DataFrame:
    """The k most frequent words, weighted against the most frequent one."""
    # The window runs over the k rows that are left.
    most = F.max("count").over(Window.partitionBy())
    return word_freq(df, col, k).withColumn("weight", F.col("count") / most)


def sentiment_score(text: Column, lexicon: Mapping[str, Sequence[str]] = rules.SENTIMENT_LEXICON) -> Column:
    """Positive minus negative words."""
    good, bad = list(lexicon["positive"]), list(lexicon["negative"])
    known = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w.isin([*good, *bad]))
    return F.aggregate(known, F.lit(0), lambda total, w: total + F.when(w.isin(good), 1).otherwise(-1))


def sentiment(df: DataFrame, col: str, lexicon: Mapping[str, Sequence[str]] = rules.SENTIMENT_LEXICON) -> DataFrame:
    """Number of positive, neutral and negative texts."""
    s = sentiment_score(quoted(col), lexicon)
    label = F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")
    return df.groupBy(label.alias("sentiment")).agg(F.count("*").alias("count"))


@dataclass(frozen=True)
class SentimentModel:
    """What each telling word adds to the score of a text; above zero is positive."""

    bias: float
    weights: dict[str, float]


def fit_sentiment(
    df: DataFrame, text: str, label: str, top: int = SENTIMENT_WORDS, lexicon: Mapping[str, Sequence[str]] = rules.SENTIMENT_LEXICON
) -> SentimentModel:
    """Word weights from texts labelled 1 (positive) or 0 (negative), in aggregations; other labels teach nothing.

    A word weighs the logarithm of its share of positive texts over that of negative ones. Words whose weight is less than two
    standard errors are left out, and of the others the ``top`` surest are kept. The lexicon is where it starts: each of its
    words counts as having been in one more text of its side. Words go together in texts, so the bias is moved to where zero
    is midway between the mean scores of both sides.
    """
    known = df.where(quoted(label).isin(0, 1)).select(quoted(label).cast("int").alias("y"), F.array_distinct(tx.tokens(F.lower(quoted(text)))).alias("words"))
    sides = known.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("q")).first()
    counts = known.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    p = F.col("p") + 0.5 + F.col("w").isin(*lexicon["positive"]).cast("int")
    q = F.col("q") + 0.5 + F.col("w").isin(*lexicon["negative"]).cast("int")
    weight = F.log(p / F.lit(sides["p"] + 1.0)) - F.log(q / F.lit(sides["q"] + 1.0))
    sure = F.abs(weight) / F.sqrt(1 / p + 1 / q)
    kept = counts.select("w", weight.alias("weight"), sure.alias("sure")).where("sure >= 2").orderBy(F.desc("sure"), "w").limit(top)
    model = SentimentModel(math.log((sides["p"] + 1) / (sides["q"] + 1)), {r["w"]: r["weight"] for r in kept.collect()})
    scored = learnt_sentiment(df.where(quoted(label).isin(0, 1)), text, model, "_score").groupBy(quoted(label).cast("int").alias("y"))
    means = {r["y"]: r["s"] for r in scored.agg(F.avg("_score").alias("s")).collect()}
    return SentimentModel(model.bias - sum(means.values()) / 2, model.weights) if len(means) == 2 else model


def learnt_sentiment(df: DataFrame, text: str, model: SentimentModel, out: str = "sentiment_score") -> DataFrame:
    """The rows with the score of a text: the bias and the weights of its distinct telling words."""
    if not model.weights:
        return df.withColumn(out, F.lit(model.bias))
    # Few words are left when their weights are looked up.
    telling = F.filter(F.array_distinct(tx.tokens(F.lower(F.coalesce(quoted(text), F.lit(""))))), lambda w: w.isin(list(model.weights)))
    weights = F.map_from_arrays(F.array(*map(F.lit, model.weights)), F.array(*map(F.lit, model.weights.values())))
    return df.withColumn(out, F.aggregate(telling, F.lit(model.bias), lambda total, w: total + F.element_at(weights, w)))


# ---- questions -----------------------------------------------------------------------------------


def classify_intent(
    df: DataFrame, col: str, how: str = "ordered", routes: Mapping[str, str] = rules.INTENT_ROUTES
) -> DataFrame:
    """Adds ``intent`` and ``confidence``; ``ordered`` also the route that answers such questions."""
    if how == "ordered":
        route = ", ".join(f"'{k}', '{v}'" for k, v in routes.items())
        out = tag_first(df, col, "intent", rules.INTENTS_ORDERED, "descriptive")
        return out.withColumn("confidence", F.lit(0.6)).withColumn("route", F.expr(f"element_at(map({route}), intent)"))
    found = tx.with_scores(df.withColumn("_low", F.lower(quoted(col))), "_low", rules.INTENTS_SCORED)
    total = F.aggregate("_scores", F.lit(0), lambda a, b: a + b)
    return (
        found.withColumn("intent", tx.best_label(rules.INTENTS_SCORED))
        .withColumn("confidence", F.coalesce(F.try_divide("_best", total), F.lit(0.5)))
        .drop("_low", "_scores", "_best")
    )


def question_bucket(df: DataFrame, col: str) -> DataFrame:
    """Adds ``bucket``: comparative, correlation, distribution, trend, predictive, statistical or analytical."""
    return tag_first(df, col, "bucket", rules.QUESTION_BUCKETS, "analytical")


def needs_calculation(df: DataFrame, col: str) -> DataFrame:
    """Adds ``calculation``: does answering take arithmetic?"""
    low = df.withColumn("_low", F.lower(quoted(col)))
    return low.withColumn("calculation", F.expr(tx.any_of("_low", rules.CALCULATION_WORDS))).drop("_low")


def context_kind(df: DataFrame, col: str) -> DataFrame:
    """Adds ``context``: comparison, temporal, correlation, distribution, specific_value or general."""
    return tag_first(df, col, "context", rules.CONTEXT_KINDS, "general")


def diversify(df: DataFrame, col: str, order_by: Sequence[str], limit: int) -> DataFrame:
    """Texts without near-duplicates (case and spacing aside), one from each kind in turn, up to ``limit``.

    Of equal texts the first in order stays; grouping finds it with a partial aggregate, so many copies of
    one text cost nothing extra. Only the first ``limit`` of each kind can be chosen and reach the final sort.
    """
    text = tx.strip(quoted(col))
    key = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    place = F.struct(*[quoted(c) for c in order_by])
    unique = (
        df.where(quoted(col).isNotNull())
        .groupBy(key.alias("_key"))
        .agg(F.min_by(F.struct(text.alias("question"), *[quoted(c) for c in order_by]), place).alias("r"))
        .select("r.*")
    )
    unique = question_bucket(unique, "question")
    turns = F.array(*[F.lit(b) for b in rules.BUCKET_TURNS])
    first = smallest_per_group(unique, ["bucket"], list(order_by), limit)
    return (
        first.orderBy("rank", F.array_position(turns, F.col("bucket")), *order_by)
        .limit(limit)
        .select(*order_by, "question", "bucket", F.col("rank").alias("turn_in_bucket"))
    )


# How questions are written in free text, in the order they are looked for.
QUESTION_PATTERNS = (
    r"(?im)\d+\.\s*(.+?\?)",
    r"(?im)(?:^|\n)\s*([^?\n]{10,}\?)",
    r"(?im)(?:Question|Q)\s*\d*:?\s*(.+?\?)",
    r"(?im)(?:^|\n)\s*[-•*]\s*(.+?\?)",
    r"(?im)(?:^|\n)([A-Z][^?\n]{10,}\?)",
)
# The same for longer, analytical questions.
STRICT_QUESTION_PATTERNS = (
    r"(?im)(?:^|\n)\s*\d+\.\s*([^\n]{20,}\?)\s*(?=\n|$)",
    r"(?im)(?:^|\n)\s*-\s*([^\n]{20,}\?)\s*(?=\n|$)",
    r"(?im)(?:^|\n)\s*\*\s*([^\n]{20,}\?)\s*(?=\n|$)",
    r"(?im)(?:^|\n)\s*([A-Z][^\n]{20,}\?)\s*(?=\n|$)",
    r'(?im)"([^"]{20,}\?)"',
    r"(?im)(?:Question|Q)\s*\d*:?\s*([^\n]{20,}\?)",
)
# Marks of an analytical question, and phrases that rule one out.
ANALYTICAL_TERMS = (
    "correlation", "trend", "pattern", "cycle", "volatility", "impact", "during which", "how has",
    "what patterns", "which periods", "contributed most", "fluctuate", "compare", "versus", "relationship",
    "analysis", "dynamics", "evolution", "components", "factors",
)
PLAIN_PHRASES = (
    "what is", "tell me about", "describe", "explain the basic", "what are some", "give me", "list the", "show me",
)
# Numbering and bullets in front of a question, and the words that open one.
_NUMBERING = r"^\d+\.\s*|^[-•*]\s*"
# What a longer question loses at either end.
_STRICT_ENDS = r'^\d+\.\s*|^[-*]\s*|^"|"$'
_QUESTION_WORDS = ("what", "how", "why", "which", "where", "when")


def questions_in(text: Column, strict: bool = False) -> Column:
    """The distinct questions of a text, in the order the patterns find them.

    Without any, lines that read like a question are taken and given a question mark (not in strict mode).
    """
    patterns = STRICT_QUESTION_PATTERNS if strict else QUESTION_PATTERNS
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    clean = F.transform(found, lambda q: F.regexp_replace(tx.strip(q), _STRICT_ENDS if strict else _NUMBERING, ""))
    if strict:
        asked = F.transform(clean, lambda q: F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?"))))
        clean = F.transform(asked, tx.strip)

        def analytical(q: Column) -> Column:
            low = F.lower(q)
            wanted, plain = tx.pattern_of(ANALYTICAL_TERMS), tx.pattern_of(PLAIN_PHRASES)
            return (F.length(q) > 30) & low.rlike(wanted) & ~low.rlike(plain)

        return F.array_distinct(F.filter(clean, analytical))
    kept = F.filter(clean, lambda q: F.length(q) > 10)
    lines = F.transform(F.split(text, "\n"), tx.strip)

    def asks(line: Column) -> Column:
        return (F.length(line) > 10) & F.lower(line).rlike(tx.pattern_of(("?", *_QUESTION_WORDS)))

    bare = F.transform(F.filter(lines, asks), lambda s: F.regexp_replace(s, _NUMBERING, ""))
    marked = F.transform(bare, lambda s: F.when(F.endswith(s, F.lit("?")), s).otherwise(F.concat(s, F.lit("?"))))
    return tx.let(kept, lambda k: F.array_distinct(F.when(F.size(k) > 0, k).otherwise(marked)))


def numbered_lines(text: Column) -> Column:
    """What follows ``1.``, ``2.`` and so on."""
    return F.regexp_extract_all(text, F.lit(r"\d+\.\s*(.+)"), F.lit(1))


def extract_questions(df: DataFrame, col: str, keep: Sequence[str], strict: bool = False) -> DataFrame:
    """One row per question, with its position in the text."""
    return df.select(
        *[quoted(c) for c in keep], F.posexplode(questions_in(quoted(col), strict)).alias("position", "question")
    )


def answer_flags(df: DataFrame, col: str) -> DataFrame:
    """Adds ``substantial``, ``data_driven`` and ``insightful``."""
    found = df.withColumn("_low", F.lower(quoted(col))).withColumn("_size", F.length(tx.strip(quoted(col))))
    low = "_low"
    return found.withColumns(
        {
            "substantial": F.expr(f"_size >= 100 AND {tx.score_of(low, rules.ANALYSIS_INDICATORS)} >= 2"),
            "data_driven": F.expr(
                f"{tx.any_of(low, rules.DATA_INDICATORS)} AND NOT {tx.any_of(low, rules.GENERIC_PHRASES)}"
            ),
            "insightful": F.expr(
                f"_size >= 50 AND {tx.score_of(low, rules.INSIGHT_INDICATORS)} >= 3"
                f" AND NOT {tx.any_of(low, rules.EVASIVE_PHRASES)}"
            ),
        }
    ).drop("_low", "_size")
