"""Text expressions. ``(?U)`` makes Java's classes Unicode aware, so accented letters count as word characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_STEPS = ("strip", "lowercase", "remove_punct", "remove_numbers", "remove_stopwords")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The characters Python's ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def remove_punct(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]", "")


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d+", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def basic_clean(text: Column) -> Column:
    """Single spaces; only word characters, spaces and ``.,!?-`` stay."""
    return F.regexp_replace(collapse_spaces(text), r"(?U)[^\w\s.,!?\-]", "")


def tokens(text: Column) -> Column:
    """Runs of word characters, as an array."""
    return F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Whitespace-separated words; blank text has none."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def remove_stopwords(text: Column, words: Sequence[str], min_len: int = 2) -> Column:
    keep = F.filter(tokens(text), lambda w: (F.length(w) >= min_len) & ~w.isin(list(words)))
    return F.array_join(keep, " ")


def normalize_document(text: Column, words: Sequence[str], min_len: int = 3) -> Column:
    """Lower case, no digits, no ASCII punctuation, no stop words, no short words."""
    bare = remove_numbers(F.lower(collapse_spaces(text)))
    bare = F.regexp_replace(bare, r"\p{Punct}", "")
    return remove_stopwords(bare, words, min_len)


def title_case(text: Column) -> Column:
    """Every letter that follows a non-letter is upper case, all others lower (``O'Neil Ab-Cd``)."""
    runs = F.split(F.lower(text), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))),
        "",
    )


# Keyword rules are SQL text over a column name: one expression to parse instead of a call per keyword.


def _literal(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(column: str, words: Iterable[str]) -> str:
    """SQL: does the text hold any of the words, inside longer words too?"""
    return "(" + " OR ".join(f"contains({column}, {_literal(w)})" for w in words) + ")"


def score_of(column: str, words: Iterable[str]) -> str:
    """SQL: how many of the words the text holds."""
    return "(" + " + ".join(f"int(contains({column}, {_literal(w)}))" for w in words) + ")"


def first_of(column: str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> str:
    """SQL: label of the first rule with any word in the text."""
    arms = " ".join(f"WHEN {any_of(column, words)} THEN {_literal(label)}" for label, words in rules)
    return f"CASE {arms} ELSE {_literal(default)} END"


def pattern_of(words: Iterable[str]) -> str:
    """The same test as a regular expression, for use on array elements."""
    return "|".join(re.escape(w) for w in words)


def with_scores(df: DataFrame, column: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Adds ``_scores``, the score of every rule in order, and ``_best``, the highest."""
    scores = ", ".join(score_of(column, words) for _, words in rules)
    return df.withColumn("_scores", F.expr(f"array({scores})")).withColumn("_best", F.array_max("_scores"))


def best_label(rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first rule with the highest score, after ``with_scores``."""
    names = ", ".join(_literal(label) for label, _ in rules)
    return F.expr(f"get(array({names}), int(array_position(_scores, _best)) - 1)")
