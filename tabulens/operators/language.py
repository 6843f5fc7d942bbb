"""Language of a text from its character trigrams, learnt from rows whose language is known.

Training is two aggregations: words by language, then the trigrams of distinct words, weighted by how often each occurs. The
model keeps the ``TOP`` commonest trigrams of every language and each one's logarithmic share in all languages, so it is small
whatever the data; it travels to the tasks as a broadcast. A text goes to the language under which its trigrams are likeliest.

Words are runs of ASCII letters and characters beyond ASCII, lower-cased, with a space at either end; those of more than
``LONGEST`` characters are no words of a language and are left out. A text without a known trigram has no language. Ties go to
the first language by name. Rows without a language or text teach nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.functions.nulls import quoted

TOP = 400
LONGEST = 40
#: What a trigram counts at least in every language.
SMOOTH = 0.5
WORD = r"[^\x00-\x60\x7B-\x7F]+"
_FIND = re.compile(WORD).findall


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)``: how often each trigram occurs in the words of a language."""
    known = df.where(quoted(lang).isNotNull()).select(quoted(lang).cast("string").alias("lang"), F.lower(quoted(text)).alias("t"))
    words = known.select("lang", F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("w")).where(F.length("w") <= LONGEST)
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substr(padded, i, F.lit(3)))
    return words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """For each trigram the logarithm of its share in every language."""

    languages: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]

    def scores(self, word: str) -> tuple[float, ...] | None:
        found = [w for i in range(len(word)) if (w := self.weights.get(f" {word} "[i : i + 3]))]
        return tuple(map(sum, zip(*found))) if found else None


class _Words(dict):
    """Where the scores of a word are among those met; 0 for words without any, whose scores change nothing."""

    KEPT = 200_000

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.table, self.used = model, np.zeros((1024, len(model.languages))), 1

    def __missing__(self, word: str) -> int:
        found = self.model.scores(word) if len(word) <= LONGEST else None
        if found is None:
            if len(word) <= LONGEST:
                self[word] = 0
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = found
        self[word], self.used = self.used, self.used + 1
        return self[word]

    def language(self, text: str | None) -> str | None:
        if len(self) >= self.KEPT:
            self.clear()
            self.used = 1
        words = _FIND((text or "").lower())
        at = np.fromiter(map(self.__getitem__, words), np.intp, len(words))
        if not at.any():
            return None
        # The first of equal ones.
        return self.model.languages[self.table.take(at, axis=0).sum(axis=0).argmax()]


def fit_languages(df: DataFrame, text: str, lang: str, top: int = TOP) -> LanguageModel:
    """A model from all rows with a language; ``top`` trigrams of each reach the driver."""
    counts = gram_counts(df, text, lang).persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        common = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        kept = counts.withColumn("rank", F.row_number().over(common)).where(F.col("rank") <= top).select("gram").distinct()
        found = {(r["lang"], r["gram"]): r["n"] for r in counts.join(F.broadcast(kept), "gram").collect()}
    finally:
        counts.unpersist()
    languages = tuple(sorted(totals))
    share = lambda g, k: math.log((found.get((k, g), 0) + SMOOTH) / (totals[k] + SMOOTH))
    return LanguageModel(languages, {g: tuple(share(g, k) for k in languages) for g in sorted({g for _, g in found})})


def detect_language(df: DataFrame, text: str, model: LanguageModel, out: str = "language") -> DataFrame:
    """The rows with the language of a text; missing where it has no known trigram."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    @arrow_udf("string")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _Words(LanguageModel(*shared.value))
        for texts in batches:
            yield pa.array([words.language(t.as_py()) for t in texts], pa.string())

    return df.withColumn(out, named(quoted(text).cast("string")))
