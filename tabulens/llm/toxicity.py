"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's words, and the beginnings of words (``BEGINNINGS`` letters), add up to a logit; a document is toxic if any of its
sentences is (noisy-or): ``p(document) = 1 - prod(1 - p(sentence))``. Beginnings are what words that are bent or put together
in many ways have in common, each of which is too rare to tell by itself. The weights are fitted to the labels of documents
alone by minimising the cross entropy of that probability, with a sparsity penalty that leaves weights only to what tells; so
the sentences at fault come out of the fit without having been labelled. The penalty is the one of ``PENALTIES`` that does
best on a fold of the training rows (one in ``INNER``) after a fit to the others; then all are fitted with it.

Training takes at most ``PER_CLASS`` documents of each label and ``VOCABULARY`` features: those in at least ``MIN_DOCS`` of the
sampled documents whose share differs most between the labels, counted by Spark. What reaches the driver is the sampled
sentences as feature numbers. Classes are weighted back to their true shares. Scoring looks at every sentence of every text.

Edge cases: a null or empty text has no sentence and scores 0. Without labelled documents of both kinds every sentence has
the smoothed share of toxic documents as its probability. Null labels and null ids are no training rows. Repeated rows score
alike. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import col, small_batches
from tabulens.llm.labelled import fold_of, labelled_sample

PER_CLASS = 2500
VOCABULARY = 5000
MIN_DOCS = 4
STEPS = 150
#: Lengths of the beginnings of words.
BEGINNINGS = range(4, 11)
PENALTIES = (1e-3, 3e-4, 1e-4, 3e-5)
INNER = 4

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans that hold a word, ended by one of .!? or a line break."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if _WORD.search(m[0])]


def features(word: str) -> list[str]:
    """A word and its beginnings, which end in a sign that no word holds."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if k < len(word))]


class _Telling(dict):
    """Of a word, the features that have a weight; remembered up to a bound."""

    KEPT = 200_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> list[str]:
        found = [f for f in features(word) if f in self.weights]
        if len(self) >= self.KEPT:
            self.clear()
        self[word] = found
        return found


@dataclass(frozen=True)
class Model:
    """Logit weights of features and the logit of a sentence without any of them."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def reader(self) -> Callable[[str | None], list[tuple[int, int, float]]]:
        """A function from a text to (start, end, probability) of every sentence; each feature counts once in a sentence."""
        telling = _Telling(self.weights)

        def read(text: str | None) -> list[tuple[int, int, float]]:
            text, out = text or "", []
            for start, end in sentences(text):
                found = {f for word in set(_WORD.findall(text[start:end].lower())) for f in telling[word]}
                # The exact sum does not depend on the order of a set.
                logit = math.fsum((self.bias, *(self.weights[f] for f in found)))
                out.append((start, end, 1.0 / (1.0 + math.exp(-max(-700.0, logit)))))
            return out

        return read

    def sentence_probabilities(self, text: str | None) -> list[tuple[int, int, float]]:
        return self.reader()(text)


def noisy_or(probabilities: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-12)).sum())) if probabilities else 0.0


def fit(bags: list[list[list[int]]], labels: np.ndarray, weight: np.ndarray, n_words: int, base_rate: float, steps: int = STEPS, penalty: float = PENALTIES[0]) -> tuple[float, np.ndarray]:
    """Bias and weights for documents given as sentences of distinct feature numbers: Adam with soft thresholding."""
    keep = [i for i, bag in enumerate(bags) if bag]
    y, weight = labels[keep].astype(float), weight[keep] / weight[keep].sum()
    lens = np.array([len(s) for i in keep for s in bags[i]])
    words = np.array([w for i in keep for s in bags[i] for w in s], int)
    of_sentence = np.repeat(np.arange(len(lens)), lens)
    per_doc = np.array([len(bags[i]) for i in keep])
    of_doc = np.repeat(np.arange(len(keep)), per_doc)
    w, bias = np.zeros(n_words), float(np.log(base_rate / np.mean(per_doc)))
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(of_sentence, w[words], len(lens))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(keep))
        doc = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        slope = (weight * np.where(y == 1, -(1 - doc) / doc, 1.0))[of_doc] * p
        g, gb = np.bincount(words, slope[of_sentence], n_words), slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, rate = np.sqrt(1 - 0.99**step) / (1 - 0.9**step), 0.1
        move = rate * fix / (np.sqrt(v) + 1e-6)
        w = w - move * m
        w = np.sign(w) * np.maximum(np.abs(w) - move * penalty, 0)
        bias -= rate * fix * mb / (np.sqrt(vb) + 1e-6)
    return bias, w


def loss(bags: list[list[list[int]]], labels: np.ndarray, weight: np.ndarray, bias: float, w: np.ndarray) -> float:
    """Weighted cross entropy of the noisy-or."""
    total = 0.0
    for bag, y, k in zip(bags, labels, weight):
        p = noisy_or([1 / (1 + math.exp(-min(40.0, max(-40.0, bias + w[s].sum())))) for s in bag])
        total -= k * math.log(min(1 - 1e-9, max(1e-9, p if y == 1 else 1 - p)))
    return total


def fit_best(bags: list[list[list[int]]], labels: np.ndarray, weight: np.ndarray, n_words: int, base_rate: float, fold: np.ndarray, penalties: tuple[float, ...] = PENALTIES) -> tuple[float, np.ndarray]:
    """``fit`` with the penalty that does best on the rows of ``fold`` (ties: the larger one)."""
    pick = lambda at: ([bags[i] for i in at], labels[at], weight[at])
    inside, outside = np.flatnonzero(~fold), np.flatnonzero(fold)
    best = penalties[0]
    if len(set(labels[inside])) == 2 and len(set(labels[outside])) == 2:
        losses = [loss(*pick(outside), *fit(*pick(inside), n_words, base_rate, penalty=p)) for p in penalties]
        best = penalties[int(np.argmin(losses))]
    return fit(bags, labels, weight, n_words, base_rate, penalty=best)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """A model from the labels for which ``keep`` (over column ``doc``) holds."""
    small_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, per_class, doc_id, text)
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    share = (positive + 1) / (positive + negative + 2)
    if not positive or not negative:
        return Model(float(np.log(share / (1 - share))))

    @pandas_udf("array<array<string>>")
    def split(texts: pd.Series) -> pd.Series:
        own = lambda sentence: sorted({f for word in _WORD.findall(sentence.lower()) for f in features(word)})
        return pd.Series([[own(t[a:b]) for a, b in sentences(t)] for t in texts], dtype=object)

    bags = sample.select("doc", "label", split("text").alias("bag")).persist()
    try:
        seen = bags.select("label", F.explode(F.array_distinct(F.flatten("bag"))).alias("word"))
        n = {r["label"]: max(1, r["n"]) for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
        counts = seen.groupBy("word").agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("q")).where(F.col("p") + F.col("q") >= MIN_DOCS)
        p, q = F.col("p") / n.get(1, 1), F.col("q") / n.get(0, 1)
        chosen = counts.orderBy(((p - q) * (p - q) / (p + q)).desc(), "word").limit(VOCABULARY)
        vocabulary = {r["word"]: i for i, r in enumerate(chosen.select("word").collect())}
        index = F.broadcast(docs.sparkSession.createDataFrame(list(vocabulary.items()) or [("", -1)], "word string, i int"))
        words = bags.select("doc", "label", F.posexplode_outer("bag").alias("s", "words"))
        words = words.select("doc", "label", "s", F.explode_outer("words").alias("word")).join(index, "word", "left")
        lines = words.groupBy("doc", "label", "s").agg(F.sort_array(F.collect_list("i")).alias("ids"))
        rows = lines.groupBy("doc", "label").agg(F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "ids")))).alias("bag")).orderBy("doc").collect()
    finally:
        bags.unpersist()
    y = np.array([r["label"] for r in rows])
    if not len(vocabulary) or len(set(y)) < 2:
        return Model(float(np.log(share / (1 - share))))
    weight = np.where(y == 1, positive / max(1, (y == 1).sum()), negative / max(1, (y == 0).sum()))
    fold = np.array([zlib.crc32(f"{r['doc']}:inner".encode()) % INNER == 0 for r in rows])
    bias, w = fit_best([[s["ids"] for s in r["bag"]] for r in rows], y, weight, len(vocabulary), share, fold)
    return Model(float(bias), {word: float(w[i]) for word, i in vocabulary.items() if w[i]})


def score(docs: DataFrame, model: Model, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """The documents with ``toxicity``: score, and the offending sentences (start, end, probability) in order."""
    small_batches(docs.sparkSession)

    @pandas_udf("score double, offending array<struct<start: int, end: int, p: double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows, read = [], model.reader()
        for t in texts:
            found = read(t)
            rows.append((noisy_or([p for _, _, p in found]), [{"start": a, "end": b, "p": p} for a, b, p in found if p >= at_least]))
        return pd.DataFrame(rows, columns=["score", "offending"])

    return docs.withColumn("toxicity", judge(col(text).cast("string")))


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending for every row; trained on the folds that are not held out."""
    model = train(docs, labels, keep=fold_of(F.col("doc"), folds) != held_out, doc_id=doc_id, text=text)
    scored = score(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), model)
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "toxicity.score",
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.offending").alias("n_offending"),
    )
