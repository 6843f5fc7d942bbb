"""Quality by compression: how much better does a dictionary of good texts compress a text than one of bad texts?

Two zstandard dictionaries of ``DICTIONARY`` bytes are built from labelled texts, one for each label. The feature of a text
is the difference of its compressed sizes, ``bad - good``, as a share of its length: a text that repeats itself compresses
well under either and ends near 0, as texts do that neither dictionary knows. A logistic curve fitted on labelled texts that are in neither
dictionary turns it into a probability.

Training takes at most ``PER_CLASS`` documents of each label, two thirds for the dictionaries and the rest for the curve,
weighted back to the true shares of the labels. Scoring compresses every whole text.

Edge cases: a null or empty text has feature 0 and the score the curve gives there. Without labelled texts of both kinds
every score is the smoothed share of good labels. Null labels and null ids are no training rows. Repeated rows score alike.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import col, small_batches, utf8
from tabulens.llm.labelled import fold_of, labelled_sample

PER_CLASS = 1200
DICTIONARY = 110 << 10
LEVEL = 3


def build_dictionary(texts: Sequence[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of texts too few to train on, their own last bytes."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class Compressors:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if data else zstandard.DICT_TYPE_RAWCONTENT
            made = zstandard.ZstdCompressionDict(data, dict_type=kind)
            made.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))

    def feature(self, text: str | None) -> float:
        raw = utf8(text)
        if not raw:
            return 0.0
        good, bad = (len(c.compress(raw)) for c in self.pair)
        return (bad - good) / len(raw)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * feature + bias)))"""

    good: bytes
    bad: bytes
    slope: float
    bias: float


def calibrate(feature: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of a weighted logistic curve by Newton's method, with a slight pull to zero."""
    scale = feature.std() or 1.0
    x = np.stack([feature / scale, np.ones(len(feature))], 1)
    w, weight = np.zeros(2), weight / weight.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.1 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """A model from the labels for which ``keep`` (over column ``doc``) holds."""
    sample, totals = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, per_class, doc_id, text)
    rows = sample.orderBy(F.xxhash64(F.col("doc").cast("string")), "doc", F.col("text")).collect()
    good, bad = totals.get(1, 0), totals.get(0, 0)
    share = (good + 1) / (good + bad + 2)
    parts: dict[tuple[int, bool], list] = {(y, d): [] for y in (0, 1) for d in (True, False)}
    for y in (0, 1):
        for i, r in enumerate(r for r in rows if r["label"] == y):
            parts[y, i % 3 != 2].append(r["text"])
    if not all(parts.values()):
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    books = [build_dictionary([utf8(t) for t in parts[y, True]]) for y in (1, 0)]
    pair = Compressors(*books)
    y = np.array([k for k in (0, 1) for _ in parts[k, False]])
    x = np.array([pair.feature(t) for k in (0, 1) for t in parts[k, False]])
    weight = np.where(y == 1, good / len(parts[1, False]), bad / len(parts[0, False]))
    return Model(*books, *calibrate(x, y, weight))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``quality_score``, between 0 (bad) and 1 (good)."""
    small_batches(docs.sparkSession)

    @pandas_udf("double")
    def feature(texts: pd.Series) -> pd.Series:
        pair = Compressors(model.good, model.bad)
        return pd.Series([pair.feature(t) for t in texts], dtype=float)

    logit = F.lit(model.bias) if not model.slope else feature(col(text).cast("string")) * model.slope + model.bias
    return docs.withColumn("quality_score", 1 / (1 + F.exp(-logit)))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; trained on the folds that are not held out."""
    model = train(docs, labels, keep=fold_of(F.col("doc"), folds) != held_out, doc_id=doc_id, text=text)
    scored = score(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), model)
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
