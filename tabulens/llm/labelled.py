"""Bounded samples of labelled documents, for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` texts of each label (columns doc, label, text), and how many rows each label has in all.

    Only labels for which ``keep`` holds (an expression over column ``doc``) take part. The sample is the rows whose ids
    hash smallest, so it is the same in every run. An id with several labels has the largest, one with several texts all.
    """
    named = labels.select(col(doc_id).alias("doc"), col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc").isNotNull() & keep)
    named = named.groupBy("doc").agg(F.max("label").alias("label")).where("label IN (0, 1)")
    totals = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc").cast("string"), F.lit("sample"))
    few = [named.where(F.col("label") == k).orderBy(order, "doc").limit(per_class) for k in (0, 1)]
    texts = docs.select(col(doc_id).alias("doc"), col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(few[0].unionByName(few[1])), "doc"), totals
