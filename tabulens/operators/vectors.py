"""Exact nearest rows over an embedding column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.nulls import quoted

#: Rows and queries that meet in one task at a time.
ROW_BLOCK = 20_000
QUERY_BLOCK = 2_000
_WORK_CELLS = 4_000_000


def top_k(
    df: DataFrame, queries: DataFrame, id_col: str, vec: str, query_id: str, query_vec: str, k: int = 5,
    metric: str = "l2", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each query vector the k nearest rows: ``(query_id, rank, id_col, distance)``, ties by id.

    Rows and queries are dealt into blocks of about the given size by a hash, and each pair of blocks is one group: no
    query passes through the driver, and what leaves a group is k rows per query. Ids keep their own types.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = df.where(quoted(vec).isNotNull()).select(quoted(id_col).alias("i"), quoted(vec).cast("array<double>").alias("v"))
    asked = queries.where(quoted(query_vec).isNotNull()).select(quoted(query_id).alias("q"), quoted(query_vec).cast("array<double>").alias("w"))
    n = max(1, -(-rows.count() // row_block))
    m = max(1, -(-asked.count() // query_block))
    here = rows.withColumn("rb", F.pmod(F.xxhash64("i", "v"), F.lit(n)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    there = asked.withColumn("qb", F.pmod(F.xxhash64("q", "w"), F.lit(m)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    types = {f.name: f.dataType for f in [*rows.schema, *asked.schema]}
    out = f"q {types['q'].simpleString()}, i {types['i'].simpleString()}, d double"
    near = here.groupBy("rb", "qb").cogroup(there.groupBy("rb", "qb")).applyInPandas(_nearest(k, metric), out)
    w = Window.partitionBy("q").orderBy("d", "i")
    return (
        near.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), "rank", F.col("i").alias(id_col), F.col("d").alias("distance"))
    )


def _distances(block: np.ndarray, wanted: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = np.linalg.norm(wanted, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :]
        return 1.0 - (wanted @ block.T) / np.where(norm == 0, np.nan, norm)
    squared = np.zeros((len(wanted), len(block)))
    for d in range(block.shape[1]):
        squared += (wanted[:, d][:, None] - block[:, d][None, :]) ** 2
    return np.sqrt(squared)


def _nearest(k: int, metric: str):
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            # In order of id, so that a stable choice prefers the smaller id among equal distances.
            rows = rows.sort_values("i", ignore_index=True)
            ids, block = rows["i"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
            for start, wanted in _pieces(queries, len(rows)):
                found = _distances(block, wanted, metric)
                found = np.where(np.isnan(found), np.inf, found)
                reach = np.partition(found, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                q, i = np.nonzero((found <= reach[:, None]) & np.isfinite(found))
                order = np.lexsort((i, found[q, i], q))
                q, i = q[order], i[order]
                q, i = (x[np.arange(len(q)) - np.searchsorted(q, q) < k] for x in (q, i))
                kept.append((queries["q"].to_numpy()[start + q], ids[i], found[q, i]))
        columns = [np.concatenate(x) for x in zip(*kept)] if kept else [np.zeros(0, object)] * 3
        # Text stays Python objects: the Arrow-backed strings of pandas come in chunks that a struct cannot take.
        return pd.DataFrame({name: pd.Series(x, dtype=x.dtype) for name, x in zip("qid", columns)})

    return best


def _pieces(queries: pd.DataFrame, n_rows: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, _WORK_CELLS // n_rows)
    for start in range(0, len(queries), step):
        yield start, np.stack(queries["w"].iloc[start : start + step].to_numpy()).astype(float)
