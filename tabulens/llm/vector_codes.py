"""Nearest vectors by randomly rotated one-bit codes, with error bounds that choose the vectors to rerank.

Each vector is scaled to length one and turned by a random orthogonal matrix; the signs of its components are its code, one
bit for each, packed. With ``f``, the inner product of the turned vector and the unit vector of its signs, the inner product
with a query is estimated as ``length * <signs, turned query> / f``, and errs by at most
``EPSILON * sqrt((1 - f^2) / f^2 / (d - 1))`` times both lengths but for few pairs.

The index is a written table of all vectors: code, length, f, and the vector. Rows and queries are dealt into blocks by a
hash; each pair of blocks is one group of bounded size, in which

1. all estimates are one matrix product of the unpacked codes,
2. the best estimates are measured exactly and give the query a score that its result must reach,
3. every vector whose upper bound reaches that score is measured exactly.

Exact scores are inner products of the original vectors in double precision. Each group returns the ``k`` best of each
query, and the ``k`` best of those remain. Every query meets every code: the vectors here are spread evenly in 64
dimensions, where cells of a coarse clustering would have to be searched by half to reach nine tenths of the neighbours.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a null
id. Only vectors of equal dimension are compared. Equal rows count once; a query id with several vectors has the smallest.
Ties go to the smaller id. A query has all candidates if there are fewer than ``k``, and no row if there are none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import col
from tabulens.session import materialized

EPSILON = 1.9
#: The best ``FIRST * k`` estimates are measured to find the score a result must reach.
FIRST = 6
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
SEED = 11


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The written index: id, d, v (the vector), code (packed bits), length, f."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    rows = vectors.select(col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    @pandas_udf("code binary, length double, f double")
    def encode(batch: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(batch)
        sizes = batch.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = np.stack(batch.iloc[at].to_list())
            scale = np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay in range
            length = np.linalg.norm(x / scale, axis=1)
            y = (x / scale / length[:, None]).astype(np.float32) @ rotation(d).T
            packed = np.packbits(y > 0, axis=1)
            f = np.abs(y).sum(1, dtype=np.float64) / np.sqrt(d)
            for i, k in enumerate(at):
                out[k] = (packed[i].tobytes(), float(length[i] * scale[i, 0]), float(f[i]))
        return pd.DataFrame(out, columns=["code", "length", "f"])

    return materialized(rows.select("id", F.size("v").alias("d"), "v", encode("v").alias("c")).select("id", "d", "v", "c.*"), "codes")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, epsilon: float) -> pd.DataFrame:
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, q = np.stack(rows["v"].to_list()), np.stack(queries["v"].to_list())
    ids, own, d = rows["id"].to_numpy(), queries["id"].to_numpy(), x.shape[1]
    signs = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(x), -1), axis=1, count=d).astype(np.float32) * 2 - 1
    length, f = rows["length"].to_numpy(), rows["f"].to_numpy()
    scale = np.abs(q).max(1, keepdims=True)
    unit = q / scale
    q_length = np.linalg.norm(unit, axis=1) * scale[:, 0]
    turned = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32) @ rotation(d).T
    per_row = length / (f * np.sqrt(d))
    slack = length * epsilon * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, d - 1)) + 1e-6 * length
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), 128):
        part = slice(start, start + 128)
        estimate = (turned[part] @ signs.T) * per_row * q_length[part, None]
        estimate[own[part, None] == ids] = -np.inf
        for i, e in enumerate(estimate):
            j = start + i
            first = np.argpartition(e, -FIRST * k)[-FIRST * k :] if len(e) > FIRST * k else np.arange(len(e))
            first = first[ids[first] != own[j]]
            if not len(first):
                continue
            measured = x[first] @ q[j]
            reach = np.partition(measured, -k)[-k] if len(first) >= k else -np.inf
            within = e + slack * q_length[j] >= reach
            within[first] = True
            chosen = np.flatnonzero(within & (ids != own[j]))
            exact = x[chosen] @ q[j]
            best = _top(exact, ids[chosen], k)
            found.append((np.full(len(best), own[j]), ids[chosen][best], exact[best]))
    parts = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))


def search(indexed: DataFrame, queries: DataFrame, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, d, v) the ``k`` nearest of the index but itself."""
    queries = queries.groupBy("id").agg(F.min(F.struct("d", "v")).alias("x")).select("id", "x.*")
    n_rows, n_queries = indexed.count(), queries.count()
    r, s = _blocks(n_rows, ROW_BLOCK), _blocks(n_queries, QUERY_BLOCK)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    here = indexed.withColumn("rb", F.pmod(F.xxhash64("id", F.hash("v")), F.lit(r)).cast("int")).withColumn("qb", every(s))
    there = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(s)).cast("int")).withColumn("rb", every(r))
    cell = ["d", "rb", "qb"]
    found = here.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInPandas(lambda a, b: _search(a, b, k, epsilon), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``, among all others."""
    indexed = index(vectors, vec_id, vector)
    return search(indexed, indexed.where(F.col("id") % every == 0).select("id", "d", "v"), k)
