"""Vector codes: product quantisation whose distances are shared along a trie of the distinct parts.

Components become whole numbers, ``floor(SCALE * x)``, and a vector is cut into ``PARTS`` equal parts; each part is written
as the number of its nearest entry in a codebook for its position (squared distance, ties to the lower number). The codebooks
start as the parts of the smallest ids; each round assigns all parts and moves every entry to the floor of their mean.

Within an Arrow batch the distinct parts of a position, sorted, are the leaves of a trie by dimension. They are visited
depth first: a node's vector of distances to all entries is its parent's plus the squared differences in its dimension, so
parts with a common beginning share it. ``LEAVES`` leaves are visited at a time; the nodes on the path to the last one are
kept for the next. At a leaf the smallest distance gives the code, and the part times its number of occurrences goes to that
entry's sum, one row for each entry and dimension from a task. So a round is one scan without a shuffle of vectors,
and what reaches the driver is the codebooks.

Edge cases: vectors that are null, or hold null or non-finite components, are dropped. Vectors of another length than the
one with the smallest id, or of a length that cannot be cut, stay with a null code and error. Null ids start no codebook
before others. Fewer vectors than entries make smaller codebooks. Repeated rows are coded alike, and count each. Components
so large that the squared error of a vector may not fit a long (about 700,000 for 64 dimensions) raise an error. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.llm.common import col
from tabulens.session import materialized

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAVES = 4096
#: A label with this share of the rows is joined by broadcast: there are at most as many as its inverse.
HOT_SHARE = 1e-4


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry and squared distance to it, for distinct parts in lexicographic order."""
    n, depth = parts.shape
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    path, kept = None, [np.zeros(len(entries), np.int64)] * (depth + 1)
    for begin in range(0, n, LEAVES):
        block = parts[begin : begin + LEAVES]
        before = np.vstack([block[:1] if path is None else path, block[:-1]])
        # Row i needs a node of its own at depth k if it differs from the row before in dimension k or an earlier one.
        fresh = np.logical_or.accumulate(block != before, axis=1)
        if path is None:
            fresh[0] = True
        node, sums = np.zeros(len(block), np.int64), kept[0][None]
        for k in range(depth):
            own = np.flatnonzero(fresh[:, k])
            below = sums[node[own]] + (block[own, k, None] - entries[None, :, k]) ** 2
            carried = not fresh[0, k]
            sums = np.vstack([kept[k + 1], below]) if carried else below
            node = np.cumsum(fresh[:, k]) - (not carried)
            kept[k + 1] = sums[-1]
        sums = sums[node]
        here = sums.argmin(axis=1)
        codes[begin : begin + LEAVES], errors[begin : begin + LEAVES] = here, sums[np.arange(len(block)), here]
        path = block[-1:]
    return codes, errors


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, each row's number among them, and how often each occurs."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64), np.array([len(parts)] if len(parts) else [], np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(first) - 1
    return rows[first], number, np.bincount(number, minlength=int(first.sum()))


@dataclass(frozen=True)
class Codebook:
    """``entries[p, e]`` is entry e for part p; ``size`` is the length of the vectors."""

    entries: np.ndarray
    size: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def parts(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for p in range(len(self.entries)):
            yield p, vectors[:, p * self.width : (p + 1) * self.width]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(df: DataFrame, vector: str = "embedding", out: str = "__v", scale: int = SCALE) -> DataFrame:
    """The rows with finite vectors, and these as whole numbers in ``out``."""
    v = col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    limit = F.lit(2.0**31.5 / (2 * scale)) / F.sqrt(F.size(v))
    small = lambda x: F.when(F.abs(x) < limit, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for a whole squared error")).cast("long"))
    return df.where(col(vector).isNotNull() & F.forall(v, finite)).withColumn(out, F.transform(v, small))


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the right length as rows, and which ones they are."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    fits = lengths == size
    flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(int(fits.sum()), size).astype(np.int64, copy=False), fits


def first_codebook(rows: DataFrame, vec_id: str, parts: int, entries: int, out: str = "__v") -> Codebook | None:
    """The parts of the smallest ids; None if no vector can be cut."""
    order = [col(vec_id).asc_nulls_last(), col(out)]
    first = rows.where(F.size(out) % parts == 0).orderBy(*order).select(F.size(out).alias("n")).first()
    if first is None:
        return None
    size = first["n"]
    least = rows.where(F.size(out) == size).orderBy(*order).limit(entries).select(out).collect()
    held = np.array([r[0] for r in least], np.int64).reshape(len(least), parts, size // parts)
    return Codebook(np.ascontiguousarray(held.transpose(1, 0, 2)), size)


def moved(rows: DataFrame, book: Codebook, out: str = "__v") -> Codebook:
    """The codebook after one round: every entry at the floor of the mean of the parts assigned to it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(book.entries.shape, np.int64), np.zeros(book.entries.shape[:2], np.int64)
        for batch in batches:
            for p, there in book.parts(_matrix(batch.column(0), book.size)[0]):
                leaves, _, weight = distinct(there)
                code, _ = nearest(leaves, book.entries[p])
                np.add.at(count[p], code, weight)
                np.add.at(total[p], code, leaves * weight[:, None])
        p, e = np.nonzero(count)
        j = np.arange(book.width)
        columns = [np.repeat(p, book.width), np.repeat(e, book.width), np.tile(j, len(p)), np.repeat(count[p, e], book.width), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "j", "n", "s"])

    # Sums over all tasks may need more than 64 bits.
    every = rows.select(out).mapInArrow(sums, "p long, e long, j long, n long, s long").groupBy("p", "e", "j")
    entries = book.entries.copy()
    for r in every.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        entries[r.p, r.e, r.j] = int(r.s) // r.n
    return Codebook(entries, book.size)


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebook | None:
    """Codebooks from all vectors; None if there is none that can be cut."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = whole_numbers(df, vector).select(col(vec_id), "__v")
    book = first_codebook(rows, vec_id, parts, entries)
    if book is not None and book.width:
        for _ in range(rounds):
            book = moved(rows, book)
    return book


def encode(df: DataFrame, book: Codebook | None, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The rows with finite vectors, their codes and squared errors."""

    @arrow_udf("code string, error long")
    def coded(vectors: pa.Array) -> pa.Array:
        x, fits = _matrix(vectors, -2 if book is None else book.size)
        codes, errors = np.zeros((len(x), 0 if book is None else len(book.entries)), np.uint8), np.zeros(len(x), np.int64)
        for p, there in [] if book is None else book.parts(x):
            leaves, number, _ = distinct(there)
            found, far = nearest(leaves, book.entries[p])
            codes[:, p] = found[number]
            errors += far[number]
        digits, width = codes.tobytes().hex(), 2 * codes.shape[1]
        texts, place = np.full(len(fits), None, object), np.flatnonzero(fits)
        texts[place] = [digits[i * width : (i + 1) * width] for i in range(len(x))]
        every = np.zeros(len(fits), np.int64)
        every[place] = errors
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(every, pa.int64(), mask=~fits)], ["code", "error"])

    rows = whole_numbers(df, vector).withColumn("__c", coded("__v"))
    names = [c for c in df.columns if c not in (code, error)]
    return rows.select(*map(col, names), F.col("__c.code").alias(code), F.col("__c.error").alias(error))


def decoded(code: Column, book: Codebook, scale: int = SCALE) -> Column:
    """The vector a code stands for: its entries, scaled back."""

    @arrow_udf("array<double>")
    def vectors(codes: pa.Array) -> pa.Array:
        out = []
        for c in codes.to_pylist():
            out.append(None if c is None else (book.entries[np.arange(len(book.entries)), list(bytes.fromhex(c))].ravel() / scale).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return vectors(code)


def with_total(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows with the same ``key`` (nulls together)."""
    totals = materialized(rows.groupBy(col(key).alias("__key")).agg(F.sum(col(value)).alias(out), F.count("*").alias("__n")), "totals")
    many = totals.agg(F.sum("__n")).first()[0] or 0
    hot = F.col("__n") >= HOT_SHARE * many
    same = col(key).eqNullSafe(F.col("__key"))
    few = F.broadcast(totals.where(hot).select("__key", out))
    rest = rows.join(F.broadcast(totals.where(hot).select("__key")), same, "left_anti").join(totals.where(~hot).select("__key", out), same)
    return rows.join(few, same).drop("__key").unionByName(rest.drop("__key"))


def code_report(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (over equal labels) and the digest of the codebooks."""
    book = fit(df, vec_id, vector)
    rows = df.select(col(vec_id).alias("vec_id"), col(vector).alias("embedding"), col(label).alias("label"))
    rows = materialized(encode(rows, book).drop("embedding"), "codes")
    digest = hashlib.sha256(b"").hexdigest() if book is None else book.digest()
    return with_total(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
