"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and with A-Z in lower case. Keys of at
least ``MIN_CHARS`` code points take part. A key held by two documents or more is shared: its lines stay in the document
with the smallest id and go from all others. Keys are carried as 128-bit digests.

``LineIndex`` is a folder of append-only Parquet tables, one segment for each operation:

* ``refs``: for each inserted row its id and the digests of its distinct keys,
* ``removed``: ids taken out, with the operation that did so,
* ``counts``: digest, number of rows that refer to it, smallest and largest id; the newest segment of a digest holds,
* ``filters``: for each shard of the digest space one cuckoo filter over the digests that the segment added.

An insertion probes the filters first. What no filter knows is new and is appended without a look at older counts; only
the rest is joined with them (false positives find nothing there and are appended too). A removal lowers the counts,
finds the next smallest holder of a key from the references, and deletes fingerprints of keys that nobody holds any more,
so a later insertion sees the same index as if the document had never been there.

Counts are aggregated before their shuffle, so a line that a third of all documents share is a few rows for each task.
A filter is as large as its shard; the number of shards follows the number of keys when an index is first filled.

Edge cases: a null or empty text is one empty line; a null stays null when cleaned. A row with a null id refers to
nothing and keeps all its lines. Rows with one id are one document: their lines count once for sharing, each row is
cleaned for itself. An empty table gives an empty one. Other columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
import uuid
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import col, small_batches, utf8
from tabulens.session import scratch_path

MIN_CHARS = 10
KEYS_PER_SHARD = 200_000


def key_of(line: bytes) -> bytes | None:
    """The digest of a line's key, or None where the key is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


@pandas_udf(T.ArrayType(T.BinaryType()))
def distinct_keys(texts: pd.Series) -> pd.Series:
    return pd.Series([list({k for line in utf8(t).split(b"\n") if (k := key_of(line))}) for t in texts], dtype=object)


@pandas_udf(T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType()))
def without_lines(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = []
    for text, drop in zip(texts, drops):
        if drop is None or not len(drop):
            rows.append((text, (text or "").count("\n") + 1, 0))
            continue
        gone, lines = set(drop), utf8(text).split(b"\n")
        kept = [line for line in lines if key_of(line) not in gone]
        rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


class CuckooFilter:
    """16-bit fingerprints in buckets of four; 0 is an empty slot. Several equal keys may be held."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def over(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds the keys (16-byte digests); at most 80 % full, and larger if that does not do."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / (0.8 * cls.SLOTS)))))
        while True:
            made = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if made._add(keys):
                return made
            buckets *= 2

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).astype(np.uint16))

    def dumps(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        mark = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (words[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def _add(self, keys: np.ndarray) -> bool:
        if not len(keys):
            return True
        mark, bucket = self._places(keys)
        turn = np.random.default_rng(len(keys))
        for kick in range(self.KICKS):
            # As many of the waiting fingerprints as a bucket has free slots go in, the others to their other bucket.
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            first = np.searchsorted(bucket, bucket)
            rank = np.arange(len(bucket)) - first
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free[fits], 1) == (rank[fits] + 1)[:, None], 1)
            self.table[bucket[fits], slot] = mark[fits]
            mark, bucket = mark[~fits], bucket[~fits]
            if not len(mark):
                return True
            if kick % 2:  # both buckets are full: one for each bucket trades places with a resident
                once = np.unique(bucket, return_index=True)[1]
                seat = turn.integers(0, self.SLOTS, len(once))
                out = self.table[bucket[once], seat]
                self.table[bucket[once], seat] = mark[once]
                mark = mark.copy()
                mark[once] = out
            bucket = self._other(mark, bucket)
        return False

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, bucket = self._places(keys)
        there = lambda b: (self.table[b] == mark[:, None]).any(1)
        return there(bucket) | there(self._other(mark, bucket))

    def drop(self, keys: np.ndarray) -> None:
        """Delete one fingerprint for each key; keys that are not held do nothing."""
        if not len(keys):
            return
        mark, bucket = self._places(keys)
        for m, b, o in zip(mark, bucket, self._other(mark, bucket)):
            for row in (self.table[b], self.table[o]):
                if (at := np.flatnonzero(row == m)).size:
                    row[at[0]] = 0
                    break


class LineIndex:
    """The tables of one index below ``path``, a folder that all executors share."""

    REFS = "doc long, keys array<binary>, op long"
    COUNTS = "shard int, key binary, n_refs long, first long, last long, op long"
    FILTERS = "shard int, bits binary, op long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.op, self.shards = spark, path or scratch_path(spark, "lines"), 0, 0
        self.segments: dict[str, list[str]] = {"refs": [], "removed": [], "counts": [], "filters": []}

    def _append(self, kind: str, df: DataFrame) -> DataFrame:
        where = f"{self.path}/{kind}/{self.op}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(where)
        self.segments[kind].append(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _read(self, kind: str, schema: str) -> DataFrame:
        where = self.segments[kind]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def _shard(self, key: Column) -> Column:
        return F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("int") % self.shards

    def references(self) -> DataFrame:
        """One row for each reference that stands: doc, key."""
        refs = self._read("refs", self.REFS)
        if self.segments["removed"]:
            gone = self._read("removed", "doc long, op long").groupBy("doc").agg(F.max("op").alias("gone"))
            refs = refs.join(gone, "doc", "left").where(F.col("gone").isNull() | (F.col("op") > F.col("gone")))
        return refs.select("doc", F.explode("keys").alias("key"))

    def counts(self) -> DataFrame:
        """One row for each key that is held: shard, key, n_refs, first, last."""
        rows = self._read("counts", self.COUNTS)
        if len(self.segments["counts"]) > 1:
            newest = F.max_by(F.struct("shard", "n_refs", "first", "last"), "op").alias("now")
            rows = rows.groupBy("key").agg(newest).select("key", "now.*")
        return rows.where("n_refs > 0").select("shard", "key", "n_refs", "first", "last")

    def _probed(self, rows: DataFrame) -> DataFrame:
        """The rows (shard, key, ...) with ``known``: false where no filter holds the key."""
        schema = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", known boolean"

        def probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            known = np.zeros(len(keys), bool)
            values = keys["key"].to_numpy()
            for bits in filters["bits"]:
                known |= CuckooFilter.loads(bits).holds(values)
            return keys.assign(known=known)

        filters = self._read("filters", self.FILTERS).select("shard", "bits")
        return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, schema)

    def _add_filters(self, keys: DataFrame) -> None:
        op = self.op

        def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard[0]], "bits": [CuckooFilter.over(rows["key"].to_numpy()).dumps()], "op": [op]})

        self._append("filters", keys.select("shard", "key").groupBy("shard").applyInPandas(build, self.FILTERS))

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """Take in documents. An id that is there already gains the lines of the new row."""
        small_batches(self.spark)
        self.op += 1
        refs = docs.select(col(doc_id).cast("long").alias("doc"), distinct_keys(col(text).cast("string")).alias("keys")).where("doc IS NOT NULL")
        refs = self._append("refs", refs.withColumn("op", F.lit(self.op).cast("long")))
        batch = refs.select("doc", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))
        first_fill = not self.shards
        if first_fill:
            n = refs.agg(F.sum(F.size("keys"))).first()[0] or 0
            self.shards = max(8, -(-n // KEYS_PER_SHARD))
        batch = batch.select(self._shard(F.col("key")).alias("shard"), "key", "n_refs", "first", "last")
        stamp = F.lit(self.op).cast("long").alias("op")
        if first_fill:
            self._add_filters(self._append("counts", batch.select("*", stamp)))
            return self
        old = self.counts().select("key", *(F.col(c).alias(f"old_{c}") for c in ("n_refs", "first", "last")))
        probed = self._probed(batch)
        merged = probed.where("known").drop("known").join(old, "key", "left").select(
            "shard", "key", (F.col("n_refs") + F.coalesce("old_n_refs", F.lit(0))).alias("n_refs"),
            F.least("first", "old_first").alias("first"), F.greatest("last", "old_last").alias("last"),
            F.col("old_n_refs").isNull().alias("fresh"),
        )
        unseen = probed.where("NOT known").select("shard", "key", "n_refs", "first", "last", F.lit(True).alias("fresh"))
        written = self._append("counts", unseen.unionByName(merged).select("shard", "key", "n_refs", "first", "last", stamp, "fresh"))
        self._add_filters(written.where("fresh"))
        return self

    def remove(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Take documents out again, by id. Ids that are not there do nothing."""
        self.op += 1
        ids = ids.select(col(doc_id).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
        touched = self.references().join(ids, "doc", "left_semi").select("key").distinct()
        touched = self._append_scratch(touched)
        self._append("removed", ids.select("doc", F.lit(self.op).cast("long").alias("op")))
        left = self.references().join(touched, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))
        now = touched.join(left, "key", "left").select(
            self._shard(F.col("key")).alias("shard"), "key", F.coalesce("n_refs", F.lit(0)).cast("long").alias("n_refs"), "first", "last", F.lit(self.op).cast("long").alias("op"),
        )
        written, op = self._append("counts", now), self.op

        def unmark(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            left, out = keys["key"].to_numpy(), []
            for bits in filters["bits"]:
                held = CuckooFilter.loads(bits)
                here = held.holds(left)
                held.drop(left[here])
                left = left[~here]
                out.append(held.dumps())
            return pd.DataFrame({"shard": filters["shard"], "bits": out, "op": op})

        filters = self._read("filters", self.FILTERS)
        fresh = filters.groupBy("shard").cogroup(written.where("n_refs = 0").select("shard", "key").groupBy("shard")).applyInPandas(unmark, self.FILTERS)
        self.segments["filters"], old = [], self.segments["filters"]
        self._append("filters", fresh) if old else None
        return self

    def _append_scratch(self, df: DataFrame) -> DataFrame:
        where = f"{self.path}/work/{self.op}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drops(self) -> DataFrame:
        """For each document the digests of the lines it loses: doc, drop."""
        shared = self.counts().where("first < last").select("key", "first")
        lost = self.references().join(shared, "key").where("doc > first")
        return lost.groupBy("doc").agg(F.collect_set("key").alias("drop"))

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The documents with column ``__lines``: text (what stays), n_lines, n_dropped."""
        small_batches(self.spark)
        drops = self.drops().select(F.col("doc").alias("__doc"), F.col("drop").alias("__drop"))
        joined = docs.join(drops, col(doc_id).cast("long") == F.col("__doc"), "left")
        return joined.withColumn("__lines", without_lines(col(text).cast("string"), F.col("__drop"))).drop("__doc", "__drop")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without lines that a document with a smaller id holds; all columns stay."""
    cleaned = LineIndex(docs.sparkSession).insert(docs, doc_id, text).clean(docs, doc_id, text)
    return cleaned.select(*(F.when(col(c).isNotNull(), F.col("__lines.text")).alias(c) if c == text else col(c) for c in docs.columns))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every row."""
    cleaned = LineIndex(docs.sparkSession).insert(docs, doc_id, text).clean(docs, doc_id, text)
    kept = F.sha2(F.coalesce(F.col("__lines.text"), F.lit("")), 256).alias("kept_sha256")
    return cleaned.select(col(doc_id).alias("doc_id"), F.col("__lines.n_lines"), F.col("__lines.n_dropped"), kept)
