"""Byte-level BPE encoding and decoding, long texts by overlapping chunks.

A text of more than ``chunk`` code points is cut into chunks that reach into the next one by ``overlap`` code points and on
to the next character followed by white space. Every chunk is a row: it is split into pre-tokens and encoded for itself,
wherever Spark places it. What a pre-token is depends only on where it begins and on what follows, so from the first
boundary that two neighbours have in common they agree; there the chunks of a text are stitched. A pre-token never goes on
from another character to white space, so the end of the overlap is such a boundary at the latest. A stretch without white
space stays in one chunk. Chunk rows are written out once, under an id drawn for each row, so equal texts are apart and no
group is larger than a text. Shorter texts are a single chunk and are encoded where they are, without a shuffle.

A pre-token that is an entry of the vocabulary is that entry; others start as bytes, and the neighbours whose union has the
lowest rank are merged first (ties: the leftmost) until none is an entry. Decoding concatenates the entries' bytes.

The rank file is read on the driver (its path is a parameter) and travels as a broadcast, one vocabulary in size. Special
tokens are ordinary text.

Edge cases: a null text is taken as empty, and an empty one has no ids. Ids outside the vocabulary, and null ids, decode to
nothing; null for a list decodes to null. Repeated rows are encoded each for itself. An empty table gives an empty one. Other
columns stay as they are; one named as the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.llm.common import col, small_batches
from tabulens.session import materialized

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of pre-tokens that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points of a chunk, and how far it reaches into the next one at least.
CHUNK = 1 << 14
OVERLAP = 1 << 8

_CUT = regex.compile(r"\S(?=\s)")
_CHUNK_TYPE = "array<struct<no: int, start: int, into: int, next: int, part: string>>"
_PLACES = "array<struct<at: int, n: int>>"


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Entries and their ranks, one base64 text and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines) if entry}


class _Remembered(dict):
    """Packed ids of pre-tokens; of short ones, those met again among the last ``2 * KEPT`` are not searched again."""

    KEPT = 150_000
    SHORT = 48

    def __init__(self, search):
        super().__init__()
        self.search, self.older = search, {}

    def __missing__(self, token: str) -> bytes:
        found = self.older.get(token)
        if found is None:
            found = array("i", self.search(token.encode())).tobytes()
            if len(token) > self.SHORT:
                return found
        if len(self) >= self.KEPT:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found


class Encoder:
    """Encodes texts and pieces of them."""

    #: Pre-tokens of more bytes are merged by way of a heap.
    FEW = 40

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.memory = _Remembered(self.merged)

    def merged(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        if token in self.ranks:
            return [self.ranks[token]]
        return self._by_list(token) if len(token) <= self.FEW else self._by_heap(token)

    def _by_list(self, token: bytes) -> list[int]:
        ranks, none = self.ranks, len(self.ranks) + (1 << 32)
        at = list(range(len(token) + 1))
        pairs = [ranks.get(token[i : i + 2], none) for i in range(len(token) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(token[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = ranks.get(token[at[i - 1] : at[i + 1]], none)
        return [ranks[token[a:b]] for a, b in zip(at, at[1:])]

    def _by_heap(self, token: bytes) -> list[int]:
        n, rank = len(token), self.ranks.get
        after, before, dead = list(range(1, n + 2)), list(range(-1, n)), bytearray(n + 1)
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, end = heapq.heappop(waiting)
            middle = after[i]
            if dead[i] or middle >= n or after[middle] != end:
                continue
            dead[middle] = 1
            after[i], before[end] = end, i
            left = before[i]
            if left >= 0 and (r := rank(token[left:end])) is not None:
                heapq.heappush(waiting, (r, left, end))
            if end < n and (r := rank(token[i : after[end]])) is not None:
                heapq.heappush(waiting, (r, i, after[end]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : after[i]]])
            i = after[i]
        return out

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        return b"".join(map(self.memory.__getitem__, self.split(text)))

    def chunk(self, part: str, start: int, into: int, following: int | None) -> dict:
        """The packed ids of a chunk, and the boundaries it shares with its neighbours: the place in the text, the ids before it."""
        tokens = self.split(part)
        packed = [self.memory[t] for t in tokens]
        at = start + np.cumsum([0, *map(len, tokens)])
        n = np.cumsum([0, *map(len, packed)]) // 4
        places = lambda keep: [{"at": int(a), "n": int(k)} for a, k in zip(at[keep], n[keep])]
        return {"ids": b"".join(packed), "head": places(at <= into), "tail": places(at >= following) if following is not None else []}


def _kept(shared: dict, pattern: str) -> Encoder:
    """The encoder of a worker: it stays with the broadcast from task to task, and so does what it remembers."""
    if "encoder" not in shared:
        shared["encoder"] = Encoder(shared["ranks"], pattern)
    return shared["encoder"]


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int, int | None, str]]:
    """(number, start, end of what the chunk before reaches, start of the next chunk, characters) of the chunks of a text."""
    out, start, into = [], 0, 0
    while True:
        following = max(start + chunk, into)
        found = _CUT.search(text, following + overlap) if following + overlap < len(text) else None
        if found is None:
            return [*out, (len(out), start, into, None, text[start:])]
        out.append((len(out), start, into, following, text[start : found.end()]))
        start, into = following, found.end()


def stitched(chunks: list[dict]) -> bytes:
    """The packed ids of a text from its chunks in order: neighbours change over at the first boundary they share."""
    out, begin = [], 0
    for this, after in zip(chunks, [*chunks[1:], None]):
        if after is None:
            out.append(this["ids"][4 * begin :])
            break
        shared = {p["at"]: p["n"] for p in after["head"]}
        place = next((p for p in this["tail"] if p["at"] in shared), None)
        if place is None:
            raise ValueError("neighbouring chunks share no boundary: the pattern joins a character and white space after it")
        out.append(this["ids"][4 * begin : 4 * place["n"]])
        begin = shared[place["at"]]
    return b"".join(out)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _rows(ids: pa.Array) -> Iterator[np.ndarray | None]:
    """The ids of each list, null ids as -1."""
    flat = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.asarray(ids.offsets)
    for k, there in enumerate(ids.is_valid().to_pylist()):
        yield flat[at[k] : at[k + 1]] if there else None


def encode(
    docs: DataFrame, text: str = "text", out: str = "ids", path: str = RANKS, pattern: str = PATTERN,
    chunk: int = CHUNK, overlap: int = OVERLAP, keep_text: bool = True,
) -> DataFrame:
    """The documents with ``out``, an array<int> of ids; without the text if ``keep_text`` is false."""
    spark = docs.sparkSession
    small_batches(spark, 4 << 20)
    shared = spark.sparkContext.broadcast({"ranks": load_ranks(path)})

    @arrow_udf("array<int>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _kept(shared.value, pattern)
        for texts in batches:
            yield _lists([encoder.packed(t.as_py() or "") for t in texts])

    @arrow_udf(_CHUNK_TYPE)
    def chunks(texts: pa.Array) -> pa.Array:
        names = ["no", "start", "into", "next", "part"]
        kind = pa.list_(pa.struct([(n, pa.string() if n == "part" else pa.int32()) for n in names]))
        return pa.array([[dict(zip(names, c)) for c in cut(t.as_py(), chunk, overlap)] for t in texts], kind)

    @arrow_udf(f"ids binary, head {_PLACES}, tail {_PLACES}")
    def piece(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        encoder = _kept(shared.value, pattern)
        places = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        kind = pa.struct([("ids", pa.binary()), ("head", places), ("tail", places)])
        for batch in batches:
            yield pa.array([encoder.chunk(*(x.as_py() for x in row)) for row in zip(*batch)], kind)

    @arrow_udf("array<int>")
    def joined(groups: pa.Array) -> pa.Array:
        return _lists([stitched(g.as_py()) for g in groups])

    names = [c for c in docs.columns if c != out and (keep_text or c != text)]
    words = F.coalesce(col(text).cast("string"), F.lit(""))
    short = docs.where(F.length(words) <= chunk).select(*map(col, names), whole(words).alias(out))
    rest = F.struct(F.lit(0).alias("row"), *(col(c).alias(f"c{i}") for i, c in enumerate(names)))
    long = docs.where(F.length(words) > chunk).select(F.uuid().alias("uid"), rest.alias("rest"), chunks(words).alias("k"))
    long = long.select("uid", "rest", F.explode("k").alias("k")).select("uid", F.when(F.col("k.no") == 0, F.col("rest")).alias("rest"), "k.*")
    pieces = materialized(long, "chunks").select("uid", "rest", "no", piece("part", "start", "into", "next").alias("e"))
    found = pieces.groupBy("uid").agg(
        F.any_value("rest", True).alias("rest"), F.array_sort(F.collect_list(F.struct("no", "e.ids", "e.head", "e.tail"))).alias("chunks"),
    )
    return short.unionAll(found.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)), joined("chunks").alias(out)))


def decoder(spark: SparkSession, path: str = RANKS):
    """A column function from array<int> to the bytes it stands for (binary; cast it to string for text)."""
    shared = spark.sparkContext.broadcast({rank: entry for entry, rank in load_ranks(path).items()})

    @arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        entry = _Entries(shared.value)
        for ids in batches:
            yield pa.array([None if x is None else b"".join(map(entry.__getitem__, x.tolist())) for x in _rows(ids)], pa.binary())

    return decode


class _Entries(dict):
    """Bytes of ids; none for other numbers."""

    def __missing__(self, i: int) -> bytes:
        return b""


def ids_digest(ids: Column) -> Column:
    """SHA-256 of ids as little-endian unsigned 32-bit numbers."""

    @arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in _rows(lists)], pa.string())

    return digest(ids)


def bpe_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to."""
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    rows = encode(rows, path=path, pattern=pattern, chunk=chunk, overlap=overlap, keep_text=False)
    rows = rows.select("doc_id", "ids", decoder(docs.sparkSession, path)("ids").alias("raw"), ids_digest(F.col("ids")).alias("ids_sha256"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("raw", 256).alias("decoded_sha256"))
