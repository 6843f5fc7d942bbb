"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

One pass over the text: at every end position the automaton and its output links name all pieces that end there, longest
first, and each relaxes the best score of that position. A character without a piece of its own may also be passed at the
score of the worst single character less ten, and is written as byte pieces. Of equal scores the longer last piece wins.

A space becomes U+2581 and a text gets one in front, as the model's vocabulary expects; U+2581 itself is written as byte
pieces. So decoding returns every text exactly. Texts are searched in parts that no piece of the vocabulary reaches across
(whole texts, if there are none), and the results for short parts are remembered.

The model file is read on the driver (its path is a parameter); the pieces, one vocabulary in size, travel as a broadcast.

Edge cases: a null text has null tokens and decodes to null; an empty one has none. Ids outside the vocabulary, and
control or unknown pieces, decode to nothing; byte pieces that are no UTF-8 decode to U+FFFD. Repeated rows are encoded
each for itself. An empty table gives an empty one. Other columns stay as they are; one named as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.llm.common import col, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NEVER = float("-inf")
_UNKNOWN = (1, 0.0, -1)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: (piece, score, id) of ordinary pieces, and the ids of the 256 byte pieces."""

    ordinary: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        ordinary = tuple((model.id_to_piece(i), model.get_score(i), i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        named = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        return cls(ordinary, tuple(named[f"<0x{b:02X}>"] for b in range(256)))


class _Remembered(dict):
    """Packed ids of parts of texts; short parts are kept, up to a bound."""

    KEPT = 400_000
    SHORT = 48

    def __init__(self, search):
        super().__init__()
        self.search = search

    def __missing__(self, part: str) -> bytes:
        found = np.array(self.search(part), np.int32).tobytes()
        if len(part) <= self.SHORT:
            if len(self) >= self.KEPT:
                self.clear()
            self[part] = found
        return found


class Raw:
    """The bytes of the pieces, one after the other by id; none for other ids."""

    def __init__(self, pieces: Pieces):
        named = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces.ordinary} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.size = max(named) + 1
        # The last one stands for all ids outside the vocabulary.
        self.bytes = pa.array([named.get(i, b"") for i in range(self.size + 1)], pa.large_binary())

    def texts(self, rows: pa.Array) -> list[str | None]:
        """The texts of rows of ids, one lookup for all of them."""
        ids = rows.flatten().fill_null(self.size).to_numpy(zero_copy_only=False)
        if not len(ids):
            return ["" if here else None for here in rows.is_valid().to_pylist()]
        found = self.bytes.take(pa.array(np.where((ids >= 0) & (ids < self.size), ids, self.size), pa.int64()))
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(ids) + 1, found.offset * 8)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = at[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
        whole = b"" if data is None else data
        return [
            _unspaced(str(memoryview(whole)[a:b], "utf-8", "replace")) if here else None
            for a, b, here in zip(ends, ends[1:], rows.is_valid().to_pylist())
        ]


def _unspaced(text: str) -> str:
    return text[1:] if text.startswith(" ") else text


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, pieces: Pieces):
        self.bytes = pieces.byte_ids
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces.ordinary:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in pieces.ordinary if len(p) == 1}
        self.unknown = min((s for p, s, _ in pieces.ordinary if len(p) == 1), default=0.0) - 10.0
        self.words = re.compile(self._cut([p for p, _, _ in pieces.ordinary]))
        self.memory = _Remembered(self.best)
        self.literal = np.array([self.bytes[b] for b in SPACE.encode()], np.int32).tobytes()
        self.raw = Raw(pieces)

    @staticmethod
    def _cut(pieces: list[str]) -> str:
        """A pattern for the parts of a text that no piece reaches across.

        Parts start at a space, and where letters meet other characters unless a piece holds both.
        """
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return "(?s).+"
        bare = [p.lstrip(SPACE) for p in pieces]
        # Superscripts and the like, which are word characters without being letters, stay with what is no letter.
        odd = "".join(sorted({c for p in bare for c in p if _LETTER.match(c) and not c.isalpha()}))
        if any(len({bool(_LETTER.match(c)) and c not in odd for c in p}) > 1 for p in bare):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        return rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{odd}])+|{SPACE}+"

    def best(self, word: str) -> list[int]:
        """The ids of the segmentation with the best sum of scores."""
        n = len(word)
        # score[i] is the best up to and with character i; score[-1], the last item, is that of nothing.
        score, back = [_NEVER] * n + [0.0], [_UNKNOWN] * n
        unknown = () if self.single.issuperset(word) else [i for i, c in enumerate(word) if c not in self.single]
        waiting = iter((*unknown, n))
        odd = next(waiting)
        for end, match in self.automaton.iter(word):
            while odd < end:
                if (value := score[odd - 1] + self.unknown) > score[odd]:
                    score[odd], back[odd] = value, _UNKNOWN
                odd = next(waiting)
            if (value := score[end - match[0]] + match[1]) > score[end]:
                score[end], back[end] = value, match
        while odd < n:
            if (value := score[odd - 1] + self.unknown) > score[odd]:
                score[odd], back[odd] = value, _UNKNOWN
            odd = next(waiting)
        out, at = [], n - 1
        while at >= 0:
            size, _, i = back[at]
            out.extend([i] if i >= 0 else [self.bytes[b] for b in reversed(word[at].encode())])
            at -= size
        out.reverse()
        return out

    def encode_packed(self, text: str) -> bytes:
        """The token ids as 32-bit numbers."""
        if not text:
            return b""
        out = []
        for k, part in enumerate(text.split(SPACE)):
            spaced = part.replace(" ", SPACE)
            out.append(b"".join(map(self.memory.__getitem__, self.words.findall(spaced if k else SPACE + spaced))))
        return self.literal.join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.raw.texts(pa.array([ids], pa.list_(pa.int32())))[0]


def _plain(pieces: Pieces) -> dict:
    """Plain data: a broadcast names its classes, and workers need not have the package."""
    return {"pieces": (pieces.ordinary, pieces.byte_ids)}


def _kept(shared: dict, name: str, make: Callable[[Pieces], Codec | Raw]) -> Codec | Raw:
    """What a worker makes of the pieces: it stays with the broadcast from task to task, and so does what it remembers."""
    if name not in shared:
        shared[name] = make(Pieces(*shared["pieces"]))
    return shared[name]


def encoder(spark: SparkSession, path: str = MODEL):
    """A column function from text to array<int>."""
    shared = spark.sparkContext.broadcast(_plain(Pieces.load(path)))

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _kept(shared.value, "codec", Codec)
        for texts in batches:
            packed = [None if (t := x.as_py()) is None else codec.encode_packed(t) for x in texts]
            ends = np.cumsum([0, *(len(p) // 4 if p else 0 for p in packed)])
            ids = pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids, mask=pa.array([p is None for p in packed], pa.bool_()))

    return encode


def decoder(spark: SparkSession, path: str = MODEL):
    """A column function from array<int> to text."""
    shared = spark.sparkContext.broadcast(_plain(Pieces.load(path)))

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = _kept(shared.value, "raw", Raw)
        for ids in batches:
            yield pa.array(raw.texts(ids), pa.string())

    return decode


def encode_docs(docs: DataFrame, text: str = "text", tokens: str = "tokens", path: str = MODEL) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(tokens, encoder(docs.sparkSession, path)(col(text).cast("string")))


def decode_docs(docs: DataFrame, tokens: str = "tokens", text: str = "text", path: str = MODEL) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(text, decoder(docs.sparkSession, path)(col(tokens)))


def codec_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, a 64-bit hash of the ids, and whether decoding gives the text."""
    byte_ids = Pieces.load(path).byte_ids
    both = decode_docs(encode_docs(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")), path=path), text="decoded", path=path)
    return both.select(
        "doc_id", F.size(F.coalesce("tokens", F.array().cast("array<int>"))).cast("long").alias("n_tokens"),
        F.coalesce(F.size(F.filter("tokens", lambda i: i.isin(*byte_ids))), F.lit(0)).cast("long").alias("n_byte_tokens"),
        F.xxhash64("tokens").alias("tokens_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
