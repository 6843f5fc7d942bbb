"""Fill-in-middle transformation by displacement scatter.

The texts of an Arrow batch lie in one buffer of bytes. A scan finds where their tokens end, and so the two cuts of each
text. Prefix, middle and suffix keep their bytes in order and only move: a difference array holds, at the first byte of each
part, by how much its displacement differs from that of the part before; its cumulative sum is every byte's shift, and one
numpy scatter writes all outputs. Restoring finds the marks and gathers the bytes back the same way. Both go through the
buffer in blocks of ``BLOCK`` bytes, so beside the texts and results of a batch little is held. Nothing is shuffled.

A token is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+``, or the white space that ends a text. The numbers that choose cuts and
form are the first groups of eight digits of the SHA-256 of ``seed:doc_id``, so they are the same in every run.

Edge cases: a null text is taken as empty; empty texts and texts that hold a mark stay plain. A null id has the name
``null``. Repeated rows come out alike. An empty table gives an empty one. Other columns stay as they are; one named as the
result is replaced. An output without its three marks in order restores to null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.llm.common import SPACES, col, small_batches

SEED = 42
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many begin with the suffix.
RATE = 50
SUFFIX_FIRST = 80
#: Bytes moved at a time.
BLOCK = 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = np.array(["plain", "psm", "spm"], object)

_MARK = 3
_SPACE = np.isin(np.arange(256), list(SPACES))
_OPEN, _CLOSE = ord("<"), ord(">")
_NAMES = {ord(m[1]): m.encode() for m in (PREFIX, SUFFIX, MIDDLE)}


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each begins and the last ends."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def unflat(data: np.ndarray, at: np.ndarray, gone: np.ndarray | None = None) -> pa.Array:
    made = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return made if gone is None or not gone.any() else pa.array(np.where(gone, None, made.to_numpy(zero_copy_only=False)), pa.string())


def _marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, and in which text; a mark does not reach across two texts."""
    opened = np.flatnonzero(data[:-2] == _OPEN) if len(data) > 2 else np.zeros(0, np.int64)
    opened = opened[(data[opened + 2] == _CLOSE) & np.isin(data[opened + 1], list(_NAMES))]
    text = np.searchsorted(at, opened, "right") - 1
    inside = opened + _MARK <= at[text + 1]
    return opened[inside], text[inside]


def _shifts(starts: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, every byte's shift) block by block, for parts that begin at ``starts`` (ascending) with a shift each."""
    step = np.diff(shift, prepend=0)
    now = 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        a, b = np.searchsorted(starts, [begin, end])
        change = np.zeros(end - begin, np.int64)
        np.add.at(change, starts[a:b] - begin, step[a:b])
        change[0] += now
        moved = np.cumsum(change, out=change)
        yield begin, end, moved
        now = int(moved[-1])


def _cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text, and the places of its cuts."""
    space = _SPACE[data]
    last = np.zeros(len(data), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    last[:-1] |= ~space[:-1] & space[1:]
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(ends, at[:-1], "right")
    n = np.searchsorted(ends, at[1:], "right") - first
    one, two = h1 % (n + 1), h2 % (n + 1)
    ends = np.append(ends, 0)
    place = lambda k: np.where(k > 0, ends[first + k - 1], at[:-1])
    return n, place(np.minimum(one, two)), place(np.maximum(one, two))


def transform(texts: pa.Array, h: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> pa.StructArray:
    """n, form, prefix_chars, middle_chars and output of texts; ``h`` holds four numbers for each."""
    data, at = flat(texts)
    n, one, two = _cuts(data, at, h[:, 0], h[:, 1])
    size = np.diff(at)
    marked = np.zeros(len(size), bool)
    marked[_marks(data, at)[1]] = True
    plain = (size == 0) | marked | (h[:, 2] % 100 >= rate)
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    one, two = np.where(plain, at[1:], one), np.where(plain, at[1:], two)
    prefix, middle, suffix = one - at[:-1], two - one, at[1:] - two
    to = np.concatenate([[0], np.cumsum(np.where(plain, size, size + 3 * _MARK))])
    start = to[:-1]
    # Where the parts go; of a plain text the prefix is all, and the other parts are empty.
    prefix_to = np.where(plain, start, np.where(spm, start + 2 * _MARK + suffix, start + _MARK))
    suffix_to = np.where(spm, start + _MARK, start + 2 * _MARK + prefix)
    middle_to = start + 3 * _MARK + prefix + suffix
    starts = np.stack([at[:-1], one, two], 1).ravel()
    shift = np.stack([prefix_to - at[:-1], middle_to - one, suffix_to - two], 1).ravel()
    out = np.empty(to[-1], np.uint8)
    for begin, end, moved in _shifts(starts, shift, len(data)):
        out[np.arange(begin, end) + moved] = data[begin:end]
    cut = ~plain
    for mark, place in ((PREFIX, prefix_to), (SUFFIX, suffix_to), (MIDDLE, middle_to)):
        for k, byte in enumerate(mark.encode()):
            out[place[cut] - _MARK + k] = byte
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()), pa.array(FORMS[np.where(plain, 0, np.where(spm, 2, 1))], pa.string()),
            pa.array(points[one] - points[at[:-1]], pa.int64(), mask=plain), pa.array(points[two] - points[one], pa.int64(), mask=plain), unflat(out, to),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def inverse(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that ``transform`` made these outputs of."""
    data, at = flat(outputs)
    form = np.array(forms.fill_null("plain").to_pylist() or [], object)
    size = np.diff(at)
    cut = form != FORMS[0]
    places, text = _marks(data, at)
    places, text = places[cut[text]], text[cut[text]]
    gone = cut & (np.bincount(text, minlength=len(size)) != 3)
    held = np.flatnonzero(cut & ~gone)
    second, third = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    three = places[~gone[text]].reshape(-1, 3)
    second[held], third[held] = three[:, 1], three[:, 2]
    spm = form == FORMS[2]
    named = np.where(spm[held, None], [ord(m[1]) for m in (SUFFIX, PREFIX, MIDDLE)], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)])
    gone[held] |= (three[:, 0] != at[held]) | (data[three + 1] != named).any(1)
    cut &= ~gone
    # The two parts before the middle, in the order of the output.
    a, b, middle = second - at[:-1] - _MARK, third - second - _MARK, at[1:] - third - _MARK
    length = np.where(cut, size - 3 * _MARK, size)
    to = np.concatenate([[0], np.cumsum(length)])
    prefix_from = np.where(cut, np.where(spm, second, at[:-1]) + _MARK, at[:-1])
    prefix = np.where(cut, np.where(spm, b, a), size)
    suffix_from = np.where(spm, at[:-1], second) + _MARK
    one = to[:-1] + prefix
    two = np.where(cut, one + middle, one)
    starts = np.stack([to[:-1], one, two], 1).ravel()
    shift = np.stack([prefix_from - to[:-1], third + _MARK - one, suffix_from - two], 1).ravel()
    back = np.empty(to[-1], np.uint8)
    for begin, end, moved in _shifts(starts, shift, int(to[-1])):
        back[begin:end] = data[np.arange(begin, end) + moved]
    return unflat(back, to, gone)


def numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with ``out``: n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    small_batches(docs.sparkSession)

    @arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def moved(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        return transform(texts, np.stack([x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)], 1), rate, suffix_first)

    return docs.withColumn(out, moved(col(text).cast("string"), *numbers(col(doc_id), seed)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form come from."""

    @arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return inverse(outputs, forms)

    return back(output, form)


def fill_in_middle_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    made = fill_in_middle(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")))
    made = made.withColumn("text", restored(F.col("fim.output"), F.col("fim.form")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest("fim.output").alias("output_sha256"), digest("text").alias("restored_sha256"))
