"""Splitting long texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import text as tx
from tabulens.functions.nulls import quoted

# Where a text is cut, from the most to the least natural place; the empty one is between any two characters.
SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of chunks that a task holds before it hands them on.
SENT = 1 << 20


def _runs(text: str, size: int, separators: Sequence[str]) -> Iterator[list[str]]:
    """Runs of neighbouring pieces cut at the same kind of place; a separator starts the piece after it."""
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[level], separators[level + 1 :]
    cuts = range(1, len(text)) if sep == "" else [m.start() for m in re.finditer(re.escape(sep), text)]
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    short: list[str] = []
    for part in parts:
        if not part:
            continue
        if len(part) < size or not rest:
            short.append(part)
            continue
        if short:
            yield short
            short = []
        yield from _runs(part, size, rest)
    if short:
        yield short


def _chunks(text: str, size: int, overlap: int) -> Iterator[str]:
    for run in _runs(text, size, SEPARATORS):
        window: list[str] = []
        held = 0
        for piece in run:
            if window and held + len(piece) > size:
                if joined := "".join(window).strip():
                    yield joined
                while held > overlap or (held and held + len(piece) > size):
                    held -= len(window.pop(0))
            window.append(piece)
            held += len(piece)
        if window and (joined := "".join(window).strip()):
            yield joined


def split_recursive(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of at most ``size`` characters that end at natural breaks and share up to ``overlap`` characters."""
    return list(_chunks(text, size, overlap))


def chunk_text(
    df: DataFrame, col: str, keep: Sequence[str] = (), size: int = 1000, overlap: int = 200, mode: str = "recursive"
) -> DataFrame:
    """One row per chunk: ``(keep..., chunk_no, content, length)``.

    ``recursive`` cuts at paragraphs, lines, then words. ``fixed`` cuts every ``size`` characters without
    overlap and drops blank chunks; it needs no Python. Chunks leave a task as they come, so it holds one batch of texts and
    ``SENT`` characters of chunks, however many rows there are.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    kept = [quoted(c) for c in keep]
    if mode == "fixed":
        starts = F.sequence(F.lit(0), F.greatest(F.length(quoted(col)) - 1, F.lit(0)), F.lit(size))
        rows = df.select(*kept, quoted(col).alias("_text"), F.posexplode(starts).alias("chunk_no", "_start"))
        rows = rows.select(
            *keep, "chunk_no", F.substring("_text", F.col("_start") + 1, F.lit(size)).alias("content")
        ).where(tx.strip(F.col("content")) != F.lit(""))
        return rows.withColumn("length", F.length("content"))
    if mode != "recursive":
        raise ValueError(f"unknown mode {mode!r}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns

            def packed(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
                at, numbers, contents = zip(*found)
                rows = pa.array(at, pa.int64())
                columns = [*[c.take(rows) for c in others], pa.array(numbers, pa.int32()), pa.array(contents, texts.type)]
                return pa.RecordBatch.from_arrays(columns, names)

            found, held = [], 0
            for i, value in enumerate(texts):
                for number, content in enumerate(_chunks(value.as_py() or "", size, overlap)):
                    found.append((i, number, content))
                    held += len(content)
                    if held >= SENT:
                        yield packed(found)
                        found, held = [], 0
            if found:
                yield packed(found)

    rows = df.select(*[k.alias(f"k{i}") for i, k in enumerate(kept)], quoted(col).cast("string").alias("text"))
    names = [*rows.columns[:-1], "chunk_no", "content"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("chunk_no", T.IntegerType()), T.StructField("content", T.StringType())])
    chunks = rows.mapInArrow(split, schema).toDF(*keep, "chunk_no", "content")
    return chunks.withColumn("length", F.length("content"))
