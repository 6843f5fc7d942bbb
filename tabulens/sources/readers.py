"""CSV, JSON, text and parquet readers. Large inputs should come with a schema: inferring one reads the data twice."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.nulls import quoted
from tabulens.session import materialized, scratch_path
from tabulens.sources import json_documents
from tabulens.sources.chunking import chunk_text
from tabulens.sources.json_documents import plain_path

CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None,
    sampling_ratio: float | None = None, **options: object,
) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
    return reader.options(**options).csv(path)


#: A file of objects is lines if at least this share of its lines are objects by themselves.
LINES_SHARE = 0.5


def _base(path: str | Sequence[str], files: Sequence[str]) -> str | None:
    """The folder below which folder names are partition columns; None where the path names files."""
    if not isinstance(path, str):
        return None
    ends = path.split("://", 1)[-1].rstrip("/")
    if any(f == path or f.endswith(ends) for f in files):
        return None
    head = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    return path if head == path else head.rsplit("/", 1)[0]


def _forms(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str], str | None, tuple[DataFrame, DataFrame] | None]:
    """Files of JSON Lines, files that are one document, the base of partition columns, and what cutting documents needs.

    A document begins with a bracket and ends with its counterpart, which no earlier one closes. A file of that kind that
    begins with a brace is lines all the same if half of its lines are objects. Everything else is lines, bad ones included.
    """
    ends = materialized(json_documents.file_ends(spark, path), "ends")
    pairs = (F.col("first") == "[") & (F.col("last") == "]") | (F.col("first") == "{") & (F.col("last") == "}")
    look = ends.select("file", "first", pairs.alias("pairs")).collect()
    every = [plain_path(r["file"]) for r in look]
    base = _base(path, every)
    objects = [plain_path(r["file"]) for r in look if r["pairs"] and r["first"] == "{"]
    lines: set[str] = set()
    if objects:
        rows = json_documents.as_text(spark, objects, base).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(json_documents.BLANK)).alias("value"))
        # In brackets, as a parser stops after a first complete value: one element, and nothing behind it.
        one = F.json_object_keys("value").isNotNull() & (F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1)
        share = rows.where("value != ''").groupBy("file").agg(F.avg(F.coalesce(one, F.lit(False)).cast("int")).alias("share"))
        lines = {plain_path(r["file"]) for r in share.collect() if r["share"] >= LINES_SHARE}
    maybe = [r["file"] for r in look if r["pairs"] and plain_path(r["file"]) not in lines]
    if not maybe:
        return every, [], base, None
    ends = ends.where(F.col("file").isin(maybe))
    single, pieces, starts = json_documents.documents_of(spark, ends, base)
    return [f for f in every if f not in set(single)], single, base, (pieces, starts)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both; text where nothing else does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return _merged(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wider(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.LongType() if {type(a), type(b)} <= {T.LongType, T.IntegerType} else T.DoubleType()
    return T.StringType()


def _merged(a: T.StructType, b: T.StructType) -> T.StructType:
    other = {f.name: f.dataType for f in b}
    fields = [T.StructField(f.name, _wider(f.dataType, other.get(f.name, f.dataType))) for f in a]
    return T.StructType(fields + [f for f in b if f.name not in {x.name for x in a}])


def read_json(
    spark: SparkSession, path: str | Sequence[str], lines: bool | None = None, on_bad: str = "fail",
    schema: str | T.StructType | None = None, flatten: bool = True, **options: object,
) -> DataFrame:
    """JSON Lines, or files holding one array or object each; each file is looked at for itself. Partition columns are kept.

    ``lines`` says that all files are of one kind and spares the look. ``on_bad``: ``fail``, ``skip`` bad records, or
    ``keep`` them in ``_corrupt_record``; what is no object counts as bad. Lines and arrays are read by many tasks: an array is
    cut into its records, which are written as lines (of one partition folder each) and read again. Files in which one column
    has different types get the wider type.
    """
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[on_bad]
    parts: list[tuple[str | Sequence[str], dict[str, object]]]
    if lines is not None:
        parts = [(path, {"multiLine": not lines})]
    else:
        many, single, base, cut = _forms(spark, path)
        keep = {} if base is None else {"basePath": base}
        parts = [(many if single else path, keep if single else {})] if many or not single else []
        if single:
            found = json_documents.records(*cut, single)
            folder, own = scratch_path(spark, "records"), [c for c in found.columns if c != "value"]
            # By ranges, so that a task writes into a few folders and a large folder is shared by many: files do not multiply.
            ranges = found.repartitionByRange(*[quoted(c) for c in own], F.xxhash64("value")) if own else found
            writer = ranges.write.partitionBy(*own) if own else found.write
            writer.text(folder)
            parts.append((folder, {}))

    def read(files: str | Sequence[str], extra: dict[str, object], given: str | T.StructType | None) -> DataFrame:
        reader = spark.read.option("mode", mode).options(**extra).options(**options)
        return (reader if given is None else reader.schema(given)).json(files)

    frames = [read(*part, schema) for part in parts]
    if len(frames) > 1 and schema is None:
        both = _merged(frames[0].schema, frames[1].schema)
        frames = [read(*part, both) for part in parts]
    df = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
    return flatten_structs(df) if flatten else df


def bad_line_count(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines that parse and lines that do not; blank lines count as neither."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull()
    return rows.agg(F.count_if(good).alias("good_lines"), F.count_if(~good).alias("bad_lines"))


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested objects become columns, at any depth; arrays stay whole."""

    def leaves(column: Column, name: str, data_type: T.DataType) -> list[Column]:
        if isinstance(data_type, T.StructType):
            return [x for f in data_type for x in leaves(column.getField(f.name), f"{name}{sep}{f.name}", f.dataType)]
        return [column.alias(name)]

    return df.select(*[x for f in df.schema for x in leaves(quoted(f.name), f.name, f.dataType)])


def unwrap_envelope(df: DataFrame, field: str = "data") -> DataFrame:
    """The objects inside an array field, one row each."""
    return df.select(F.inline(quoted(field)))


def decode(binary: Column, fallback: str = "cp1252") -> Column:
    """Bytes to text: UTF-8 where valid, else the fallback, else UTF-8 without the bad bytes.

    The check runs in the JVM; only bytes that are not valid UTF-8 are handed to Python.
    """

    @F.pandas_udf("string")
    def other(raw: pd.Series) -> pd.Series:
        def one(value: bytes | None) -> str | None:
            if value is None:
                return None
            try:
                return bytes(value).decode(fallback)
            except UnicodeDecodeError:
                return bytes(value).decode("utf-8", errors="ignore")

        return raw.map(one)

    text = binary.cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, text).otherwise(other(F.when(~valid, binary)))


def decode_text(df: DataFrame, col: str, out: str = "content") -> DataFrame:
    return df.withColumn(out, decode(quoted(col)))


def read_text(
    spark: SparkSession, path: str | Sequence[str], size: int = 1000, overlap: int = 200, mode: str = "recursive"
) -> DataFrame:
    """Text files as chunks ``(content, metadata, length)``, metadata being JSON with the source file."""
    files = spark.read.format("binaryFile").load(path).select(
        F.to_json(F.struct(F.col("path").alias("source"))).alias("metadata"), "content"
    )
    chunks = chunk_text(decode_text(files, "content", "content"), "content", ["metadata"], size, overlap, mode)
    if chunks.isEmpty():
        raise ValueError(f"No text extracted from {path}")
    return chunks.select("content", "metadata", "length")


def read_parquet(spark: SparkSession, path: str | Sequence[str], spread: bool = False) -> DataFrame:
    """Parquet. ``spread`` is for costly work per row (text): an input of fewer pieces than cores is dealt out once.

    Cheap aggregations gain nothing from it, and an input with enough pieces is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not spread or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_any(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The reader for the file extension."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, **options)
    if name.endswith((".json", ".jsonl", ".ndjson")):
        return read_json(spark, path, **options)
    if name.endswith(".txt"):
        return read_text(spark, path, **options)
    if name.endswith(".parquet"):
        return read_parquet(spark, path, **options)
    if name.endswith((".xlsx", ".xls", ".pdf", ".png", ".jpg", ".jpeg")):
        raise ValueError(f"{path}: convert spreadsheets, PDF and images to CSV, JSON, text or parquet first")
    raise ValueError(f"{path}: unsupported file type")


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def head_tail(df: DataFrame, order_by: Sequence[str], head: int = 3, tail: int = 2) -> DataFrame:
    """The first and the last rows in a given order."""
    first = df.orderBy(*[quoted(c).asc() for c in order_by]).limit(head).withColumn("side", F.lit("head"))
    last = df.orderBy(*[quoted(c).desc() for c in order_by]).limit(tail).withColumn("side", F.lit("tail"))
    return first.unionByName(last)


def save_dataset(df: DataFrame, report: DataFrame | None, path: str) -> None:
    """The cleaned table and its report, as two parquet tables."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    if report is not None:
        report.write.mode("overwrite").parquet(f"{path}/report")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")
