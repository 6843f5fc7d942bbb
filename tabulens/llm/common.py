"""What the operators of this package share: column access, tables, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# The bytes [\x20\x09-\x0D]: what bytes.split() and bytes.strip() take as white space.
SPACES = b" \t\n\x0b\x0c\r"


def col(name: str) -> Column:
    """A column by its plain name: dots and backticks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound the text that one Arrow batch may hold: rows of whole texts differ a thousandfold in size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode()
