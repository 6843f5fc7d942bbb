"""Text to number, integer and timestamp, value by value; bad input is NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats tried, in order. One letter stands for one or two digits.
DATE_FORMATS = (
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "d-M-yyyy",
    "M-d-yyyy",
    "yyyyMMdd",
    "d.M.yyyy",
    "yyyy-M-d H:m:s",
    "d/M/yyyy H:m:s",
)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SCALE = (("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("trillion", 1e12))


def to_double(value: Column) -> Column:
    """Plain decimal or scientific notation only: Java suffixes such as ``12d`` are rejected.

    The pattern also spares bad text the cost of a failed parse.
    """
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


_INTEGER = r"^\s*[+-]?\d+\s*$"


def to_long(value: Column) -> Column:
    """Whole numbers; a fraction is NULL, as is what a bigint cannot hold. Digits alone never pass through a double."""
    text = value.cast("string")
    parsed = to_double(value)
    other = F.when(parsed == F.floor(parsed), parsed.try_cast("bigint"))
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("bigint")).otherwise(other)


def to_timestamp_any(value: Column) -> Column:
    return value.cast("string").try_cast("timestamp_ntz")


def _shape(pattern: str) -> str:
    """What a text of this date format looks like."""
    shape = re.escape(pattern)
    for letters, digits in (("yyyy", r"\d{4}"), ("MM", r"\d{2}"), ("dd", r"\d{2}"), ("HH", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}")):
        shape = shape.replace(letters, digits)
    return "^" + re.sub(r"(?<!\\)[MdHms]", r"\\d{1,2}", shape) + "$"


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that fits the value. A failed parse is costly, so only texts of the right shape are tried."""
    text = value.cast("string")
    tries = [
        F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in formats
    ]
    return F.coalesce(*tries)


def same_shape(formats: Sequence[str]) -> list[list[str]]:
    """The formats grouped by what their texts look like, in order: within a group a text does not tell them apart."""
    groups: dict[str, list[str]] = {}
    for f in formats:
        groups.setdefault(_shape(f), []).append(f)
    return list(groups.values())


def parse_number(value: Column, scale_words: bool = False) -> Column:
    """``"12,345 USD"`` to 12345.0; with ``scale_words`` also ``"1.2 million"`` to 1200000.0."""
    text = value.cast("string")
    bare = F.regexp_replace(F.regexp_replace(text, ",", ""), r"[^0-9.\-]", "")
    parsed = bare.try_cast("double")
    if not scale_words:
        return parsed
    factor = F.lit(1.0)
    for word, size in _SCALE:
        factor = F.when(F.contains(F.lower(text), F.lit(word)), F.lit(size)).otherwise(factor)
    return parsed * factor
