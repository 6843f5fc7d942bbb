"""One meaning of "missing": NaN becomes NULL at the edge of every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)
# Text that is a number; anything else is not even tried, as a failed parse is costly.
PARSABLE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def no_nan(name: str, data_type: T.DataType) -> Column:
    column = quoted(name)
    if isinstance(data_type, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def number(df: DataFrame, name: str) -> Column:
    """The column as a double without NaN; text is parsed, bad text is NULL."""
    data_type = df.schema[name].dataType
    column = no_nan(name, data_type)
    if isinstance(data_type, T.DoubleType):
        return column
    if is_numeric(data_type):
        return column.cast("double")
    text = column.cast("string")
    return F.when(text.rlike(PARSABLE), text.try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    if not any(isinstance(f.dataType, FLOATING) for f in df.schema):
        return df
    return df.select(*[no_nan(f.name, f.dataType).alias(f.name) for f in df.schema])
