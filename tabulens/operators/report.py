"""The tables of a report. Layout is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.operators.profile import profile_columns, quality_score
from tabulens.operators.schema import columns_of, numeric_columns
from tabulens.operators.stats import summarize


def report_overview(df: DataFrame) -> DataFrame:
    """Records, features by kind, missing cells and duplicate records; one row."""
    return quality_score(df).select(
        F.col("n_rows").alias("total_records"),
        F.lit(len(df.columns)).alias("total_features"),
        F.lit(len(columns_of(df, "numeric"))).alias("numeric_features"),
        F.lit(len(columns_of(df, "categorical"))).alias("categorical_features"),
        F.col("missing").alias("missing_values"),
        F.col("duplicates").alias("duplicate_records"),
    )


def report_features(df: DataFrame, first: int | None = None) -> DataFrame:
    """name, dtype, missing, unique, mean and std of the columns, or of the ``first`` ones."""
    part = df.select(*df.columns[:first])
    return profile_columns(part).select(
        F.col("column").alias("name"), "dtype", "num_missing", "num_unique", "mean", "std"
    )


def report_numeric(df: DataFrame, first: int | None = None) -> DataFrame:
    """mean, std, min and max of the numeric columns, or of the ``first`` ones, to two decimals."""
    found = summarize(df, numeric_columns(df)[:first], probs=())
    return found.select(
        F.col("column").alias("feature"), *[F.round(m, 2).alias(m) for m in ("mean", "std", "min", "max")]
    )
