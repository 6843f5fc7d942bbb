"""Dataset and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.nulls import FLOATING, number, quoted
from tabulens.operators.quantiles import collect_quantiles
from tabulens.operators.schema import (
    columns_of,
    numeric_columns,
    per_column,
    possible_analyses,
    present,
    text_columns,
)

_TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)


# ---- shared pieces -------------------------------------------------------------------------------


def unpivot_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Present values as rows ``(column, value)``, value as text: one scan for all columns."""
    pairs = [
        F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in cols
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value").where("value IS NOT NULL")
    )


def smallest_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows per group. Spark keeps only n per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def comparable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be grouped: maps become sorted entries, NaN becomes NULL."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.array_sort(F.map_entries(quoted(name)))
    return present(df, name)


def same_zero(df: DataFrame, name: str) -> Column:
    """``comparable`` with -0.0 as 0.0, which hashes tell apart."""
    value = comparable(df, name)
    return value + F.lit(0.0).cast(df.schema[name].dataType) if isinstance(df.schema[name].dataType, FLOATING) else value


def row_digests(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row, missing places included, and 32 of another kind to tell a collision by."""
    # A hash passes over missing values, so where they are goes in as well.
    parts = [same_zero(df, c) for c in df.columns] + [present(df, c).isNull() for c in df.columns]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts, F.lit(1)), F.hash(*parts)]


def duplicate_stats(df: DataFrame) -> DataFrame:
    """``n_rows, n_distinct``: rows are shuffled as digests, repeated ones collapse before.

    Two different rows of one digest would be seen by a third hash and count as two.
    """
    digests = df.select(*[d.alias(f"h{k}") for k, d in enumerate(row_digests(df))])
    each = digests.groupBy("h0", "h1").agg(F.count("*").alias("copies"), (F.min("h2") != F.max("h2")).cast("long").alias("more"))
    return each.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"), (F.count("*") + F.coalesce(F.sum("more"), F.lit(0))).alias("n_distinct"))


# ---- dataset level -------------------------------------------------------------------------------


def profile_dataset(df: DataFrame, data_type: str = "table") -> DataFrame:
    """Rows, columns, kinds and the analyses the table allows; one row."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(data_type).alias("data_type"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(len(columns_of(df, "numeric"))).alias("n_numeric"),
        F.lit(len(columns_of(df, "categorical"))).alias("n_categorical"),
        F.lit(len(columns_of(df, "temporal"))).alias("n_temporal"),
        F.array(*[F.lit(a) for a in possible_analyses(df)]).cast("array<string>").alias("analyses"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, as a count and as a share of rows."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(present(df, c).isNull()).alias("num_missing"),
            F.coalesce(F.avg(present(df, c).isNull().cast("double")), F.lit(0.0)).alias("pct_missing"),
        )
        for c in df.columns
    ]
    return per_column(df, entries)


def duplicate_count(df: DataFrame) -> DataFrame:
    return duplicate_stats(df).select("n_rows", (F.col("n_rows") - F.col("n_distinct")).alias("num_duplicates"))


def quality_score(df: DataFrame) -> DataFrame:
    """``round(100 * (0.7 * completeness + 0.3 * uniqueness), 2)``; 0 for an empty table."""
    cells = F.col("n_rows") * len(df.columns)
    score = (1 - F.col("missing") / cells) * 0.7 + (F.col("n_distinct") / F.col("n_rows")) * 0.3
    # One group-by for both parts: each digest also knows the missing cells of its row.
    empty = sum((present(df, c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    digests = df.select(*[d.alias(f"h{k}") for k, d in enumerate(row_digests(df))], empty.alias("empty"))
    each = digests.groupBy("h0", "h1").agg(F.count("*").alias("copies"), (F.min("h2") != F.max("h2")).cast("long").alias("more"), F.sum("empty").alias("empty"))
    stats = each.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"), (F.count("*") + F.coalesce(F.sum("more"), F.lit(0))).alias("n_distinct"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("missing"),
    )
    return stats.select(
        "n_rows",
        "missing",
        (F.col("n_rows") - F.col("n_distinct")).alias("duplicates"),
        F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.round(score * 100, 2)).alias("quality_score"),
    )


# ---- column level --------------------------------------------------------------------------------


def _digests(df: DataFrame, name: str) -> list[Column]:
    """128 bits that stand for a value, and 32 more of another kind to tell a collision by; NULL where it is missing."""
    value = same_zero(df, name)
    return [F.xxhash64(value), F.xxhash64(F.lit(name), value, F.lit(1)), F.hash(value)]


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct present values per column, any number of columns in one scan.

    Every value becomes (column number, 128-bit digest), repeated ones collapse in the task that reads them, and the digest
    spreads a column over all tasks; texts are not shuffled. Two values of one digest would be seen by a third hash and count
    as two. ``approx`` replaces the exact count by a sketch of fixed size.
    """
    cols = list(cols or df.columns)
    if approx:
        return per_column(df, [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(comparable(df, c)).alias("num_unique")) for c in cols], batch=len(cols))
    names = F.array(*[F.lit(c) for c in cols])
    held = [F.when(comparable(df, c).isNotNull(), F.struct(F.lit(i).alias("i"), *[d.alias(f"h{k}") for k, d in enumerate(_digests(df, c))])) for i, c in enumerate(cols)]
    values = df.select(F.explode(F.array(*held)).alias("v")).where("v IS NOT NULL").select("v.*")
    counted = values.groupBy("i", "h0", "h1").agg((F.min("h2") != F.max("h2")).cast("long").alias("more"))
    counted = counted.groupBy("i").agg((F.count("*") + F.sum("more")).alias("num_unique"))
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))
    # One row for each column on both sides.
    found = every.join(F.broadcast(counted), "i", "left")
    return found.select(F.get(names, F.col("i")).alias("column"), F.coalesce("num_unique", F.lit(0).cast("long")).alias("num_unique"))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median and sample standard deviation per numeric column."""
    from tabulens.operators.stats import summarize

    found = summarize(df, cols or numeric_columns(df), probs=(0.5,))
    return found.select("column", "min", "max", "mean", F.col("q50").alias("median"), "std")


def zscore_outliers(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Values more than ``threshold`` sample standard deviations from the mean; none where that is 0."""
    cols = list(cols or numeric_columns(df))
    moments = _moments(df, cols)
    entries = []
    for c in cols:
        mean, std = moments[c]
        x = number(df, c)
        hit = F.abs((x - F.lit(mean)) / F.lit(std)) > threshold if std else F.lit(False)
        entries.append(F.struct(F.lit(c).alias("column"), F.count_if(hit).alias("num_outliers")))
    return per_column(df, entries)


def _moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation as literals: one small row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.avg(number(df, c)).alias("m"), F.stddev_samp(number(df, c)).alias("s"))
        for c in cols
    ]
    return {r["column"]: (r["m"], r["s"]) for r in per_column(df, entries).collect()}


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values per column; equal counts in value order."""
    cols = list(cols or text_columns(df))
    counts = unpivot_text(df, cols).groupBy("column", "value").agg(F.count("*").alias("count"))
    return smallest_per_group(counts, ["column"], [F.desc("count"), F.asc("value")], k)


def date_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or [f.name for f in df.schema if isinstance(f.dataType, _TEMPORAL)])
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(quoted(c)).cast("timestamp_ntz").alias("min_date"),
            F.max(quoted(c)).cast("timestamp_ntz").alias("max_date"),
        )
        for c in cols
    ]
    return per_column(df, entries)


def basic_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """mean, median, std, min, max, q1, q3, count per numeric column."""
    from tabulens.operators.stats import summarize

    found = summarize(df, cols or numeric_columns(df))
    return found.select(
        "column", "mean", F.col("q50").alias("median"), "std", "min", "max",
        F.col("q25").alias("q1"), F.col("q75").alias("q3"), "count",
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, with exact quartiles."""
    from tabulens.operators.stats import summarize

    found = summarize(df, cols or numeric_columns(df))
    return found.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def temporal_density(df: DataFrame, col: str) -> DataFrame:
    """Distinct points in time, and whether they make a series: at least 10, at most 80 % of the rows."""
    points = df.groupBy(quoted(col).alias("t")).agg(F.count("*").alias("n"))
    totals = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("t").alias("time_points"))
    series = (F.col("time_points") >= 10) & (F.col("time_points") <= F.col("n_rows") * 0.8)
    return totals.select(F.lit(col).alias("column"), "time_points", "n_rows", series.alias("is_series"))


def sample_values(df: DataFrame, n: int = 3, max_cols: int | None = None) -> DataFrame:
    """The n smallest distinct values, as text, of all columns or the first ``max_cols``."""
    rows = unpivot_text(df, df.columns[:max_cols]).distinct()
    return smallest_per_group(rows, ["column"], ["value"], n)


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, missing, distinct, numeric statistics, outliers, date range.

    One scan for the statistics, one for the outliers with the means as literals, those of the medians and distinct counts.
    """
    numeric = numeric_columns(df)
    entries = []
    for f in df.schema:
        is_num, is_time = f.name in numeric, isinstance(f.dataType, _TEMPORAL)
        x = number(df, f.name) if is_num else F.lit(None).cast("double")
        t = quoted(f.name) if is_time else F.lit(None)
        here = present(df, f.name)
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(is_num).alias("is_num"),
                F.count_if(here.isNull()).alias("num_missing"),
                F.coalesce(F.avg(here.isNull().cast("double")), F.lit(0.0)).alias("pct_missing"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(t).cast("timestamp_ntz").alias("min_date"),
                F.max(t).cast("timestamp_ntz").alias("max_date"),
            )
        )
    stats = _with_medians(df, per_column(df, entries), numeric)
    # Both sides have one row per column.
    return stats.join(F.broadcast(distinct_counts(df, approx=approx)), "column").select(
        "column", "dtype", "num_missing", "pct_missing", "num_unique", "min", "max", "mean", "median", "std",
        "num_outliers", "min_date", "max_date",
    )


def _with_medians(df: DataFrame, base: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Medians and outliers by further scans; everything that passes the driver has one row per column."""
    rows = base.collect()
    median = {c: q[0] for c, q in collect_quantiles(df, numeric, [0.5]).items() if q}
    entries = []
    for r in rows:
        hit = F.lit(False)
        if r["is_num"] and r["std"]:
            hit = F.abs((number(df, r["column"]) - F.lit(r["mean"])) / F.lit(r["std"])) > 3
        entries.append(F.struct(F.lit(r["column"]).alias("column"), F.count_if(hit).alias("n")))
    outliers = {r["column"]: r["n"] for r in per_column(df, entries).collect()}
    schema = T.StructType(
        [*base.schema, T.StructField("median", T.DoubleType()), T.StructField("num_outliers", T.LongType())]
    )
    full = [(*r, median.get(r["column"]), outliers[r["column"]] if r["is_num"] else None) for r in rows]
    return df.sparkSession.createDataFrame(full, schema)


def long_metrics(part: str, df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """A per-column frame as rows ``(part, column, metric, value)``."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(
        F.lit(part).alias("part"), F.col(key).alias("column"), F.explode(F.array(*pairs)).alias("m")
    ).select("part", "column", "m.metric", "m.value")


def comprehensive_profile(df: DataFrame) -> DataFrame:
    """Description, correlations, distinct and missing counts as one long table."""
    from tabulens.operators.stats import correlation

    pairs = correlation(df, numeric_columns(df)).select(
        F.concat_ws(" ~ ", "a", "b").alias("column"), "r"
    )
    return (
        long_metrics(
            "describe", describe_numeric(df), "column",
            ["count", "mean", "std", "min", "q25", "q50", "q75", "max"],
        )
        .unionByName(long_metrics("correlation", pairs, "column", ["r"]))
        .unionByName(long_metrics("unique", distinct_counts(df), "column", ["num_unique"]))
        .unionByName(long_metrics("missing", missing_counts(df), "column", ["num_missing"]))
    )


def cleaning_profile(df: DataFrame) -> dict[str, DataFrame]:
    """What a cleaning plan is decided on: shape, columns, missing, duplicates, samples."""
    from tabulens.operators.schema import column_kinds

    return {
        "dataset": profile_dataset(df),
        "columns": column_kinds(df),
        "missing": missing_counts(df),
        "duplicates": duplicate_count(df),
        "samples": sample_values(df),
    }


def image_profile(df: DataFrame, width: str = "width", height: str = "height", size_kb: str = "size_kb") -> DataFrame:
    """Number of images and their average size, from a metadata table."""
    return df.agg(
        F.count("*").alias("num_images"),
        F.avg(quoted(width)).alias("avg_width"),
        F.avg(quoted(height)).alias("avg_height"),
        F.avg(quoted(size_kb)).alias("avg_file_size_kb"),
    )
