"""Cleaning steps. Statistics are one small row per column and enter the plan as literals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import rules
from tabulens.functions import text as tx
from tabulens.functions import values as vx
from tabulens.functions.nulls import is_numeric, number, quoted
from tabulens.operators.ordered import forward_fill
from tabulens.operators.profile import _moments, comparable, quality_score, top_values
from tabulens.operators.quantiles import collect_quantiles
from tabulens.operators.schema import numeric_columns, per_column, present, text_columns
from tabulens.session import scratch_dir

UNKNOWN = "Unknown"


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection for all replaced columns; column order stays."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keyed = df.select("*", *[comparable(df, c).alias(f"_key_{i}") for i, c in enumerate(maps)])
    others = [c for c in df.columns if c not in maps]
    keys = [f"_key_{i}" for i in range(len(maps))]
    return keyed.dropDuplicates(others + keys).drop(*keys)


# ---- missing values ------------------------------------------------------------------------------


def fill_values(df: DataFrame, cols: Sequence[str], how: str) -> dict[str, object]:
    """What ``impute`` would put into each column."""
    cols = list(cols)
    if not cols:
        return {}
    if how == "median":
        return {c: (q[0] if q else None) for c, q in collect_quantiles(df, cols, [0.5]).items()}
    if how == "mean":
        return {c: m for c, (m, _) in _moments(df, cols).items()}
    if how == "mode":
        found = {r["column"]: r["value"] for r in top_values(df, cols, 1).collect()}
        return {c: found.get(c, UNKNOWN) for c in cols}
    if how == "unknown":
        return {c: UNKNOWN for c in cols}
    raise ValueError(f"unknown fill rule {how!r}")


def fill_with(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Missing values (NaN included) replaced; whole-number columns filled with a fraction become doubles."""
    new = {}
    for c, value in fills.items():
        data_type = df.schema[c].dataType
        column = present(df, c)
        if value is None:
            continue
        if is_numeric(data_type):
            if isinstance(value, float) and not value.is_integer() and not isinstance(data_type, T.FractionalType):
                data_type = T.DoubleType()
            new[c] = F.coalesce(column.cast(data_type), F.lit(value).cast(data_type))
        elif isinstance(data_type, T.StringType):
            new[c] = F.coalesce(column, F.lit(str(value)))
        elif value != UNKNOWN:
            new[c] = F.coalesce(column, F.lit(value).cast(data_type))
    return replace_columns(df, new)


def impute(
    df: DataFrame, cols: Sequence[str], how: str, constants: Mapping[str, object] | None = None,
) -> DataFrame:
    """Fill missing values by ``median, mean, mode, constant`` or ``unknown``."""
    if how == "constant":
        return fill_with(df, {c: (constants or {}).get(c, UNKNOWN) for c in cols})
    return fill_with(df, fill_values(df, cols, how))


# ---- outliers ------------------------------------------------------------------------------------


def outlier_bounds(
    df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 3.0
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column; a column without spread (z-score) or values has none."""
    if method == "iqr":
        out = {}
        for c, q in collect_quantiles(df, cols, [0.25, 0.75]).items():
            if q:
                step = 1.5 * (q[1] - q[0])
                out[c] = (q[0] - step, q[1] + step)
        return out
    if method == "zscore":
        return {c: (m - threshold * s, m + threshold * s) for c, (m, s) in _moments(df, cols).items() if s}
    raise ValueError(f"unknown outlier method {method!r}")


def _outside(df: DataFrame, c: str, bounds: tuple[float, float]) -> Column:
    x = number(df, c)
    return (x < bounds[0]) | (x > bounds[1])


def outlier_counts(
    df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 3.0
) -> DataFrame:
    """Bounds and number of values outside them, per column."""
    bounds = outlier_bounds(df, cols, method, threshold)
    entries = []
    for c in cols:
        low, high = bounds.get(c, (None, None))
        hit = _outside(df, c, bounds[c]) if c in bounds else F.lit(False)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(low).cast("double").alias("lower"),
                F.lit(high).cast("double").alias("upper"),
                F.count_if(hit).alias("num_outliers"),
            )
        )
    return per_column(df, entries)


def clip_to(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside the bounds become the bound; the others, and the column's type, stay as they are.

    Whole-number columns take the nearest whole number inside the bounds.
    """
    new = {}
    for c, (low, high) in bounds.items():
        x, data_type = number(df, c), df.schema[c].dataType
        own, low, high = quoted(c), float(low), float(high)
        if not is_numeric(data_type):
            own, data_type = x, T.DoubleType()
        whole = isinstance(data_type, T.IntegralType) or isinstance(data_type, T.DecimalType) and not data_type.scale
        ends = [F.lit(v).try_cast(data_type) for v in ((math.ceil(low), math.floor(high)) if whole and math.isfinite(low + high) else (low, high))]
        new[c] = F.when(x < low, F.coalesce(ends[0], own)).when(x > high, F.coalesce(ends[1], own)).when(x.isNotNull(), own)
    return replace_columns(df, new)


def keep_within(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    out = df
    for c, (low, high) in bounds.items():
        x = number(df, c)
        out = out.where(x.isNull() | x.between(float(low), float(high)))
    return out


def outliers(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    method: str = "iqr",
    action: str = "clip",
    threshold: float = 3.0,
    sequential: bool = True,
) -> DataFrame:
    """Clip outliers to the bounds or drop their rows; missing values stay.

    Dropping works through the columns in order, each column's bounds being those of the rows left so far;
    ``sequential=False`` takes all bounds from the full table in one pass.
    """
    cols = list(cols or numeric_columns(df))
    if action == "clip":
        return clip_to(df, outlier_bounds(df, cols, method, threshold))
    if action != "drop":
        raise ValueError(f"unknown outlier action {action!r}")
    if not sequential:
        return keep_within(df, outlier_bounds(df, cols, method, threshold))
    out = df
    for c in cols:
        out = keep_within(out, outlier_bounds(out, [c], method, threshold))
    return out


def clip_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = rules.RANGE_RULES) -> DataFrame:
    """Values forced into the range given for their column name; the type stays."""
    new = {}
    for c, (low, high) in ranges.items():
        if c in df.columns:
            t = df.schema[c].dataType
            x = present(df, c)
            new[c] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high).cast(t)), F.lit(low).cast(t)))
    return replace_columns(df, new)


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = rules.RANGE_RULES) -> DataFrame:
    entries = [
        F.struct(F.lit(c).alias("column"), F.count_if(_outside(df, c, r)).alias("num_clipped"))
        for c, r in ranges.items()
        if c in df.columns
    ]
    return per_column(df, entries)


# ---- text ----------------------------------------------------------------------------------------


def clean_text(
    df: DataFrame,
    cols: Sequence[str],
    steps: Sequence[str],
    stopwords: Sequence[str] = rules.STOPWORDS["en"],
    null_as: str | None = None,
) -> DataFrame:
    """The chosen steps, always in the order strip, lowercase, remove_punct, remove_numbers, remove_stopwords.

    A missing text stays missing unless ``null_as`` names the word to put there before the steps run.
    """
    unknown = set(steps) - set(tx.TEXT_STEPS)
    if unknown:
        raise ValueError(f"unknown text steps {sorted(unknown)}")
    new = {}
    for c in cols:
        t = quoted(c).cast("string")
        if null_as is not None:
            t = F.coalesce(t, F.lit(null_as))
        if "strip" in steps:
            t = tx.strip(t)
        if "lowercase" in steps:
            t = F.lower(t)
        if "remove_punct" in steps:
            t = tx.remove_punct(t)
        if "remove_numbers" in steps:
            t = tx.remove_numbers(t)
        if "remove_stopwords" in steps:
            t = tx.remove_stopwords(t, stopwords, 2)
        new[c] = t
    return replace_columns(df, new)


def standardize_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Strip; title case or upper case by column name; then only ASCII letters, digits and spaces stay."""
    new = {}
    for c in cols or text_columns(df):
        if c == "metadata":
            continue
        t = tx.strip(quoted(c))
        if any(h in c.lower() for h in rules.TITLE_CASE_HINTS):
            t = tx.title_case(t)
        elif any(h in c.lower() for h in rules.UPPER_CASE_HINTS):
            t = F.upper(t)
        new[c] = F.regexp_replace(t, r"(?U)[^a-zA-Z0-9\s]", "")
    return replace_columns(df, new)


def title_case_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: tx.title_case(tx.strip(quoted(c))) for c in cols})


# ---- types ---------------------------------------------------------------------------------------

_CONVERT = {
    "int": vx.to_long,
    "float": vx.to_double,
    "datetime": vx.to_timestamp_any,
    "string": lambda c: c.cast("string"),
    "category": lambda c: c.cast("string"),
}


def convert(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns to ``int, float, datetime, category`` or ``string``; values that do not fit become NULL."""
    new = {}
    for c, target in types.items():
        source = df.schema[c].dataType
        if target == "datetime" and isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            new[c] = quoted(c).cast("timestamp_ntz")
        elif target == "float" and is_numeric(source):
            new[c] = number(df, c)
        else:
            new[c] = _CONVERT[target](quoted(c))
        if target == "category":
            new[c] = new[c].alias(c, metadata={"ml_attr": {"type": "nominal", "name": c}})
    out = [new[c] if types.get(c) == "category" else new[c].alias(c) if c in new else quoted(c) for c in df.columns]
    return df.select(*out)


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Adds the 0-based position of each value among the sorted distinct values; -1 where it is missing."""
    out = out or f"{col}_code"
    values = df.select(quoted(col).alias("_value")).where("_value IS NOT NULL").distinct()
    codes = _numbered_in_order(values, out)
    joined = df.join(codes, quoted(col) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("bigint")))


def _numbered_in_order(values: DataFrame, out: str) -> DataFrame:
    """Positions after a distributed sort: row number inside the partition plus the sizes of those before it.

    The sorted rows are checkpointed, so that the partition sizes and the rows come from the same sort.
    """
    spark = values.sparkSession
    scratch_dir(spark)
    placed = values.orderBy("_value").withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("_id", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["p"]] = total
        total += r["n"]
    if not starts:
        return placed.select("_value", F.lit(0).cast("bigint").alias(out))
    offsets = F.create_map(*[F.lit(x).cast("bigint") for pair in starts.items() for x in pair])
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select("_value", (F.element_at(offsets, part) + inside).alias(out))


def numeric_text_to_number(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns that hold nothing but digits become whole numbers: bigint, or decimal(38) if a value needs it.

    A column with a number of more than 38 digits stays as it is.
    """
    cols = list(cols or text_columns(df))
    if not cols:
        return df
    wanted = []
    for i, c in enumerate(cols):
        bare = F.ltrim(quoted(c), F.lit("0"))
        wanted += [
            F.bool_and(quoted(c).rlike("^[0-9]+$")).alias(f"d{i}"), F.max(F.length(bare)).alias(f"n{i}"),
            F.bool_and(quoted(c).isNull() | quoted(c).try_cast("bigint").isNotNull()).alias(f"b{i}"),
        ]
    found = df.agg(*wanted).first()
    new = {}
    for i, c in enumerate(cols):
        if found[f"d{i}"] and found[f"n{i}"] <= 38:
            new[c] = quoted(c).cast("bigint" if found[f"b{i}"] else "decimal(38,0)")
    return replace_columns(df, new)


def parse_dates(
    df: DataFrame, col: str, formats: Sequence[str] = vx.DATE_FORMATS, detect: str = "column"
) -> DataFrame:
    """Text to timestamp.

    Formats whose texts look alike (day first, month first) are decided once for the ``column``: the one that most values
    fit, on ties the one listed first. ``each`` tries the formats in order on every value; ``first`` takes for the whole
    column the one that fits its smallest value.
    """
    if detect == "column":
        groups = vx.same_shape(formats)
        open_ = [f for g in groups if len(g) > 1 for f in g]
        if open_:
            fits = df.agg(*[F.count(vx.parse_date(quoted(col), [f])).alias(f"f{i}") for i, f in enumerate(open_)]).first()
            count = {f: fits[f"f{i}"] for i, f in enumerate(open_)}
            best = {max(g, key=lambda f: (count.get(f, 0), -g.index(f))) for g in groups}
            formats = [f for f in formats if f in best]
    if detect == "first":
        sample = df.agg(F.min(quoted(col).cast("string"))).first()[0]
        fits = [F.try_to_timestamp(F.lit(sample), F.lit(f)).isNotNull().alias(f"f{i}") for i, f in enumerate(formats)]
        row = df.sparkSession.range(1).select(*fits).first() if sample is not None else ()
        formats = [f for f, ok in zip(formats, row) if ok][:1] or formats
    return replace_columns(df, {col: vx.parse_date(quoted(col), formats)})


def parse_number(df: DataFrame, col: str, scale_words: bool = False) -> DataFrame:
    return replace_columns(df, {col: vx.parse_number(quoted(col), scale_words)})


def add_date_parts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``<col>_year`` for every timestamp column named like a date."""
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType)
    cols = cols or [f.name for f in df.schema if "date" in f.name.lower() and isinstance(f.dataType, temporal)]
    return df.select("*", *[F.year(quoted(c)).alias(f"{c}_year") for c in cols])


# ---- outcome -------------------------------------------------------------------------------------


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed, columns left, missing cells removed and the score afterwards; one row."""
    b = quality_score(before).collect()[0]
    return quality_score(after).select(
        (F.lit(b["n_rows"]) - F.col("n_rows")).alias("rows_removed"),
        F.lit(len(after.columns)).alias("columns_remaining"),
        (F.lit(b["missing"]) - F.col("missing")).alias("missing_values_removed"),
        F.col("quality_score"),
    )
