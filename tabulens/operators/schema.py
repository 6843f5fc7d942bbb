"""What kind of column is it, and which columns matter for a question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import rules
from tabulens.functions.nulls import PARSABLE, is_numeric, no_nan, number, quoted
from tabulens.functions.text import any_of, first_of

KINDS = ("numeric", "categorical", "temporal", "other")
_TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)


def kind_of(field: T.StructField) -> str:
    if is_numeric(field.dataType):
        return "numeric"
    if isinstance(field.dataType, _TEMPORAL):
        return "temporal"
    if isinstance(field.dataType, T.BooleanType):
        return "other"
    if any(h in field.name.lower() for h in rules.TIME_NAME_HINTS):
        return "temporal"
    return "categorical"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if kind_of(f) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_key_indicator(name: str) -> bool:
    return any(h in name.lower() for h in rules.KEY_INDICATOR_HINTS)


def possible_analyses(df: DataFrame) -> list[str]:
    found: list[str] = []
    if columns_of(df, "temporal"):
        found += rules.TIME_ANALYSES
    if len(columns_of(df, "numeric")) >= 2:
        found += rules.NUMERIC_ANALYSES
    if columns_of(df, "categorical"):
        found += rules.CATEGORICAL_ANALYSES
    return found


def per_column(df: DataFrame, entries: Sequence[Column], by: Sequence[str] = (), batch: int = 40) -> DataFrame:
    """One aggregate struct per column, all in one scan, then one row per struct."""
    keys, out = [quoted(b) for b in by], None
    for i in range(0, len(entries), batch):
        part = (
            df.groupBy(*keys)
            .agg(F.array(*entries[i : i + batch]).alias("_all"))
            .select(*keys, F.explode("_all").alias("_one"))
            .select(*keys, "_one.*")
        )
        out = part if out is None else out.unionByName(part)
    return out


def present(df: DataFrame, name: str) -> Column:
    """The column where it holds a value; NaN counts as missing."""
    return no_nan(name, df.schema[name].dataType)


def column_kinds(df: DataFrame) -> DataFrame:
    """Per column: position, type, kind, key-indicator flag and number of present values."""
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(i).alias("position"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(kind_of(f)).alias("kind"),
            F.lit(is_key_indicator(f.name)).alias("key_indicator"),
            F.count(present(df, f.name)).alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ]
    return per_column(df, entries)


def dtype_counts(df: DataFrame) -> DataFrame:
    """Per type: number of columns and of present values in them."""
    return column_kinds(df).groupBy("dtype").agg(
        F.count("*").alias("n_columns"), F.sum("non_null").alias("non_null")
    )


def numeric_ratio(
    df: DataFrame, cols: Sequence[str] | None = None, numeric_above: float = 0.8, mixed_above: float = 0.3
) -> DataFrame:
    """Share of rows that parse as a number, and the kind that follows."""
    cols = list(cols or df.columns)
    entries = [
        F.struct(F.lit(c).alias("column"), F.avg(number(df, c).isNotNull().cast("double")).alias("ratio"))
        for c in cols
    ]
    kind = (
        F.when(F.col("ratio") > numeric_above, "numeric")
        .when(F.col("ratio") > mixed_above, "mixed")
        .otherwise("categorical")
    )
    return per_column(df, entries).withColumn("kind", kind)


def columns_above_ratio(df: DataFrame, share: float, first: int | None = None, skip: Sequence[str] = ()) -> list[str]:
    """Names, in table order, of columns with more than ``share`` parsable numbers. One small row per column."""
    cols = [c for c in df.columns if c.lower() not in {s.lower() for s in skip}]
    good = {r["column"] for r in numeric_ratio(df, cols).where(F.col("ratio") > share).collect()}
    return [c for c in cols if c in good][:first]


def mixed_samples(df: DataFrame, cols: Sequence[str], n: int = 2) -> DataFrame:
    """The n smallest distinct numbers and the n smallest other texts of each column."""
    from tabulens.operators.profile import smallest_per_group, unpivot_text

    parsed = F.when(F.col("value").rlike(PARSABLE), F.col("value").try_cast("double"))
    rows = unpivot_text(df, cols).withColumn("sample_kind", F.when(parsed.isNotNull(), "number").otherwise("text"))
    return smallest_per_group(rows.distinct(), ["column", "sample_kind"], ["value"], n).drop("rank")


def time_columns(
    df: DataFrame, names: Sequence[str] = rules.TIME_NAME_HINTS, first_year: int = 1900, last_year: int = 2030
) -> DataFrame:
    """Columns that are about time: by name, or because every number in them reads as a year."""
    entries = []
    for f in df.schema:
        x = number(df, f.name) if isinstance(f.dataType, (T.NumericType, T.StringType)) else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(any(h in f.name.lower() for h in names)).alias("by_name"),
                F.coalesce((F.min(x) >= first_year) & (F.max(x) <= last_year), F.lit(False)).alias("by_value"),
            )
        )
    return per_column(df, entries).where("by_name OR by_value")


def match_columns(
    df: DataFrame, question: str, numeric: Sequence[str], categorical: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Adds ``columns``: those the question names, else those its kind suggests; ``limit`` caps their number."""
    every = [*numeric, *categorical]

    def listed(cols: Sequence[str]) -> str:
        return "array(" + ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in cols) + ")"

    # Names in the question, and names a word of the question is part of.
    named = f"filter({listed(every)}, c -> contains(_q, lower(c)) OR exists(_words, w -> contains(lower(c), w)))"
    by_rule = {
        "compare": [categorical[0], numeric[0]] if categorical and numeric else [],
        "correlation": numeric[:3],
        "distribution": numeric[:2],
        "aggregate": numeric[:2],
    }
    arms = " ".join(
        f"WHEN {any_of('_q', hints)} THEN {listed(by_rule[label] or every[:3])}"
        for label, hints in rules.QUESTION_COLUMN_RULES
    )
    suggested = f"CASE {arms} ELSE {listed([*categorical[:1], *numeric[:2]] or every[:3])} END"
    return (
        df.withColumn("_q", F.lower(quoted(question)))
        .withColumn("_words", F.filter(F.split("_q", r"(?U)\s+"), lambda w: w != ""))
        .withColumn("_named", F.expr(named))
        .withColumn("columns", F.expr(f"slice(IF(size(_named) > 0, _named, {suggested}), 1, {len(every) if limit is None else limit})"))
        .drop("_q", "_words", "_named")
    )


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: size, column names joined by spaces, share of numeric columns."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_cols"),
            F.lit(" ".join(df.columns)).alias("names"),
            F.lit(len(numeric_columns(df)) / len(df.columns)).alias("numeric_share"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def domain_from_columns(tables: DataFrame) -> DataFrame:
    """What the column names of each table of a catalog say it is about, by three rule sets; first rule wins."""
    by_numbers = F.when(F.col("numeric_share") > 0.6, "Quantitative/Numeric dataset").otherwise("Mixed structured data")
    return (
        tables.withColumn("_low", F.lower("names"))
        .withColumn("_type", F.expr(first_of("_low", rules.TABLE_TYPES, "")))
        .select(
            "table_name", "n_rows", "n_cols",
            F.expr(first_of("_low", rules.TABLE_DOMAINS_SHORT, "General")).alias("domain"),
            F.expr(first_of("_low", rules.TABLE_DOMAINS_LONG, "Mixed/General")).alias("detailed_domain"),
            F.when(F.col("_type") != "", F.col("_type")).otherwise(by_numbers).alias("dataset_type"),
        )
    )
