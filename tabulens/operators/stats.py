"""Descriptive statistics, comparisons, correlations and trends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.nulls import number, quoted
from tabulens.operators.ordered import previous_value
from tabulens.operators.profile import smallest_per_group, top_values, unpivot_text
from tabulens.operators.quantiles import collect_quantiles, exact_quantiles
from tabulens.operators.schema import columns_above_ratio, numeric_columns, per_column

#: Columns of a crosstab for which no values are named.
MOST_COLUMNS = 1000

# Rows that the values are measured from, the sums of a pair of columns, and the share of them that rounding may leave.
_SHIFT_ROWS = 1000
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_ROUNDING = 1e-13


def _label(p: float) -> str:
    return f"q{round(p * 100):02d}"


def summarize(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Rows ``(by..., column, count, mean, std, min, max, qXX...)``; text columns are parsed as numbers."""
    by = list(by)
    entries = []
    for c in cols:
        x = number(df, c)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    found = per_column(df, entries, by)
    if probs:
        q = exact_quantiles(df, cols, probs, by)
        f, q = found.alias("f"), (q if by else F.broadcast(q)).alias("q")
        same = F.col("f.column") == F.col("q.column")
        for b in by:
            same = same & F.col(f"f.`{b}`").eqNullSafe(F.col(f"q.`{b}`"))
        found = f.join(q, same, "left").select("f.*", "q.quantiles")
    qs = [F.get("quantiles", F.lit(i)).alias(_label(p)) for i, p in enumerate(probs)]
    return found.select(*by, "column", "count", "mean", "std", "min", "max", *qs)


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, std, min, max, count and range per column."""
    return summarize(df, cols, probs=(0.5,)).select(
        "column", "mean", F.col("q50").alias("median"), "std", "min", "max", "count",
        (F.col("max") - F.col("min")).alias("range"),
    )


# ---- correlation ---------------------------------------------------------------------------------


def _pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for i <= j over the rows where both columns have a value, in one scan.

    A task keeps four matrices of products, added up by batch. Values are taken from one that occurs, so a constant column
    is zero throughout and large offsets do not cancel.
    """
    first = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(cols)]).limit(_SHIFT_ROWS)
    shift = [v or 0.0 for v in first.agg(*[F.percentile_approx(f"x{i}", 0.5, 100) for i in range(len(cols))]).first()]
    size = len(cols)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            here = ~np.isnan(x)
            x, here = np.where(here, x, 0.0), here.astype(float)
            with np.errstate(invalid="ignore"):
                n += here.T @ here
                sx += x.T @ here
                sxx += (x * x).T @ here
                sxy += x.T @ x
        for i in range(size):
            j = np.arange(i, size)
            parts = [np.full(len(j), i, np.int32), j.astype(np.int32), n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["i", "j", *_SUMS])

    rows = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(cols)])
    found = rows.mapInArrow(products, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    return found.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def correlation(df: DataFrame, cols: Sequence[str], full: bool = False) -> DataFrame:
    """Pearson r of every pair ``(a, b, r)``, missing values skipped pairwise; ``full`` adds mirror and diagonal.

    Any number of columns in one scan. Constant columns have no r, nor have columns with an infinite value.
    """
    cols = list(cols)
    if len(cols) < (1 if full else 2):
        return df.sparkSession.createDataFrame([], "a string, b string, i int, j int, r double")
    sums, n = _pair_sums(df, cols), F.col("n")
    xx, yy, xy = (F.col(f"s{p}{q}") - F.col(f"s{p}") * F.col(f"s{q}") / n for p, q in (("x", "x"), ("y", "y"), ("x", "y")))
    # What is left of equal values after rounding is no spread.
    spread = (xx > F.col("sxx") * _ROUNDING) & (yy > F.col("syy") * _ROUNDING)
    r = F.greatest(F.least(xy / F.sqrt(xx) / F.sqrt(yy), F.lit(1.0)), F.lit(-1.0))
    r = F.when((n > 1) & spread, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.nullif(r, F.lit(float("nan")))))
    found = sums.select("i", "j", r.alias("r"))
    last = len(cols) - 1
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))
    every = every.select("i", F.explode(F.sequence(F.col("i"), F.lit(last))).alias("j")).where(F.lit(full) | (F.col("i") < F.col("j")))
    out = every.join(found, ["i", "j"], "left")
    if full:
        sides = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        out = out.select(F.explode(F.array_distinct(sides)).alias("p"), "r").select("p.*", "r")
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", "r")


def strongest_pairs(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The k pairs with the largest |r|: Strong above 0.7, Moderate above 0.3, else Weak."""
    size = F.abs("r")
    strength = F.when(size > 0.7, "Strong").when(size > 0.3, "Moderate").otherwise("Weak")
    top = correlation(df, cols).where("r IS NOT NULL").orderBy(F.desc(size), "i", "j").limit(k)
    return top.select("a", "b", "r", strength.alias("strength"))


def notable_pairs(df: DataFrame, cols: Sequence[str], above: float = 0.5, first: int = 3) -> DataFrame:
    """Pairs with |r| over a threshold, the first few in column order."""
    strength = F.when(F.abs("r") > 0.7, "strong").otherwise("moderate")
    direction = F.when(F.col("r") > 0, "positive").otherwise("negative")
    found = correlation(df, cols).where(F.abs("r") > above).orderBy("i", "j").limit(first)
    return found.select("a", "b", "r", strength.alias("strength"), direction.alias("direction"))


def related_columns(
    df: DataFrame, cols: Sequence[str] | None = None, above: float = 0.3, k: int = 3, numeric_share: float = 0.3,
    first: int | None = None,
) -> DataFrame:
    """Among the columns (the ``first`` ones if no columns are named), those numeric enough; their k strongest pairs."""
    candidates = list(cols or df.columns[:first])
    usable = columns_above_ratio(df.select(*[quoted(c) for c in candidates]), numeric_share)
    found = correlation(df, usable).where(F.abs("r") > above)
    return found.orderBy(F.desc(F.abs("r")), "i", "j").limit(k).select("a", "b", "r")


def most_correlated(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The one pair with the largest |r|."""
    found = correlation(df, cols or numeric_columns(df)).where("r IS NOT NULL")
    best = F.max_by(F.struct("a", "b", "r"), F.struct(F.abs("r").alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))
    return found.agg(best.alias("p")).where("p IS NOT NULL").select("p.*")


# ---- groups --------------------------------------------------------------------------------------


def compare_groups(df: DataFrame, cat: str, num: str, predicate: Column | str | None = None) -> DataFrame:
    """mean, count and std of a number per category; rows without a category are left out."""
    rows = df if predicate is None else df.where(predicate)
    x = number(rows, num)
    return (
        rows.where(quoted(cat).isNotNull())
        .groupBy(quoted(cat).alias("category"))
        .agg(F.avg(x).alias("mean"), F.count(x).alias("count"), F.stddev_samp(x).alias("std"))
    )


def group_extremes(df: DataFrame, cat: str, num: str, predicate: Column | str | None = None) -> DataFrame:
    """Highest and lowest group mean; variation is significant when the means' std exceeds 10 % of their mean."""
    groups = compare_groups(df, cat, num, predicate).where("mean IS NOT NULL")
    return groups.agg(
        F.min_by("category", F.struct((-F.col("mean")).alias("m"), "category")).alias("highest"),
        F.max("mean").alias("highest_mean"),
        F.min_by("category", F.struct("mean", "category")).alias("lowest"),
        F.min("mean").alias("lowest_mean"),
        F.coalesce(F.stddev_samp("mean") > F.avg("mean") * 0.1, F.lit(False)).alias("significant_variation"),
    )


def value_shares(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column with their percentage of all rows."""
    total = df.count()
    return top_values(df, cols, k).withColumn("percent", F.col("count") * 100.0 / F.lit(max(total, 1)))


def samples_per_group(
    df: DataFrame, cat: str, text: str, order_by: Sequence[str], n: int = 2, top: int = 5
) -> DataFrame:
    """n texts from each of the most frequent categories."""
    counts = df.where(quoted(cat).isNotNull()).groupBy(quoted(cat).alias("category")).agg(F.count("*").alias("count"))
    largest = [r["category"] for r in counts.orderBy(F.desc("count"), "category").limit(top).collect()]
    rows = df.where(quoted(cat).isin(largest)) if largest else df.where(F.lit(False))
    picked = smallest_per_group(
        rows.select(quoted(cat).alias("category"), quoted(text).alias("sample"), *[quoted(o) for o in order_by]),
        ["category"], list(order_by), n,
    )
    return picked.select("category", "rank", *order_by, "sample")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of values, long form; pairs with a missing side are left out."""
    rows = df.where(quoted(a).isNotNull() & quoted(b).isNotNull())
    return rows.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count("*").alias("count"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence[object] | None = None) -> DataFrame:
    """The same as a matrix with a column for each of ``values``, by default for every value of ``b``.

    A matrix is only as wide as a table can be: a column with more than ``MOST_COLUMNS`` values is an error unless its values
    are named; ``crosstab`` takes any.
    """
    counts = crosstab(df, a, b)
    names = list(values) if values is not None else [r["b"] for r in counts.select("b").distinct().orderBy("b").limit(MOST_COLUMNS + 1).collect()]
    if values is None and len(names) > MOST_COLUMNS:
        raise ValueError(f"{b!r} has more than {MOST_COLUMNS} values: name some, or take crosstab")
    return counts.groupBy("a").pivot("b", names).agg(F.sum("count")).na.fill(0)


def rank_categories(df: DataFrame, col: str, most: int = 3, least: int = 2) -> DataFrame:
    """The most and the least common values."""
    counts = df.where(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("value")).agg(
        F.count("*").alias("count")
    )
    top = counts.orderBy(F.desc("count"), "value").limit(most).withColumn("side", F.lit("most"))
    bottom = counts.orderBy("count", F.desc("value")).limit(least).withColumn("side", F.lit("least"))
    return top.unionByName(bottom).select("side", "value", "count")


def top_records(df: DataFrame, col: str, show: Sequence[str], key: Sequence[str], n: int = 3) -> DataFrame:
    """The n rows with the largest value; ties by key."""
    order = [F.desc_nulls_last(number(df, col)), *[quoted(k) for k in key]]
    return df.orderBy(*order).limit(n).select(*[quoted(c) for c in dict.fromkeys([*key, *show, col])])


def value_extremes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """highest, lowest and average per column."""
    return summarize(df, cols, probs=()).select(
        "column", F.col("max").alias("highest"), F.col("min").alias("lowest"), F.col("mean").alias("average")
    )


def totals_by(df: DataFrame, cat: str, num: str) -> DataFrame:
    """sum, average and share of the grand total per category."""
    x = number(df, num)
    rows = df.where(quoted(cat).isNotNull())
    grand = rows.agg(F.sum(x)).first()[0]
    groups = rows.groupBy(quoted(cat).alias("category")).agg(F.sum(x).alias("total"), F.avg(x).alias("average"))
    return groups.withColumn("share", F.try_divide(F.col("total"), F.lit(grand).cast("double")))


def top_entities(df: DataFrame, entity: str, num: str, n: int = 10) -> DataFrame:
    """The n entities with the largest total."""
    totals = df.where(quoted(entity).isNotNull()).groupBy(quoted(entity).alias("entity")).agg(
        F.sum(number(df, num)).alias("total")
    )
    return totals.orderBy(F.desc_nulls_last("total"), "entity").limit(n)


# ---- one column ----------------------------------------------------------------------------------


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Centre, spread, adjusted skewness with its class, and outliers beyond 1.5 interquartile ranges."""
    x = number(df, col)
    quartiles = collect_quantiles(df, [col], [0.25, 0.5, 0.75])[col] or [None] * 3
    q1, median, q3 = quartiles
    if q1 is None:
        outside = F.lit(False)
    else:
        outside = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    n = F.count(x)
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    skew = F.when(n < 3, F.lit(None)).when(F.stddev_samp(x) == 0, F.lit(0.0)).otherwise(adjusted)
    found = df.agg(
        F.avg(x).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(x).alias("std"),
        skew.alias("skewness"),
        F.count_if(outside).alias("num_outliers"),
        F.count("*").alias("n_rows"),
    )
    size = F.abs("skewness")
    shape = F.when(size > 1, "high").when(size > 0.5, "moderate").otherwise("normal")
    side = F.when(size > 0.5, F.when(F.col("skewness") > 0, "right").otherwise("left")).otherwise("none")
    return found.select(
        F.lit(col).alias("column"), "mean", "median", "std", "skewness", shape.alias("shape"),
        side.alias("direction"), "num_outliers",
        F.coalesce(F.try_divide(F.col("num_outliers") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("outlier_percent"),
    )


def describe_any(df: DataFrame, cols: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Statistics of numeric columns and top values of the others, as rows ``(column, metric, label, value)``."""
    from tabulens.operators.profile import describe_numeric, distinct_counts, long_metrics

    nums = [c for c in cols if c in numeric]
    cats = [c for c in cols if c not in numeric]
    out = None
    if nums:
        metrics = ["mean", "std", "min", "max", "q25", "q50", "q75"]
        out = long_metrics("numeric", describe_numeric(df, nums), "column", metrics).select(
            "column", "metric", F.lit("").alias("label"), "value"
        )
    if cats:
        unique = distinct_counts(df, cats).select(
            "column", F.lit("unique").alias("metric"), F.lit("").alias("label"),
            F.col("num_unique").cast("double").alias("value"),
        )
        top = top_values(df, cats, 3).select(
            "column", F.lit("top").alias("metric"), F.col("value").alias("label"), F.col("count").cast("double").alias("value")
        )
        out = unique.unionByName(top) if out is None else out.unionByName(unique).unionByName(top)
    return out


def column_analysis(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> DataFrame:
    """Range, mean and present values where more than half parse as numbers; else distinct count and top value."""
    numeric = columns_above_ratio(df.select(*[quoted(c) for c in cols]), share)
    others = [c for c in cols if c not in numeric]
    none = F.lit(None)
    out = None
    if numeric:
        out = summarize(df, numeric, probs=()).select(
            "column", F.lit("numeric").alias("kind"), "min", "max", "mean", "count",
            none.cast("bigint").alias("num_unique"), none.cast("string").alias("top_value"),
        )
    if others:
        counts = unpivot_text(df, others).groupBy("column", "value").agg(F.count("*").alias("n"))
        text = counts.groupBy("column").agg(
            F.sum("n").alias("count"), F.count("*").alias("num_unique"),
            F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("top_value"),
        )
        text = text.select(
            "column", F.lit("categorical").alias("kind"), none.cast("double").alias("min"),
            none.cast("double").alias("max"), none.cast("double").alias("mean"), "count", "num_unique", "top_value",
        )
        out = text if out is None else out.unionByName(text)
    return out


# ---- order and time ------------------------------------------------------------------------------


def _place(order_by: Sequence[str]) -> Column:
    return F.struct(*[quoted(c) for c in order_by])


def growth(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First and last value of each column in the given order, and the change; no row where it cannot be computed."""
    by = list(by)
    entries = []
    for c in cols:
        x = number(df, c)
        place = F.when(x.isNotNull(), _place(order_by))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min_by(x, place).alias("start_value"),
                F.max_by(x, place).alias("end_value"),
                F.count(x).alias("points"),
            )
        )
    found = per_column(df, entries, by).where("points >= 2 AND start_value <> 0")
    change = F.col("end_value") - F.col("start_value")
    return found.select(
        *by, "column", (change / F.col("start_value") * 100).alias("growth_percent"), "start_value", "end_value",
        change.alias("absolute_change"),
    )


def trend_endpoints(df: DataFrame, date: str, nums: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Value at the first and last date of each column, with the date range."""
    entries = []
    for c in nums:
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(quoted(date)).alias("first_date"),
                F.max(quoted(date)).alias("last_date"),
                F.min_by(number(df, c), _place([date, *key])).alias("start_value"),
                F.max_by(number(df, c), _place([date, *key])).alias("end_value"),
            )
        )
    return per_column(df.where(quoted(date).isNotNull()), entries)


def period_totals(df: DataFrame, date: str, num: str, grain: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """A number summed per period: the small series the functions below work on."""
    period = F.date_trunc(grain, quoted(date)).cast("timestamp_ntz").alias("period")
    return df.groupBy(*by, period).agg(F.sum(number(df, num)).alias("value"))


def pct_change(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds the percent change from the row before."""
    out = previous_value(df, value, order_by, by, "previous")
    change = F.try_divide(quoted(value) - F.col("previous"), F.col("previous")) * 100
    return out.withColumn("pct_change", change).drop("previous")


def cagr(df: DataFrame, value: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Compound annual growth rate between the first and last date, years of 365.25 days."""
    x = number(df, value)
    place = F.when(x.isNotNull(), quoted(date))
    found = df.groupBy(*by).agg(
        F.min_by(x, place).alias("start_value"),
        F.max_by(x, place).alias("end_value"),
        (F.date_diff(F.max(place), F.min(place)) / 365.25).alias("years"),
    )
    ok = (F.col("years") > 0) & (F.col("start_value") > 0) & (F.col("end_value") >= 0)
    rate = F.pow(F.try_divide("end_value", "start_value"), F.try_divide(F.lit(1.0), F.col("years"))) - 1
    return found.withColumn("cagr", F.when(ok, rate))


def volatility(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Variance of the values and standard deviation of their percent changes."""
    return pct_change(df, value, order_by, by).groupBy(*by).agg(
        F.var_samp(quoted(value)).alias("variance"), F.stddev_samp("pct_change").alias("volatility")
    )


def trend(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope per day and its R squared."""
    day = F.unix_date(quoted(date).cast("date")).cast("double")
    y = number(df, value)
    return df.groupBy(*by).agg(
        F.regr_slope(y, day).alias("slope_per_day"), F.regr_r2(y, day).alias("r2"), F.count(y).alias("points")
    )


def backup_analysis(
    df: DataFrame, order_by: Sequence[str], share: float = 0.7, key_first: int | None = None, first: int | None = None
) -> DataFrame:
    """Average, range, spread, points and overall change of the (``first``) columns that are mostly numbers."""
    cols = columns_above_ratio(df, share, key_first)[:first]
    stats = summarize(df, cols, probs=()).alias("s")
    change = growth(df, cols, order_by).select("column", "growth_percent").alias("g")
    return stats.join(F.broadcast(change), F.col("s.column") == F.col("g.column"), "left").select(
        "s.column", F.col("mean").alias("average"), "min", "max", "std", F.col("count").alias("points"),
        F.col("growth_percent").alias("overall_change"),
    )


# ---- overview ------------------------------------------------------------------------------------


def eda(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, missing values, description and the five strongest correlations."""
    from tabulens.operators.profile import describe_numeric, missing_counts, profile_dataset

    nums = numeric_columns(df)
    return {
        "shape": profile_dataset(df),
        "missing": missing_counts(df),
        "describe": describe_numeric(df, nums),
        "correlations": strongest_pairs(df, nums, 5),
    }


def chart_picks(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_values: int = 20, first: int | None = None) -> DataFrame:
    """What to look at: the (``first``) numbers, the (``first``) categories with few values, the strongest pair."""
    from tabulens.operators.profile import distinct_counts

    numeric, categorical = list(numeric), list(categorical)
    spark = df.sparkSession
    rows = [("distribution", c, None) for c in numeric[:first]]
    if categorical:
        few = {
            r["column"]
            for r in distinct_counts(df, categorical[:first]).where(F.col("num_unique") < max_values).collect()
        }
        rows += [("counts", c, None) for c in categorical[:first] if c in few]
    if len(numeric) > 1:
        rows += [("relationship", r["a"], r["b"]) for r in most_correlated(df, numeric).collect()]
    return spark.createDataFrame(rows, "pick string, column string, other string")
