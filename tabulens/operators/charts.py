"""The numbers behind a chart. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions import rules
from tabulens.functions import text as tx
from tabulens.functions.nulls import number, quoted
from tabulens.operators.schema import numeric_columns
from tabulens.operators.stats import compare_groups, correlation, summarize


def bar_mean(df: DataFrame, cat: str, num: str, k: int | None = None) -> DataFrame:
    """Mean per category; with k the largest k."""
    groups = compare_groups(df, cat, num).select("category", "mean")
    return groups if k is None else groups.orderBy(F.desc_nulls_last("mean"), "category").limit(k)


def bar_count(df: DataFrame, cat: str, k: int = 10) -> DataFrame:
    """The k most frequent categories."""
    counts = df.where(quoted(cat).isNotNull()).groupBy(quoted(cat).alias("category")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "category").limit(k)


def pie(df: DataFrame, cat: str, k: int = 10) -> DataFrame:
    """The k most frequent categories and their part of what is shown."""
    shown = Window.partitionBy()
    return bar_count(df, cat, k).withColumn("share", F.col("count") / F.sum("count").over(shown))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins ``(bin, low, high, count)`` from minimum to maximum, empty ones included."""
    x = number(df, col)
    low, high = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        place, width, bins = F.lit(1), 0.0, 1
    else:
        width = (high - low) / bins
        # width_bucket puts the maximum into one bin too many.
        place = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = df.where(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def scatter(
    df: DataFrame, x: str, y: str, color: str | None = None, max_points: int | None = None, seed: int = 0
) -> DataFrame:
    """Points with both coordinates; ``max_points`` asks for a random sample of about that many."""
    a, b = number(df, x), number(df, y)
    points = df.where(a.isNotNull() & b.isNotNull()).select(
        a.alias("x"), b.alias("y"), *([quoted(color).alias("color")] if color else [])
    )
    if max_points is None:
        return points
    n = points.count()
    return points if n <= max_points else points.sample(False, max_points / n, seed)


def box(df: DataFrame, num: str, cat: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum, per category where one is given."""
    rows = df if cat is None else df.where(quoted(cat).isNotNull()).withColumn("category", quoted(cat))
    by = [] if cat is None else ["category"]
    return summarize(rows, [num], by).select(
        *by, "min", F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3"), "max"
    )


def heatmap(df: DataFrame, cols: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """Correlation of every ordered pair of the columns, by default of the (``first``) numeric ones."""
    return correlation(df, list(cols or numeric_columns(df)[:first]), full=True).select("a", "b", "r")


def dashboard(
    df: DataFrame, num: str, cat: str, other: str, categories: int | None = None
) -> dict[str, DataFrame]:
    """Distribution, comparison (of the first ``categories``, by default all), relationship and summary of a table."""
    means = compare_groups(df, cat, num).select("category", "mean").orderBy("category")
    return {
        "distribution": histogram(df, num),
        "comparison": means if categories is None else means.limit(categories),
        "relationship": scatter(df, num, other),
        "summary": summarize(df, [num], probs=(0.5,)).select(
            "mean", F.col("q50").alias("median"), "std"
        ),
    }


def time_line(df: DataFrame, date: str, num: str, grain: str = "month", how: str = "avg") -> DataFrame:
    """A number over time, averaged or summed per period."""
    x = number(df, num)
    value = F.sum(x) if how == "sum" else F.avg(x)
    rows = df.where(quoted(date).isNotNull())
    period = F.date_trunc(grain, quoted(date)).cast("timestamp_ntz").alias("period")
    return rows.groupBy(period).agg(value.alias("value"), F.count(x).alias("points")).orderBy("period")


def row_line(df: DataFrame, order_by: Sequence[str], num: str) -> DataFrame:
    """A number in row order, where the table has no time column."""
    return df.select(*[quoted(c) for c in order_by], number(df, num).alias("value")).orderBy(*order_by)


def suggest_chart(df: DataFrame, question: str, n_numeric: int, n_categorical: int) -> DataFrame:
    """Adds ``chart``: what suits the question on a table with that many columns of each kind; ``none`` where text does."""
    both = n_categorical > 0 and n_numeric > 0
    arms = [(tx.any_of("_q", rules.LINE_WORDS), "line_chart")]
    if n_categorical or n_numeric:
        arms.append(("contains(_q, 'distribution')", "bar_chart" if n_categorical else "histogram"))
    if both:
        arms.append((tx.any_of("_q", rules.RANKING_WORDS), "bar_chart"))
    if n_numeric >= 2:
        arms.append((tx.any_of("_q", rules.RELATION_WORDS), "scatter_plot"))
    by_shape = "bar_chart" if both else "histogram" if n_numeric else "summary_table"
    kind = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in arms) + f" ELSE '{by_shape}' END"
    needed = f"""CASE WHEN {tx.any_of("_q", rules.NO_CHART_WORDS)} THEN false
        WHEN _intent = 'statistical' THEN true
        WHEN _intent = 'analytical' THEN {tx.any_of("_q", rules.PATTERN_WORDS)}
        ELSE {tx.any_of("_q", ("distribution", "spread"))} END"""
    scored = tx.with_scores(df.withColumn("_q", F.lower(quoted(question))), "_q", rules.INTENTS_SCORED)
    return (
        scored.withColumn("_intent", tx.best_label(rules.INTENTS_SCORED))
        .withColumn("chart", F.expr(f"IF({needed}, {kind}, 'none')"))
        .drop("_q", "_scores", "_best", "_intent")
    )
