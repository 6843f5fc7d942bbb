"""Daily forecasts.

``forecast`` fits a straight line plus weekday effect per group, in one aggregation. ``forecast_breaks`` lets the trend bend and
adds a year's season. It sums the products of all features by group and tenth of the time covered; that is all the fit sees.
Which candidate breaks are kept, and whether there is a year's season, is decided by the Bayesian information criterion, each
model being solved from the same sums. The spread comes from rolling origins: fits to the first tenths are held against the
next one, again by sums. A group is as many rows as it has days before the sums and ten rows after.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabulens.functions.nulls import number, quoted

# Half-width of an 80 % interval in standard deviations.
_Z80 = 1.2816

#: Candidate breaks lie at these shares of the time covered; at most so many are taken.
BREAKS = tuple(k / 8 for k in range(1, 8))
MAX_BREAKS = 3
#: Waves of the year, for series of two years at least.
WAVES = 3
YEAR = 365.25
SEGMENTS = 10
#: Tenths before the first rolling origin.
FIRST_ORIGIN = 5

# Over the columns d (day number), dow (1 to 7), lo and hi (first and last day), as doubles.
_SHARE = "((d - lo) / greatest(hi - lo, 1.0))"
FEATURES_SQL = (
    "1.0", _SHARE, *[f"greatest({_SHARE} - {b}, 0.0)" for b in BREAKS], *[f"CAST(dow = {w} AS DOUBLE)" for w in range(2, 8)],
    *[f"{wave}({2 * math.pi * k / YEAR!r} * d)" for k in range(1, WAVES + 1) for wave in ("sin", "cos")],
)
SEGMENT_SQL = f"CAST(least(floor({_SHARE} * {SEGMENTS}), {SEGMENTS - 1}) AS INT)"
PLACES = tuple((i, j) for i in range(len(FEATURES_SQL) + 1) for j in range(i, len(FEATURES_SQL) + 1))
_BREAK_AT = range(2, 2 + len(BREAKS))
_YEAR_AT = range(len(FEATURES_SQL) - 2 * WAVES, len(FEATURES_SQL))
_BASE = [i for i in range(len(FEATURES_SQL)) if i not in _BREAK_AT and i not in _YEAR_AT]


def daily_series(df: DataFrame, date: str, value: str, by: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """One value per day and group: ``(by..., ds, y)``."""
    x = number(df, value)
    y = F.sum(x) if how == "sum" else F.avg(x)
    return (
        df.where(quoted(date).isNotNull())
        .groupBy(*by, quoted(date).cast("date").alias("ds"))
        .agg(y.alias("y"))
        .where("y IS NOT NULL")
    )


def fit(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: slope, intercept, weekday offsets, residual spread, first and last day.

    Means and centred sums per weekday hold all that is needed, so the series is read once and at most
    seven rows per group go on.
    """
    by = list(by)
    x, y = F.unix_date("ds").cast("double"), F.col("y")
    week = series.groupBy(*by, F.dayofweek("ds").alias("dow")).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.var_pop(x) * F.count("*")).alias("cxx"), (F.var_pop(y) * F.count("*")).alias("cyy"),
        (F.covar_pop(x, y) * F.count("*")).alias("cxy"), F.min("ds").alias("first"), F.max("ds").alias("last"),
    )
    group = Window.partitionBy(*by)
    total = F.sum("n").over(group)
    week = week.withColumn("all_x", F.sum(F.col("n") * F.col("mx")).over(group) / total).withColumn(
        "all_y", F.sum(F.col("n") * F.col("my")).over(group) / total
    )
    dx, dy = F.col("mx") - F.col("all_x"), F.col("my") - F.col("all_y")
    week = week.withColumn(
        "slope",
        F.coalesce(
            F.try_divide(
                F.sum(F.col("cxy") + F.col("n") * dx * dy).over(group),
                F.sum(F.col("cxx") + F.col("n") * dx * dx).over(group),
            ),
            F.lit(0.0),
        ),
    ).withColumn("intercept", F.col("all_y") - F.col("slope") * F.col("all_x"))
    offset = F.col("my") - F.col("intercept") - F.col("slope") * F.col("mx")
    left_over = F.col("cyy") - 2 * F.col("slope") * F.col("cxy") + F.col("slope") * F.col("slope") * F.col("cxx")
    return week.groupBy(*by, "slope", "intercept").agg(
        F.map_from_entries(F.collect_list(F.struct("dow", offset.alias("o")))).alias("offsets"),
        F.sqrt(F.try_divide(F.sum(F.greatest(left_over, F.lit(0.0))), F.sum("n") - 1)).alias("spread"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )


def forecast(
    df: DataFrame, date: str, value: str, periods: int = 90, by: Sequence[str] = (), how: str = "sum"
) -> DataFrame:
    """Fitted history and ``periods`` further days: ``(by..., ds, yhat, yhat_lower, yhat_upper, is_future)``."""
    for c in (date, value):
        if c not in df.columns:
            raise ValueError(f"column {c!r} does not exist")
    by = list(by)
    series = daily_series(df, date, value, by, how)
    model = fit(series, by)
    if by:
        s, m = series.alias("s"), model.alias("m")
        same = F.lit(True)
        for b in by:
            same = same & F.col(f"s.`{b}`").eqNullSafe(F.col(f"m.`{b}`"))
        days = s.join(m, same).select("m.*", "s.ds")
    else:
        days = _with_model(series.select("ds"), model)
    # The last day of a group also brings the days ahead, so the model is joined once.
    ahead = F.sequence(F.date_add("last", 1), F.date_add("last", periods)) if periods > 0 else F.array().cast("array<date>")
    covered = F.when(F.col("ds") == F.col("last"), F.concat(F.array("ds"), ahead)).otherwise(F.array("ds"))
    days = days.withColumn("ds", F.explode(covered))
    yhat = (
        F.col("intercept")
        + F.col("slope") * F.unix_date("ds")
        + F.coalesce(F.try_element_at("offsets", F.dayofweek("ds")), F.lit(0.0))
    )
    half = F.coalesce(F.col("spread"), F.lit(0.0)) * _Z80
    fitted = days.select(*by, "ds", yhat.alias("yhat"), half.alias("_half"), (F.col("ds") > F.col("last")).alias("is_future"))
    return fitted.select(
        *by, "ds", "yhat", (F.col("yhat") - F.col("_half")).alias("yhat_lower"),
        (F.col("yhat") + F.col("_half")).alias("yhat_upper"), "is_future",
    )


def _with_model(days: DataFrame, model: DataFrame) -> DataFrame:
    """The one model of an ungrouped series as literals."""
    row = model.first()
    if row is None:
        return days.join(model, F.lit(False))
    offsets = F.create_map(*[F.lit(x) for pair in row["offsets"].items() for x in pair])
    return days.select(
        "ds", offsets.alias("offsets"),
        *[F.lit(row[c]).cast(model.schema[c].dataType).alias(c) for c in ("slope", "intercept", "spread", "last")],
    )


def _features() -> list[Column]:
    return [F.expr(f"CAST({x.replace('1.0', '1.0D').replace('0.0)', '0.0D)')} AS DOUBLE)") for x in FEATURES_SQL]


def normal_sums(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., segment, lo, hi, n, sums)``: sums of the products ``PLACES`` of the features and y."""
    by = list(by)
    group = Window.partitionBy(*[quoted(b) for b in by])
    d = F.unix_date("ds").cast("double")
    rows = series.select(*[quoted(b) for b in by], d.alias("d"), F.dayofweek("ds").alias("dow"), F.col("y").cast("double").alias("y"), F.min(d).over(group).alias("lo"), F.max(d).over(group).alias("hi"))
    named = [*[x.alias(f"f{i}") for i, x in enumerate(_features())], F.col("y").alias(f"f{len(FEATURES_SQL)}")]
    rows = rows.select(*[quoted(b) for b in by], "lo", "hi", F.expr(SEGMENT_SQL).alias("segment"), *named)
    sums = F.array(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in PLACES])
    return rows.groupBy(*[quoted(b) for b in by], "segment", "lo", "hi").agg(F.count("*").alias("n"), sums.alias("sums"))


def _solved(gram: np.ndarray, use: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the features in use, and the squared error left; features without values get none."""
    coef = np.zeros(len(gram) - 1)
    coef[use] = np.linalg.lstsq(gram[np.ix_(use, use)], gram[use, -1], rcond=1e-11)[0]
    return coef, _left(gram, coef)


def _left(gram: np.ndarray, coef: np.ndarray) -> float:
    full = np.append(coef, -1.0)
    return max(float(full @ gram @ full), 0.0)


def _chosen(gram: np.ndarray, n: int, days: float) -> list[int]:
    """Features by the information criterion: the year first, then breaks one at a time."""

    def criterion(use: list[int]) -> float:
        left = max(_solved(gram, use)[1] / n, 1e-12 * max(gram[-1, -1] / n, 1e-300))
        return n * math.log(left) + len(use) * math.log(n)

    use = list(_BASE)
    if days >= 2 * YEAR and criterion(use + list(_YEAR_AT)) < criterion(use):
        use += _YEAR_AT
    for _ in range(MAX_BREAKS):
        best = min((b for b in _BREAK_AT if b not in use), key=lambda b: criterion(use + [b]))
        if n <= len(use) + 1 or criterion(use + [best]) >= criterion(use):
            break
        use.append(best)
    return use


def fit_from_sums(segments: Sequence[dict], days: float) -> dict:
    """Coefficients, spread and breaks (shares of the time covered) from the sums of one group."""
    size = len(FEATURES_SQL) + 1
    grams, counts = np.zeros((SEGMENTS, size, size)), np.zeros(SEGMENTS, int)
    for s in segments:
        for (i, j), v in zip(PLACES, s["sums"]):
            grams[s["segment"], i, j] = grams[s["segment"], j, i] = v
        counts[s["segment"]] = s["n"]
    n = int(counts.sum())
    use = _chosen(grams.sum(0), n, days)
    coef, left = _solved(grams.sum(0), use)
    spread = math.sqrt(left / max(1, n - len(use)))
    rolled = [(_left(grams[k], _solved(grams[:k].sum(0), use)[0]), counts[k]) for k in range(FIRST_ORIGIN, SEGMENTS) if counts[:k].sum() > 2 * len(use) and counts[k]]
    if rolled:
        # A break within the last tenths has no values before it yet; the fit to all days is the least that is left.
        spread = max(spread, math.sqrt(np.median([e / c for e, c in rolled])))
    return {"coef": coef.tolist(), "spread": spread, "breaks": sorted(BREAKS[b - 2] for b in use if b in _BREAK_AT), "year": _YEAR_AT[0] in use}


def _fitted(segments: pa.Array, days: pa.Array) -> pa.Array:
    kind = pa.struct([("coef", pa.list_(pa.float64())), ("spread", pa.float64()), ("breaks", pa.list_(pa.float64())), ("year", pa.bool_())])
    return pa.array([fit_from_sums(s, d) for s, d in zip(segments.to_pylist(), days.to_pylist())], kind)


def fit_breaks(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: lo, hi, coef, spread, breaks, year."""
    keys = [quoted(b) for b in by]
    sums = normal_sums(series, by).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("segment", "n", "sums"))).alias("s"))
    fitted = arrow_udf(_fitted, "coef array<double>, spread double, breaks array<double>, year boolean")
    return sums.select(*keys, "lo", "hi", fitted("s", F.col("hi") - F.col("lo") + 1).alias("m")).select(*keys, "lo", "hi", "m.*")


def forecast_breaks(df: DataFrame, date: str, value: str, periods: int = 90, by: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """Fitted history and ``periods`` further days, trend with breaks, week and year: ``(by..., ds, yhat, yhat_lower, yhat_upper, is_future)``."""
    for c in (date, value):
        if c not in df.columns:
            raise ValueError(f"column {c!r} does not exist")
    by = list(by)
    series = daily_series(df, date, value, by, how)
    model = fit_breaks(series, by).withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
    if by:
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & quoted(b).eqNullSafe(F.col(f"_by{i}"))
        days = series.join(model, same)
    else:
        row: Row | None = model.first()
        if row is None:
            return series.select("ds", *[F.lit(None).cast("double").alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")], F.lit(False).alias("is_future"))
        days = series.select("ds", F.lit(row["lo"]).alias("lo"), F.lit(row["hi"]).alias("hi"), F.array(*map(F.lit, row["coef"])).alias("coef"), F.lit(row["spread"]).alias("spread"))
    last = F.date_from_unix_date(F.col("hi").cast("int"))
    ahead = F.sequence(F.date_add(last, 1), F.date_add(last, periods)) if periods > 0 else F.array().cast("array<date>")
    covered = F.when(F.col("ds") == last, F.concat(F.array("ds"), ahead)).otherwise(F.array("ds"))
    days = days.withColumn("ds", F.explode(covered)).withColumns({"d": F.unix_date("ds").cast("double"), "dow": F.dayofweek("ds")})
    parts = [x * F.get("coef", F.lit(i)) for i, x in enumerate(_features())]
    days = days.withColumn("yhat", sum(parts[1:], parts[0])).withColumn("half", F.col("spread") * _Z80)
    return days.select(
        *[quoted(b) for b in by], "ds", "yhat", (F.col("yhat") - F.col("half")).alias("yhat_lower"), (F.col("yhat") + F.col("half")).alias("yhat_upper"),
        (F.col("d") > F.col("hi")).alias("is_future"),
    )


def forecast_end(forecasted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The last day of a forecast and its value."""
    return forecasted.groupBy(*by).agg(F.max("ds").alias("ends"), F.max_by("yhat", "ds").alias("final_value"))
