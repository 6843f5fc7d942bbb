"""The forecast with breaks: known breaks, season and week; least squares over the days; odd series."""

import datetime as dt
import math

import numpy as np
import pytest

from tabulens.operators import forecast as fc

START = dt.date(2020, 1, 1)


def frame(spark, series):
    rows = [(g, START + dt.timedelta(days=i), float(y)) for g, ys in series.items() for i, y in enumerate(ys) if y is not None]
    return spark.createDataFrame(rows, "`my group` string, day date, y double")


def broken(n, at, before, after, noise=1.0, seed=0):
    t, turn = np.arange(n), np.random.default_rng(seed)
    return 100 + before * t + (after - before) * np.maximum(t - at, 0) + turn.normal(0, noise, n)


def test_known_breaks_are_found(spark):
    n = 641
    t = np.arange(n)
    series = {
        "one": broken(n, n // 2, 0.5, -0.3), "none": broken(n, 0, 0.2, 0.2), "late": broken(n, 480, 0.0, 1.0),
        "week": 50 + np.where(t % 7 == 3, 20, 0) + np.random.default_rng(1).normal(0, 1, n),
    }
    df = frame(spark, series)
    model = {r["my group"]: r for r in fc.fit_breaks(fc.daily_series(df, "day", "y", ["my group"]), ["my group"]).collect()}
    assert model["one"].breaks == [0.5] and model["none"].breaks == [] and model["late"].breaks == [0.75] and model["week"].breaks == []
    assert not any(r.year for r in model.values()) and all(r.spread < 1.6 for r in model.values())
    ahead = fc.forecast_breaks(df, "day", "y", 30, ["my group"]).where("is_future").collect()
    assert len(ahead) == 30 * len(series)
    for r in ahead:
        i = (r.ds - START).days
        want = {"one": 100 + 0.5 * 320 - 0.3 * (i - 320), "none": 100 + 0.2 * i, "late": 100 + 1.0 * (i - 480), "week": 50 + (20 if i % 7 == 3 else 0)}[r["my group"]]
        assert abs(r.yhat - want) < 3 and r.yhat_lower < r.yhat < r.yhat_upper
    # A straight line misses the bend by far.
    line = [r for r in fc.forecast(df, "day", "y", 30, ["my group"]).where("is_future AND `my group` = 'one'").collect()]
    assert min(abs(r.yhat - (100 + 0.5 * 320 - 0.3 * ((r.ds - START).days - 320))) for r in line) > 20


def test_season_of_a_year(spark):
    n = 1500
    t = np.arange(n)
    y = 200 + 30 * np.sin(2 * math.pi * (t + 40) / 365.25) + np.random.default_rng(2).normal(0, 2, n)
    df = frame(spark, {"a": y})
    row = fc.fit_breaks(fc.daily_series(df, "day", "y")).first()
    assert row.year and row.spread < 3
    got = {(r.ds - START).days: r.yhat for r in fc.forecast_breaks(df, "day", "y", 200).where("is_future").collect()}
    assert sorted(got) == list(range(n, n + 200))
    assert max(abs(v - 200 - 30 * math.sin(2 * math.pi * (i + 40) / 365.25)) for i, v in got.items()) < 8
    short = fc.fit_breaks(fc.daily_series(df.where("day < '2021-01-01'"), "day", "y")).first()
    assert not short.year


def test_sums_give_least_squares(spark):
    """The coefficients are those of a fit to the days themselves."""
    n = 400
    y = broken(n, 200, 0.4, -0.2, 3.0, 5)
    y[17] = np.nan
    df = frame(spark, {"a": [None if v != v else v for v in y]})
    row = fc.fit_breaks(fc.daily_series(df, "day", "y")).first()
    keep = [i for i in range(n) if i != 17]
    share = np.array(keep) / (n - 1)
    dow = np.array([(START + dt.timedelta(days=i)).isoweekday() % 7 + 1 for i in keep])
    x = np.column_stack([np.ones(len(keep)), share, *[np.maximum(share - b, 0) for b in row.breaks], *[(dow == w).astype(float) for w in range(2, 8)]])
    coef = np.linalg.lstsq(x, y[keep], rcond=None)[0]
    got = {(r.ds - START).days: r.yhat for r in fc.forecast_breaks(df, "day", "y", 0).collect()}
    np.testing.assert_allclose([got[i] for i in keep], x @ coef, rtol=1e-6)


def test_interval_holds_what_comes(spark):
    """About four of five later days lie inside."""
    n, later = 500, 60
    hits = []
    for seed in range(4):
        y = broken(n + later, 250, 0.1, 0.2, 5.0, seed)
        rows = fc.forecast_breaks(frame(spark, {"a": y[:n]}), "day", "y", later).where("is_future").collect()
        hits += [r.yhat_lower <= y[(r.ds - START).days] <= r.yhat_upper for r in rows]
    assert 0.7 < np.mean(hits) <= 1


def test_odd_series(spark):
    df = frame(spark, {"one day": [5.0], "two": [1.0, 2.0], "flat": [3.0] * 50, "none": [None]})
    rows = fc.forecast_breaks(df, "day", "y", 5, ["my group"]).collect()
    assert {r["my group"] for r in rows} == {"one day", "two", "flat"} and all(math.isfinite(r.yhat) and math.isfinite(r.yhat_upper) for r in rows)
    assert all(abs(r.yhat - 3) < 1e-6 for r in rows if r["my group"] == "flat")
    assert fc.forecast_breaks(df.where("false"), "day", "y", 5).count() == 0
    assert fc.forecast_breaks(df.where("false"), "day", "y", 5, ["my group"]).count() == 0
    with pytest.raises(ValueError, match="no_day"):
        fc.forecast_breaks(df, "no_day", "y")
