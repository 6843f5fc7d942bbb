"""Cleaning against pandas, on frames with NaN, NULL, ties and odd strings."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.functions import text as tx
from tabulens.functions import values as vx
from tabulens.operators import clean
from tabulens.operators.profile import quality_score
from tabulens.plans.cleaning import CleaningPlan, apply_plan

NAN = float("nan")


def values(df, col):
    return [r[col] for r in df.collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, 1.0, "b", "x"), (2, NAN, "a", None), (3, None, "a", "y"), (4, 4.0, "b", "y"), (5, 100.0, None, None)]
    return spark.createDataFrame(rows, "id int, x double, t string, u string").repartition(3)


def by_id(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_fill_median_and_mean_count_nan_as_missing(gaps):
    assert by_id(clean.impute(gaps, ["x"], "median"), "x") == {1: 1.0, 2: 4.0, 3: 4.0, 4: 4.0, 5: 100.0}
    assert by_id(clean.impute(gaps, ["x"], "mean"), "x")[2] == 35.0


def test_fill_mode_takes_smallest_on_ties_and_unknown_without_values(spark, gaps):
    assert by_id(clean.impute(gaps, ["t"], "mode"), "t")[5] == "a"
    empty = spark.createDataFrame([(1, None)], "id int, t string")
    assert by_id(clean.impute(empty, ["t"], "mode"), "t")[1] == "Unknown"


def test_whole_number_column_filled_with_a_fraction_becomes_double(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, n int")
    out = clean.impute(df, ["n"], "median")
    assert out.schema["n"].dataType.simpleString() == "double"
    assert by_id(out, "n") == {1: 1.0, 2: 2.0, 3: 1.5}


def test_clip_keeps_missing_and_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(10, 2, 300), [500.0, -400.0]])
    frame = pd.DataFrame({"id": range(len(x)), "x": x})
    frame.loc[5, "x"] = None
    df = spark.createDataFrame(frame)
    q1, q3 = frame.x.quantile(0.25), frame.x.quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    for method, bounds in (
        ("iqr", (low, high)),
        ("zscore", (frame.x.mean() - 3 * frame.x.std(), frame.x.mean() + 3 * frame.x.std())),
    ):
        got = by_id(clean.outliers(df, ["x"], method, "clip"), "x")
        assert got[5] is None
        want = frame.x.clip(*bounds)
        np.testing.assert_allclose([got[i] for i in range(len(x)) if i != 5], want.drop(5), rtol=1e-12)


def test_sequential_drop_uses_the_rows_left(spark):
    frame = pd.DataFrame({"a": [1.0] * 20 + [2.0] * 20 + [90.0], "b": list(range(40)) + [10_000.0]}).astype(float)
    want = frame
    for c in ("a", "b"):
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want = want[~((want[c] < q1 - 1.5 * (q3 - q1)) | (want[c] > q3 + 1.5 * (q3 - q1)))]
    got = clean.outliers(spark.createDataFrame(frame), ["a", "b"], "iqr", "drop").toPandas()
    assert sorted(got.b) == sorted(want.b)


def test_constant_column_has_no_zscore_outliers(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert clean.outliers(df, ["x"], "zscore", "drop").count() == 2


def test_text_steps_on_accents_and_tabs(spark):
    df = spark.createDataFrame([("\t  Été, 12 HÔTELS!\n",), (None,)], "t string")
    out = values(clean.clean_text(df, ["t"], ["remove_numbers", "strip", "lowercase", "remove_punct"]), "t")
    assert out == ["été  hôtels", None]
    assert values(clean.clean_text(df, ["t"], ["lowercase"], null_as="None"), "t")[1] == "none"


def test_title_case_is_pythons(spark):
    texts = ["o'neil ab-cd 3rd", "HELLO wOrLd", "élan vital", "", "  two  spaces"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(tx.title_case(F.col("t")).alias("t")), "t") == [t.title() for t in texts]


def test_strip_is_pythons(spark):
    texts = ["\xa0 a  ", "\x1fb\t\n", "", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(tx.strip(F.col("t")).alias("t")), "t") == [t.strip() for t in texts]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("12d",), ("1,234",), (" 7 ",), ("1e3",), ("x",), ("2.5",), (None,)], "t string")
    assert values(df.select(vx.to_double(F.col("t")).alias("t")), "t") == [None, None, 7.0, 1000.0, None, 2.5, None]
    assert values(df.select(vx.to_long(F.col("t")).alias("t")), "t") == [None, None, 7, 1000, None, None, None]
    money = spark.createDataFrame([("12,345 USD",), ("1.2 million",), ("n/a",)], "t string")
    assert values(clean.parse_number(money, "t"), "t") == [12345.0, 1.2, None]
    assert values(clean.parse_number(money, "t", scale_words=True), "t") == [12345.0, 1_200_000.0, None]


def test_dates_of_every_format(spark):
    day = dt.datetime(2024, 3, 4)
    texts = ["2024-03-04", "04/03/2024", "13/12/2024", "12/13/2024", "2024/03/04", "04-03-2024", "20240304",
             "04.03.2024", "2024-03-04 05:06:07", "4/3/2024 05:06:07", "soon", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = by_id(clean.parse_dates(df, "t", detect="each"), "t")
    assert [got[i] for i in (0, 1, 4, 5, 6, 7)] == [day] * 6
    assert got[2] == dt.datetime(2024, 12, 13) and got[3] == dt.datetime(2024, 12, 13)
    assert got[8] == got[9] == dt.datetime(2024, 3, 4, 5, 6, 7)
    assert got[10] is None and got[11] is None
    first = by_id(clean.parse_dates(df.where("id < 2"), "t", detect="first"), "t")
    assert first == {0: None, 1: day}


def test_whole_numbers_stay_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big, str(big), "12345678901234567890"), (2, big + 2, " -7 ", "1"), (3, 5, "1.5", "007")], "id int, n long, t string, d string")
    out = clean.convert(df, {"n": "int", "t": "int"}).orderBy("id").collect()
    assert [r["n"] for r in out] == [big, big + 2, 5] and [r["t"] for r in out] == [big, -7, None]
    assert [int(r["d"]) for r in clean.numeric_text_to_number(df, ["d"]).orderBy("id").collect()] == [12345678901234567890, 1, 7]
    long = df.select("id", F.lit("1" * 40).alias("d"))
    assert clean.numeric_text_to_number(long, ["d"]).schema["d"].dataType.simpleString() == "string"
    clipped = clean.clip_to(df.select("id", "n"), {"n": (10.5, 1e18)})
    assert clipped.schema["n"].dataType.simpleString() == "bigint"
    assert [r["n"] for r in clipped.orderBy("id").collect()] == [big, big + 2, 11]


def test_one_date_format_for_a_column(spark):
    days = spark.createDataFrame([("04/05/2020",), ("04/25/2020",), ("2020-01-02",), (None,)], "t string")
    got = sorted(str(r["t"])[:10] for r in clean.parse_dates(days, "t").collect())
    assert got == ["2020-01-02", "2020-04-05", "2020-04-25", "None"]
    each = sorted(str(r["t"])[:10] for r in clean.parse_dates(days, "t", detect="each").collect())
    assert "2020-05-04" in each


def test_category_codes_by_window_and_by_sort(spark):
    rows = [(i, v) for i, v in enumerate(["b", "a", None, "c", "b", "é"] * 20)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(5)
    small = by_id(clean.category_codes(df, "t"), "t_code")
    assert [small[i] for i in range(6)] == [1, 0, -1, 2, 1, 3]


def test_dedupe_compares_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS i UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT map('a', 1), 1")
    assert clean.dedupe(df).count() == 2


def test_standardize_by_name(spark):
    df = spark.createDataFrame([(" jo-anne o'neil ", "ab-1", "x/y", "{}")], "full_name string, zip_code string, z string, metadata string")
    row = clean.standardize_strings(df).first()
    assert tuple(row) == ("JoAnne ONeil", "AB1", "xy", "{}")


PLANS = [
    ({}, {"strategy": "leave", "outlier_strategy": "leave"}),
    ({"missing_values": {"strategy": "wild"}}, {"strategy": "leave"}),
    ({"outliers": {"strategy": "DROP", "method": "ZSCORE", "zscore_threshold": 2}},
     {"outlier_strategy": "drop", "outlier_method": "zscore", "zscore_threshold": 2.0}),
    ({"convert_types": {"date_columns": ["a", "no"], "manual": {"b": "int", "no": "int", "a": "blob"}}},
     {"date_columns": ("a",), "manual_types": {"b": "int"}}),
    ({"text_cleaning": {"columns": ["a", "no"], "steps": ["strip", "shout"]}}, {"text_columns": ("a",), "text_steps": ("strip",)}),
    ({"missing_values": 3, "outliers": None, "text_cleaning": {"columns": "a"}}, {"text_columns": ()}),
]


@pytest.mark.parametrize("plan,want", PLANS)
def test_plan_validation(plan, want):
    got = CleaningPlan.from_dict(plan, ["a", "b"])
    assert {k: getattr(got, k) for k in want} == want


@pytest.mark.parametrize(
    "missing,compat,numeric,text",
    [
        ({"strategy": "mean"}, True, "median", "unknown"),
        ({"strategy": "mean"}, False, "mean", "unknown"),
        ({"strategy": "mean", "numeric_strategy": "leave"}, True, "mean", "unknown"),
        ({"strategy": "mean", "numeric_strategy": "leave"}, False, "leave", "unknown"),
        ({"strategy": "median", "numeric_strategy": "mean"}, True, "median", "unknown"),
        ({"strategy": "drop"}, True, "median", "unknown"),
        ({"strategy": "mode"}, True, "median", "mode"),
        ({"strategy": "constant", "categorical_strategy": "leave"}, True, "median", "constant"),
        ({"strategy": "leave", "numeric_strategy": "mean"}, True, "leave", "leave"),
    ],
)
def test_fill_rules(missing, compat, numeric, text):
    plan = CleaningPlan.from_dict({"missing_values": missing}, [], compat)
    assert (plan.numeric_fill(), plan.categorical_fill()) == (numeric, text)


def test_drop_removes_rows_only_in_the_sane_mode(gaps):
    plan = {"missing_values": {"strategy": "drop"}}
    sane, _ = apply_plan(gaps, CleaningPlan.from_dict(plan, gaps.columns))
    compat, _ = apply_plan(gaps, CleaningPlan.from_dict(plan, gaps.columns, compat=True))
    assert sane.count() == 2 and compat.count() == 5


def test_plan_report_and_dedupe(spark):
    df = spark.createDataFrame([(1, 2.0)] * 3 + [(2, None), (3, 4.0)], "id int, x double")
    plan = CleaningPlan.from_dict({"remove_duplicates": True, "missing_values": {"strategy": "median"}}, df.columns)
    out, report = apply_plan(df, plan)
    assert sorted(map(tuple, out.collect())) == [(1, 2.0), (2, 3.0), (3, 4.0)]
    rows = {(r["step"], r["action"]): r["affected"] for r in report.collect()}
    assert rows[("duplicates", "removed")] == 2 and rows[("missing", "filled_median")] == 1


def test_score_of_empty_table(spark):
    assert quality_score(spark.createDataFrame([], "a int")).first()["quality_score"] == 0.0


few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
floats = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=30)


@few
@given(floats)
def test_clip_is_bounded_and_dedupe_idempotent(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bounds = clean.outlier_bounds(df, ["x"])
    for v in values(clean.clip_to(df, bounds), "x"):
        assert v is None or bounds["x"][0] <= v <= bounds["x"][1]
    once = clean.dedupe(df)
    assert once.count() == clean.dedupe(once).count() == len(set(xs))


@few
@given(floats)
def test_fill_leaves_no_gap_and_score_in_range(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    filled = values(clean.impute(df, ["x"], "median"), "x")
    assert all(v is not None for v in filled) or all(x is None for x in xs)
    assert 0 <= quality_score(df).first()["quality_score"] <= 100
