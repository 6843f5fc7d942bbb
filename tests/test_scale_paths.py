"""Exact quantiles and ordered columns beside plain ones, with hot groups and narrow bounds."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulens.operators import quantiles
from tabulens.operators.ordered import chunked, forward_fill, previous_value
from tabulens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _quantiles(df, cols, by):
    rows = exact_quantiles(df, cols, PROBS, by).collect()
    return {tuple(r[b] for b in by) + (r["column"],): r["quantiles"] for r in rows}


@pytest.mark.parametrize("few, sent", [(quantiles.FEW, quantiles.SENT_GROUPS), (30, 0), (1, 0)])
def test_quantiles_equal_pandas(spark, monkeypatch, few, sent):
    """As they are, and with brackets that have to be narrowed again and joined by a shuffle."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "SENT_GROUPS", sent)
    monkeypatch.setattr(quantiles, "PARTS", 10 if few > 1 else 3)
    rng = np.random.default_rng(3)
    n = 4000
    frame = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 5, n).astype(str)),
            "smooth": rng.normal(0, 1e6, n),
            "heavy": np.exp(rng.normal(0, 40, n)) * np.where(rng.random(n) < 0.3, -1, 1),
            "ties": rng.integers(-2, 3, n).astype(float),
            "close": 1.0 + rng.integers(0, 50, n) * 2.0**-52,
        }
    )
    frame.loc[rng.random(n) < 0.1, "smooth"] = None
    frame.loc[rng.random(n) < 0.05, "g"] = None
    df = spark.createDataFrame(frame).repartition(5)
    cols = ["smooth", "heavy", "ties", "close"]
    got = _quantiles(df, cols, [])
    for c in cols:
        np.testing.assert_allclose(got[(c,)], frame[c].quantile(PROBS), rtol=1e-12)
    grouped = _quantiles(df, cols, ["g"])
    assert len(grouped) == 7 * len(cols)
    for g, part in frame.groupby("g", dropna=False):
        for c in cols:
            np.testing.assert_allclose(grouped[(None if g != g else g, c)], part[c].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("few", [quantiles.FEW, 5])
def test_quantiles_of_wrong_brackets(spark, monkeypatch, few):
    """Brackets that miss their ranks are found out by the count."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "MARGIN", -0.01)
    df = spark.range(2000).selectExpr("double(pmod(id * 7919, 2003)) AS x", "id % 3 AS g")
    want = df.toPandas()
    np.testing.assert_allclose(_quantiles(df, ["x"], [])[("x",)], want["x"].quantile(PROBS))
    got = _quantiles(df, ["x"], ["g"])
    for g, part in want.groupby("g"):
        np.testing.assert_allclose(got[(g, "x")], part["x"].quantile(PROBS))


def test_quantiles_of_nothing_and_one(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 1), (7.0, 2)], "x double, g int")
    assert _quantiles(df.where("g = 1"), ["x"], []) == {("x",): None}
    assert _quantiles(df, ["x"], ["g"]) == {(1, "x"): None, (2, "x"): [7.0] * len(PROBS)}
    assert _quantiles(df.where("false"), ["x"], []) == {("x",): None} and _quantiles(df.where("false"), ["x"], ["g"]) == {}
    one = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert _quantiles(one, ["x"], [])[("x",)] == [5.0] * len(PROBS)
    odd = spark.createDataFrame([(float("inf"), "a"), (1.0, "a"), (-0.0, "a")], "`a.x` double, `my group` string")
    assert [r.quantiles for r in exact_quantiles(odd, ["a.x"], [0.0, 0.5], ["my group"]).collect()] == [[0.0, 1.0]]


def test_one_task_sees_few_values(spark, monkeypatch):
    """No aggregate collects raw values, and the values fetched are a small part."""
    monkeypatch.setattr(quantiles, "FEW", 100)
    df = spark.range(0, 200_000, 1, 8).selectExpr("sin(id) AS x")
    found = exact_quantiles(df, ["x"], [0.25, 0.5])
    assert "collect_list(x" not in found._jdf.queryExecution().toString()
    np.testing.assert_allclose(found.first().quantiles, np.quantile(np.sin(np.arange(200_000)), [0.25, 0.5]), rtol=1e-12)


def _series(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        user = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)
        t = rnd.choice([7, rnd.randint(0, 500)])
        rows.append((user, t, i, None if rnd.random() < 0.6 else rnd.randint(0, 99)))
    return rows


def _windowed(df, value, order_by, by, how):
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    if how == "fill":
        return df.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("prev", F.lag(value).over(w))


@pytest.mark.parametrize("by", [["u"], []])
@pytest.mark.parametrize("keys", [["t", "k"], ["name", "k"], ["gap", "k"]])
def test_fill_and_previous_equal_window(spark, keys, by):
    """Number, text and partly missing order keys, split over many chunks."""
    df = spark.createDataFrame(_series(5), "u int, t int, k int, v int").repartition(4)
    df = df.withColumn("name", F.concat(F.lit("n"), "t")).withColumn("gap", F.when(F.pmod("t", F.lit(3)) > 0, F.col("t")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chunked(df, keys, by).select("_chunk").distinct().count() > 4
        got = forward_fill(df, "v", keys, by), previous_value(df, "v", keys, by, "prev")
        for df_got, how in zip(got, ("fill", "lag")):
            assert sorted(map(repr, df_got.collect())) == sorted(map(repr, _windowed(df, "v", keys, by, how).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ordered_columns_read_what_is_asked_for(spark, tmp_path):
    """No copy of other columns: neither the scan nor the shuffle holds them, and what is carried is a row for each range at most."""
    rows = spark.range(2000).selectExpr("id % 2 AS g", "id AS t", "IF(id % 7 = 0, id, NULL) AS v", "repeat('x', 200) AS unrelated", "map('a', id) AS m")
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    plan = forward_fill(df.select("g", "t", "v"), "v", ["t"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "unrelated" not in plan and "BroadcastHashJoin" in plan
    cut = chunked(df, ["t"], ["g"])
    assert cut.where("NOT _spans").count() == 0
    from tabulens.operators.ordered import _carried

    assert 0 < _carried(cut, "v", ["t"], ["g"], True).count() <= 8
    many = spark.range(2000).selectExpr("id AS g", "1 AS t", "id AS v")
    assert chunked(many, ["t"], ["g"]).where("_spans").count() <= 8
    assert forward_fill(df.where("false"), "v", ["t"], ["g"]).count() == 0


def test_ties_without_a_second_key_are_split(spark):
    df = spark.range(4000).selectExpr("0 AS g", "'same' AS t", "IF(id % 5 = 0, id, NULL) AS v", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in chunked(df, ["t"], ["g"]).groupBy("_chunk").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 2000
        assert forward_fill(df, "v", ["t"], ["g"]).where("v IS NULL").count() < 200
        assert previous_value(df, "id", ["t"], ["g"], "prev").where("prev IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_profile_with_narrow_brackets(spark, data, monkeypatch):
    from tabulens.operators.profile import profile_columns

    orders = spark.read.parquet(f"{data}/orders.parquet")
    small = {r["column"]: r for r in profile_columns(orders).collect()}
    monkeypatch.setattr(quantiles, "FEW", 5)
    large = {r["column"]: r for r in profile_columns(orders).collect()}
    for c, r in small.items():
        for k, v in r.asDict().items():
            w = large[c][k]
            assert v == w or abs(v - w) < 1e-9 * abs(v), (c, k)


def test_one_key_with_a_third_of_the_rows(spark):
    """Hot key, hot value, hot text: same results as in pandas."""
    from tabulens.operators.stats import pct_change, summarize
    from tabulens.operators.textstats import diversify

    rows = spark.range(0, 6000, 1, 6).selectExpr(
        "IF(id % 3 = 0, 0, id % 97) AS k", "id", "IF(id % 3 = 0, 5.0D, double(id % 1013)) AS v"
    )
    held = rows.toPandas()
    for by in ([], ["k"]):
        for r in summarize(rows, ["v"], by).collect():
            v = held.v if not by else held.v[held.k == r.k]
            got, want = (r["count"], r["mean"], r["std"], r["q25"], r["q50"], r["q75"]), (len(v), v.mean(), v.std(), *v.quantile([0.25, 0.5, 0.75]))
            assert got == pytest.approx(want)
    one = {r["id"]: r["pct_change"] for r in pct_change(rows, "v", ["id"], ["k"]).collect()}
    w = Window.partitionBy("k").orderBy("id")
    two = rows.withColumn("p", F.lag("v").over(w)).selectExpr("id", "try_divide(v - p, p) * 100 AS c").collect()
    assert one == {r["id"]: r["c"] for r in two}
    texts = rows.selectExpr("id", "IF(id % 3 = 0, ' Top  one ', concat('mean of ', k)) AS q")
    got = [r["question"] for r in diversify(texts, "q", ["id"], 3).collect()]
    assert got == ["Top  one", "mean of 1", "mean of 2"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tabulens.session import scratch_dir

    def fake(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch_dir(fake(master))
    assert scratch_dir(fake("local[2]"))


def test_python_functions_need_no_package_on_workers(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from tabulens.session import build_session
from tabulens.sources.chunking import chunk_text
from tabulens.sources.readers import decode_text
spark = build_session("elsewhere", "local[1]", **{{"spark.ui.enabled": "false"}})
df = spark.sql("SELECT 1 AS id, repeat('word ', 500) AS t")
print("CHUNKS", chunk_text(df, "t", ["id"]).count(), decode_text(spark.sql("SELECT X'E9' AS raw"), "raw").first()["content"])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "CHUNKS 3 é" in out.stdout or "CHUNKS 4 é" in out.stdout, out.stdout + out.stderr[-2000:]


def test_many_rows_of_few_values_are_not_narrowed(spark, monkeypatch):
    """A rank between two frequent values: the bracket holds both, and no look at its inside tells more."""
    calls, narrowed = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "_narrowed", lambda *args: calls.append(1) or narrowed(*args))
    df = spark.range(4000).selectExpr("CAST(id % 4 AS DOUBLE) AS few", "id % 2 AS g", "IF(id < 1990, 0.0, IF(id >= 2010, 9.0, id / 1000)) AS near")
    assert quantiles.collect_quantiles(df, ["few"], [0.25, 0.5]) == {"few": [0.75, 1.5]} and not calls
    by = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["few"], [0.5], ["g"]).collect()}
    assert by == {0: [1.0], 1: [2.0]} and not calls
    # Many values between two frequent ones: one look less as soon as a look leaves as many.
    monkeypatch.setattr(quantiles, "FEW", 5)
    assert quantiles.collect_quantiles(df, ["near"], [0.5])["near"] == pytest.approx([1.9995]) and len(calls) < quantiles.ROUNDS
    for by in ([], ["g"]):
        wide = spark.range(4000).selectExpr("id % 2 AS g", "CAST(id % 2 * 10000 + id AS DOUBLE) AS x")
        got = {r["g"] if by else 0: r["quantiles"][0] for r in quantiles.exact_quantiles(wide, ["x"], [0.5], by).collect()}
        assert got == ({0: 1999.0, 1: 12000.0} if by else {0: 6999.5})
