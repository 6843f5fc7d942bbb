"""Profiles, statistics, text, forecast, vectors and sources on small literal frames."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions import rules
from tabulens.operators import charts, forecast, profile, schema, stats, textstats, vectors
from tabulens.sources import readers
from tabulens.sources.chunking import chunk_text, split_recursive

NAN = float("nan")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 400
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "x": rng.normal(0, 1, n), "n": rng.integers(0, 9, n)})
    frame["y"] = frame.x * 2 + rng.normal(0, 0.1, n)
    frame["z"] = np.exp(frame.x)
    frame.loc[::17, "x"] = np.nan
    frame.loc[::23, "g"] = None
    return frame, spark.createDataFrame(frame).repartition(5)


def test_kinds(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5D AS price, 'x' AS name, 'x' AS month_name, timestamp_ntz'2024-01-01' AS t, true AS b, array(1) AS a"
    )
    kinds = {r["column"]: r["kind"] for r in schema.column_kinds(df).collect()}
    assert kinds == {"i": "numeric", "price": "numeric", "name": "categorical", "month_name": "temporal",
                     "t": "temporal", "b": "other", "a": "categorical"}
    assert [r["column"] for r in schema.column_kinds(df).where("key_indicator").collect()] == ["price"]


def test_columns_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None)], ["GDP.1", "Sleep Duration"])
    assert {r["column"]: r["num_missing"] for r in profile.missing_counts(df).collect()} == {"GDP.1": 0, "Sleep Duration": 1}
    assert stats.summary_stats(df, ["GDP.1"]).first()["median"] == 2.0
    assert profile.profile_columns(df).count() == 2


def test_missing_distinct_and_duplicates_treat_nan_as_null(spark):
    df = spark.createDataFrame([(1.0, None), (NAN, None), (None, None), (1.0, None)], "a double, b string")
    assert {r["column"]: r["num_unique"] for r in profile.distinct_counts(df).collect()} == {"a": 1, "b": 0}
    assert {r["column"]: r["num_missing"] for r in profile.missing_counts(df).collect()} == {"a": 2, "b": 4}
    assert profile.duplicate_count(df).first()["num_duplicates"] == 2


def test_profile_columns_matches_pandas(table):
    frame, df = table
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    for c in ("x", "y", "z"):
        s = frame[c]
        z = ((s - s.mean()) / s.std()).abs()
        want = [s.min(), s.max(), s.mean(), s.median(), s.std()]
        np.testing.assert_allclose([got[c][k] for k in ("min", "max", "mean", "median", "std")], want, rtol=1e-12)
        assert got[c]["num_outliers"] == int((z > 3).sum())
        assert got[c]["num_missing"] == int(s.isna().sum()) and got[c]["num_unique"] == s.nunique()
    assert got["g"]["mean"] is None and got["g"]["num_unique"] == 3


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert got["a"]["num_missing"] == 0 and got["a"]["mean"] is None and got["b"]["num_unique"] == 0
    assert charts.histogram(df, "a").count() == 0


def test_correlation_matches_pandas_with_gaps(table):
    frame, df = table
    want = frame[["x", "y", "z"]].corr()
    for r in stats.correlation(df, ["x", "y", "z"], full=True).collect():
        assert abs(r["r"] - want.loc[r["a"], r["b"]]) < 1e-12
    assert stats.most_correlated(df, ["x", "y", "z"]).first()["a"] == "x"


def test_groups_leave_out_missing_categories(table):
    frame, df = table
    want = frame.groupby("g").x.agg(["mean", "count", "std"])
    got = {r["category"]: r for r in stats.compare_groups(df, "g", "x").collect()}
    assert set(got) == set(want.index)
    for g, w in want.iterrows():
        np.testing.assert_allclose([got[g]["mean"], got[g]["count"], got[g]["std"]], w, rtol=1e-12)


def test_distribution_matches_pandas(table):
    frame, df = table
    got, s = stats.distribution(df, "z").first(), frame.z
    np.testing.assert_allclose([got["mean"], got["median"], got["std"], got["skewness"]], [s.mean(), s.median(), s.std(), s.skew()], rtol=1e-10)
    assert (got["shape"], got["direction"]) == ("high", "right")


def test_constant_distribution(spark):
    got = stats.distribution(spark.createDataFrame([(2.0,)] * 5, "x double"), "x").first()
    assert got["skewness"] == 0 and got["num_outliers"] == 0 and got["shape"] == "normal"


def test_growth_skips_gaps_and_zero_start(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 10.0, 1.0), (3, NAN, 2.0), (4, 15.0, 3.0), (5, None, 4.0)], "t int, x double, y double")
    got = stats.growth(df, ["x", "y"], ["t"]).collect()
    assert [(r["column"], r["growth_percent"], r["start_value"], r["end_value"]) for r in got] == [("x", 50.0, 10.0, 15.0)]


def test_histogram_counts_everything_once(table):
    frame, df = table
    got = charts.histogram(df, "x", 10).orderBy("bin").toPandas()
    want, _ = np.histogram(frame.x.dropna(), 10)
    assert list(got["count"]) == list(want)
    const = charts.histogram(df.withColumn("c", F.lit(1.0)), "c").collect()
    assert len(const) == 1 and const[0]["count"] == len(frame)


def test_scatter_sample_is_about_the_size_asked(table):
    _, df = table
    assert charts.scatter(df, "x", "y").count() == df.where("NOT isnan(x)").count()
    assert 40 < charts.scatter(df, "x", "y", max_points=100).count() < 170


def test_crosstab_wide_takes_values(table):
    _, df = table
    wide = stats.crosstab_wide(df.withColumnRenamed("g", "group"), "n", "group")
    assert len(wide.columns) == 4 and wide.count() == 9
    some = stats.crosstab_wide(df.withColumnRenamed("g", "group"), "n", "group", values=wide.columns[1:2])
    assert some.columns == ["n", wide.columns[1]] or len(some.columns) == 2


def test_crosstab_wide_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(stats, "MOST_COLUMNS", 3)
    df = spark.range(20).selectExpr("id % 2 AS a", "id % 4 AS b", "id % 3 AS c")
    assert len(stats.crosstab_wide(df, "a", "c").columns) == 4
    with pytest.raises(ValueError, match="more than 3 values"):
        stats.crosstab_wide(df, "a", "b")
    assert stats.crosstab_wide(df, "a", "b", values=[0, 1, 2, 3]).count() == 2


QUESTIONS = [
    "Compute the total freight of late shipments per nation",
    "Rank suppliers by returned parts, worst first",
    "Which brands do urgent orders hold",
    "Why does the rebate influence returns so strongly",
    "Is the spread of order prices seasonal in any region",
    "Forecast demand for steel fittings next year",
    "Discover hidden clusters among clerks",
    "Has the share of air freight moved over time",
    "Ship it",
]


def test_intents_and_buckets(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "id int, q string")
    ordered = [r["intent"] for r in textstats.classify_intent(df, "q").orderBy("id").collect()]
    assert ordered == ["statistical", "comparative", "descriptive", "analytical", "descriptive", "predictive", "exploratory", "descriptive", "descriptive"]
    scored = textstats.classify_intent(df, "q", "scored").orderBy("id").collect()

    def brute(q):
        s = {k: sum(w in q.lower() for w in words) for k, words in rules.INTENTS_SCORED}
        best = max(s, key=s.get)
        return best, (s[best] / sum(s.values()) if sum(s.values()) else 0.5)

    assert [(r["intent"], r["confidence"]) for r in scored] == [brute(q) for q in QUESTIONS]
    buckets = [r["bucket"] for r in textstats.question_bucket(df, "q").orderBy("id").collect()]
    assert [buckets[i] for i in (0, 1, 4, 5, 7)] == ["statistical", "comparative", "distribution", "predictive", "trend"]


def test_diversify_takes_turns_without_repeats(spark):
    texts = ["top a", "TOP  a ", "top b", "top c", "trend a", "mean a", "why", "trend b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, q string").repartition(4)
    got = [r["question"] for r in textstats.diversify(df, "q", ["id"], 6).collect()]
    assert got == ["top a", "trend a", "mean a", "why", "top b", "trend b"]
    assert len(textstats.diversify(df, "q", ["id"], 50).collect()) == 7


def test_questions_in_matches_python(spark):
    texts = [
        "Intro\n1. How did the sales change over time?\n2. Which group is best overall?\n- What about the price of it?",
        "no question here\nwhy it fell so much\n* short",
        "Q1: What drives revenue growth? Question: Is it seasonal at all?",
        "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["q"] for r in df.select(textstats.questions_in(F.col("t")).alias("q")).collect()]

    def brute(text):
        found = []
        for p in textstats.QUESTION_PATTERNS:
            for m in re.findall(p, text):
                m = re.sub(r"^\d+\.\s*|^[-•*]\s*", "", m.strip())
                if len(m) > 10 and m not in found:
                    found.append(m)
        return found

    assert got[0] == brute(texts[0]) and got[2] == brute(texts[2])
    assert got[1] == ["why it fell so much?"] and got[3] == []
    strict = [r["q"] for r in df.select(textstats.questions_in(F.col("t"), strict=True).alias("q")).collect()]
    assert all(len(q) > 30 for qs in strict for q in qs)
    quoted_ones = spark.createDataFrame([('1. "How has the volatility of prices moved over the decade?"\n- "Which factors drive the trend of late returns?',)], "t string")
    found = quoted_ones.select(textstats.questions_in(F.col("t"), strict=True).alias("q")).first().q
    assert "How has the volatility of prices moved over the decade?" in found and "Which factors drive the trend of late returns?" in found
    numbered = df.select(textstats.numbered_lines(F.col("t")).alias("q")).first()["q"]
    assert numbered == ["How did the sales change over time?", "Which group is best overall?"]


def test_language_of(spark):
    texts = ["the house and the garden", "der Hund und die Katze", "le chat et la maison", "el perro y los gatos", "xyzzy", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["l"] for r in df.select(textstats.language_of(F.col("t")).alias("l")).collect()] == ["en", "de", "fr", "es", "unknown", "unknown"]


def test_profile_text_skips_empty_but_not_blank(spark):
    df = spark.createDataFrame([("a b",), ("",), ("  ",), (None,)], "t string")
    got = textstats.profile_text(df, "t").first()
    assert tuple(got) == (2, 2.5, 2, 3, 1.0)


def test_forecast_continues_a_weekly_pattern(spark):
    days = pd.date_range("2024-01-01", periods=70)
    y = [100 + 2 * i + (10 if d.dayofweek == 0 else 0) for i, d in enumerate(days)]
    df = spark.createDataFrame(pd.DataFrame({"d": days, "y": np.array(y, float)}))
    got = forecast.forecast(df, "d", "y", 14).toPandas().sort_values("ds").reset_index(drop=True)
    assert len(got) == 84 and got.is_future.sum() == 14
    want = [100 + 2 * i + (10 if (days[0] + pd.Timedelta(days=i)).dayofweek == 0 else 0) for i in range(84)]
    np.testing.assert_allclose(got.yhat, want, atol=0.5)
    assert (got.yhat_lower <= got.yhat).all() and (got.yhat <= got.yhat_upper).all()
    with pytest.raises(ValueError):
        forecast.forecast(df, "no", "y")


def test_forecast_of_one_day_is_flat(spark):
    df = spark.sql("SELECT date'2024-01-01' AS d, 5.0D AS y")
    assert {r["yhat"] for r in forecast.forecast(df, "d", "y", 3).collect()} == {5.0}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [(20_000, 2000), (40, 2)])
def test_top_k_matches_brute_force(spark, metric, blocks):
    rng = np.random.default_rng(2)
    base, wanted = rng.normal(size=(300, 4)), rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, v array<double>").repartition(6)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wanted)], "q long, w array<double>")
    got = vectors.top_k(df, q, "id", "v", "q", "w", 3, metric, *blocks).collect()
    for i, w in enumerate(wanted):
        if metric == "l2":
            d = np.sqrt(((base - w) ** 2).sum(1))
        else:
            d = 1 - base @ w / np.linalg.norm(base, axis=1) / np.linalg.norm(w)
        mine = sorted((r["rank"], r["id"]) for r in got if r["q"] == i)
        assert [m[1] for m in mine] == list(np.argsort(d)[:3])


def test_top_k_keeps_text_ids_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), (None, [9.0, 9.0]), ("z", None)], "id string, v array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0])], "q string, w array<double>")
    got = [(r["q"], r["rank"], r["id"]) for r in vectors.top_k(df, q, "id", "v", "q", "w", 2, row_block=2, query_block=1).collect()]
    assert sorted(got) == [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c"), ("y", 2, "a")]


def test_chunks_respect_size_and_lose_nothing(spark, data):
    rng = np.random.default_rng(0)
    gaps = [" ", "  ", ".\n", ".\n\n", "\n\n\n"]
    for _ in range(30):
        # Every word occurs once, so a chunk has one place in the text.
        text = "".join(f"w{i}{'x' * rng.integers(0, 30)}{rng.choice(gaps)}" for i in range(rng.integers(1, 200)))
        chunks = split_recursive(text, 100, 20)
        assert all(0 < len(c) <= 100 for c in chunks)
        end = 0
        for c in chunks:
            start = text.index(c)
            assert text[end:start].strip() == "" and end - start <= 20
            end = start + len(c)
        assert text[end:].strip() == ""
    assert split_recursive("y" * 250, 100, 20)[0] == "y" * 100
    assert split_recursive("", 100, 20) == []
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = chunk_text(docs, "text", ["doc_id"])
    assert out.where("length > 1000 OR length = 0").count() == 0
    assert out.select("doc_id").distinct().count() == docs.where(F.trim("text") != "").count()


def test_chunks_leave_a_task_as_they_come(spark, monkeypatch):
    """A few chunks at a time, none lost between them, with the columns of their text."""
    from tabulens.sources import chunking

    monkeypatch.setattr(chunking, "SENT", 150)
    texts = [" ".join(f"w{i:03d}" for i in range(k)) for k in (0, 1, 90, 400)] + [None, "  ", "a\n\nb " * 60]
    df = spark.createDataFrame([(i, t, [i, None]) for i, t in enumerate(texts)], "id int, `a text` string, `k.x` array<int>").coalesce(1)
    got = chunk_text(df, "a text", ["id", "k.x"], 100, 20)
    rows = sorted((r["id"], r["chunk_no"], r["content"], r["length"], r["k.x"]) for r in got.collect())
    assert rows == [(i, n, c, len(c), [i, None]) for i, t in enumerate(texts) for n, c in enumerate(split_recursive(t or "", 100, 20))]


def test_chunk_overlap_is_shared(spark):
    text = " ".join(f"w{i:03d}" for i in range(100))
    chunks = split_recursive(text, 100, 30)
    for a, b in zip(chunks, chunks[1:]):
        assert a[-20:].split()[-1] in b[:35]


def test_json_shapes(spark, tmp_path):
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"a": 1, "b": {"c": 2, "d": {"e": "x"}}}, {"a": 2, "b": None}]))
    df = readers.read_json(spark, str(array))
    assert df.columns == ["a", "b_c", "b_d_e"] and df.count() == 2
    assert readers.read_json(spark, str(array), flatten=False).columns == ["a", "b"]
    one = tmp_path / "one.json"
    one.write_text('{\n "a": 1,\n "t": [1, 2]\n}')
    assert rows(readers.read_json(spark, str(one))) == [(1, [1, 2])]
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": 1}\n{"a": 2\n\n{"a": 3}\n')
    assert rows(readers.read_json(spark, str(lines), on_bad="skip")) == [(1,), (3,)]
    assert tuple(readers.bad_line_count(spark, str(lines)).first()) == (2, 1)
    envelope = tmp_path / "env.json"
    envelope.write_text(json.dumps({"dataset_name": "d", "data": [{"k": 1}, {"k": 2}]}))
    assert rows(readers.unwrap_envelope(readers.read_json(spark, str(envelope)))) == [(1,), (2,)]


def test_text_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café ".encode("utf-8") * 300)
    (tmp_path / "b.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"ok \x81 \xff")
    got = {json.loads(r["metadata"])["source"][-5:]: r["content"] for r in readers.read_text(spark, str(tmp_path)).collect()}
    assert got["a.txt"].startswith("café") and got["b.txt"] == "café" and got["c.txt"] == "ok"
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "e.txt").write_text("  ")
    with pytest.raises(ValueError):
        readers.read_text(spark, str(empty))


def test_read_any_by_extension(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    assert rows(readers.read_any(spark, str(tmp_path / "x.csv"))) == [(1, "x"), (2, None)]
    for name in ("x.xlsx", "x.pdf", "x.bin"):
        with pytest.raises(ValueError):
            readers.read_any(spark, str(tmp_path / name))


def test_match_columns_rules(spark):
    df = spark.createDataFrame([("compare them",), ("the Price by region",), ("mean",), ("hello",)], "q string")
    got = [r["columns"] for r in schema.match_columns(df, "q", ["price", "qty"], ["region"]).collect()]
    assert got == [["region", "price"], ["price", "region"], ["price", "qty"], ["region", "price", "qty"]]


def test_correlation_of_a_wide_table(spark):
    """2,000 columns with gaps in one scan, equal to pandas' pairwise correlation."""
    rng = np.random.default_rng(4)
    n, c = 120, 2000
    x = rng.normal(0, 1, (n, c)) + rng.normal(0, 1, (n, 1)) + 1e6 * rng.integers(0, 2, c)
    x[rng.random((n, c)) < 0.05] = np.nan
    x[:, 7] = 0.1
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(c)])).repartition(2)
    got = stats.correlation(df, df.columns)
    assert got._jdf.queryExecution().toString().count("MapInArrow") >= 1
    found = np.full((c, c), np.nan)
    rows = got.where("r IS NOT NULL").select("i", "j", "r").toPandas()
    found[rows.i, rows.j] = rows.r
    want = np.where(np.triu(np.ones((c, c), bool), 1), pd.DataFrame(x).corr().to_numpy(), np.nan)
    np.testing.assert_allclose(found, want, atol=1e-7)


def test_correlation_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 0.1), (2.0, 5.0, None, 0.3), (3.0, 5.0, 1.0, None), (4.0, 5.0, None, None)], "a double, b double, `c.d` double, e double")
    got = {(r.a, r.b): r.r for r in stats.correlation(df, df.columns, full=True).collect()}
    assert len(got) == 16 and got["a", "a"] == 1.0 and got["b", "b"] is None and got["c.d", "c.d"] is None
    assert got["a", "e"] == got["e", "a"] == pytest.approx(1.0) and got["a", "b"] is None
    empty = stats.correlation(df.where("false"), df.columns)
    assert empty.count() == 6 and empty.where("r IS NOT NULL").count() == 0


def test_digests_tell_rows_apart(spark):
    """Missing values in different places, signed zeros, NaN, maps and long texts."""
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("a", None, float("nan")), ("a", None, None), (None, None, None), (None, None, float("nan")), ("x" * 5000, "", 1.0), ("x" * 5000, None, 1.0)]
    df = spark.createDataFrame(rows, "a string, `b.c` string, d double").withColumn("m", F.create_map(F.lit("k"), "d"))
    assert tuple(profile.duplicate_stats(df.drop("m")).first()) == (9, 6)
    assert tuple(profile.duplicate_stats(df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).first()) == (9, 6)
    counts = {r.column: r.num_unique for r in profile.distinct_counts(df.drop("m")).collect()}
    assert counts == {"a": 2, "b.c": 2, "d": 2}
    assert tuple(profile.duplicate_stats(df.where("false")).first()) == (0, 0)
    assert {r.num_unique for r in profile.distinct_counts(df.where("false")).collect()} == {0}
    missing = sum(v is None or v != v for r in rows for v in r)
    assert profile.quality_score(df.drop("m")).first().missing == missing


def test_learnt_sentiment(spark):
    """Held-out accuracy on labelled documents, weights by hand, nothing to learn from."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").withColumn("y", 1 - F.col("toxic"))
    model = textstats.fit_sentiment(docs.where("doc_id % 3 > 0"), "text", "y")
    assert 0 < len(model.weights) <= textstats.SENTIMENT_WORDS
    rows = textstats.learnt_sentiment(docs.where("doc_id % 3 = 0 AND y IS NOT NULL"), "text", model).select("y", "sentiment_score").collect()
    negative, positive = ([r.sentiment_score for r in rows if r.y == k] for k in (0, 1))
    assert np.mean([[b > a for a in negative] for b in positive]) > 0.9
    # One side is a tenth of the other: each counts alike.
    assert (np.mean([s < 0 for s in negative]) + np.mean([s > 0 for s in positive])) / 2 > 0.75
    few = spark.createDataFrame([("ok ok fine", 1)] * 12 + [("dull", 0)] * 12 + [("fine dull odd", None), (None, 1)], "t string, y int")
    learnt = textstats.fit_sentiment(few, "t", "y", lexicon={"positive": ("ok",), "negative": ()})
    assert set(learnt.weights) == {"ok", "fine", "dull"}
    assert learnt.weights["fine"] == pytest.approx(np.log(12.5 / 14) - np.log(0.5 / 13)) and learnt.weights["ok"] > learnt.weights["fine"]
    scored = [r.sentiment_score for r in textstats.learnt_sentiment(few, "t", learnt).collect()]
    assert scored[0] > 0 > scored[15] and scored[-1] == learnt.bias
    nothing = textstats.fit_sentiment(few.where("false"), "t", "y")
    assert nothing.weights == {} and textstats.learnt_sentiment(few, "t", nothing).first().sentiment_score == 0.0
