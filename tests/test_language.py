"""Languages from trigrams: held-out accuracy in each, short texts, odd rows."""

from pyspark.sql import functions as F

from tabulens.operators import language


def test_held_out_accuracy_in_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND length(text) > 60")
    model = language.fit_languages(docs.where("doc_id % 2 = 0"), "text", "lang")
    held = docs.where("doc_id % 2 = 1").withColumn("short", F.expr("substring(text, 15, 20)"))
    for column, least in (("text", 0.97), ("short", 0.8)):
        found = language.detect_language(held, column, model)
        rates = found.groupBy("lang").agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("r"), F.count("*").alias("n")).collect()
        assert len(rates) == 4 and all(r.r >= least for r in rates), (column, rates)


def test_by_hand(spark):
    rows = [("aba aba", "x"), ("aba", "x"), ("ccc Ünd", "y"), (None, "x"), ("aba", None), ("z" * 50 + " c3c", "y")]
    df = spark.createDataFrame(rows, "`a text` string, lang string")
    counts = {(r.lang, r.gram): r.n for r in language.gram_counts(df, "a text", "lang").collect()}
    assert counts["x", " ab"] == counts["x", "aba"] == counts["x", "ba "] == 3 and counts["y", "ünd"] == 1 and counts["y", " c "] == 2
    assert not any("z" in g for _, g in counts)
    model = language.fit_languages(df, "a text", "lang")
    found = {r["a text"]: r.language for r in language.detect_language(df, "a text", model).collect()}
    assert found == {"aba aba": "x", "aba": "x", "ccc Ünd": "y", None: None, "z" * 50 + " c3c": "y"}
    assert language.detect_language(df.where("false"), "a text", model).count() == 0
    nothing = language.fit_languages(df.where("false"), "a text", "lang")
    assert [r.language for r in language.detect_language(df.limit(1), "a text", nothing).collect()] == [None]


def test_model_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_languages(docs, "text", "lang", top=50)
    assert len(model.weights) <= 200 and model.languages == ("de", "en", "es", "fr")


def test_scores_by_hand_and_a_full_memory(monkeypatch):
    """Words are looked up once and added up as an array; the same languages as word by word, also after forgetting."""
    grams = {" ab": (-1.0, -2.5, -2.5), "aba": (-3.0, -0.5, -0.5), "cc ": (-0.25, -4.0, -4.0), "ünd": (-2.0, -2.0, -2.0)}
    model = language.LanguageModel(("x", "y", "z"), grams)
    monkeypatch.setattr(language._Words, "KEPT", 2)
    words = language._Words(model)
    texts = ["Aba aba", "ccc", "ünd", "aba ccc ünd", "q", "", None, "z" * 50, "aba " * 3000 + "ccc", " ".join(f"aba{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600) if i % 26 > 1) + " x" * 2000]
    for text in texts:
        total = None
        for word in language.re.findall(language.WORD, (text or "").lower()):
            if len(word) <= language.LONGEST and (s := model.scores(word)) is not None:
                total = s if total is None else tuple(a + b for a, b in zip(total, s))
        assert words.language(text) == (None if total is None else model.languages[max(range(3), key=lambda i: (total[i], -i))])
    assert len(words.table) <= 2048
