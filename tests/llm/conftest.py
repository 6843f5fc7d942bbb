import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    # names that operators might use inside
    T.StructField("doc", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n.x", T.LongType()), T.StructField("label", T.StringType()),
])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns of awkward names."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "d", 1, 2, "l") for r in rows], SCHEMA)

    return make


LONG = " ".join(f"word{i % 7001}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(frame):
    """Nulls, empty and very long texts, ties, repeated rows."""
    same = "one line of text that is shared by some\nanother line that is shared by all of them"
    return frame([
        (1, same), (2, same), (2, same), (3, None), (None, same), (None, None), (4, ""), (5, " \t\n\x0b "), (6, LONG, None),
        (7, LONG, None), (8, "single"), (9, "SINGLE", ""), (10, "Ünïcödé ▁ 😀 text \u0000 with controls\r\n\nend", "t"),
    ])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
